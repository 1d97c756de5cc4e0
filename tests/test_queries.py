"""Queries against their SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from prosegauge.plans import corpus as C
from prosegauge.plans import registry
from prosegauge.plans.ruleset import load_rules

SF = "/root/testdata/sf0.001"
FEW = ["rhythm", "word_lengths", "morph", "structure", "repeats", "cyrillic_share", "norm_hash", "scan_ru", "scan_code", "score", "genre_mute", "fill_lines", "top_markers", "builtin_en_dash", "strip_markup", "struct_checks", "commit_checks", "touching", "text_copies", "pair_match", "merge_spans", "fix_batch", "fix_batch_lost", "code_around", "baseline_new", "baseline_fixed", "calibrate_percentiles", "clones", "erosion", "lift", "fn_lang_of", "pred_allow", "src_git_log", "src_git_diff", "unseen", "retry_after"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", FEW)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(norm(r[k]) for k in at) for r in want.fetchall())


def test_builtin_rules_have_findings(spark, duck, monkeypatch):
    from prosegauge.plans import q_blocks, q_text

    texts = ["Проверка от идеи\nдо продукта здесь", "Слово\nпрoвeрка слова\nи пaрa", "от Москвы до Твери, от зари до зари", "Путь от ума до сердца\nи от слов до дела", "тире – тут\nс 5 – 7 и 8 – да"]
    b = spark.createDataFrame([("f", k * 10 + 1, t, False, "") for k, t in enumerate(texts)], "file string, start int, text string, doc boolean, next string")
    monkeypatch.setattr(q_blocks, "_live", lambda s, d: b)
    fake, latin = "от X до Y (ложный диапазон)", "Latin inside a Cyrillic word"
    want = [(1, fake), (12, latin), (13, latin), (31, fake), (32, fake)]
    got = q_blocks.rule_findings(spark, "").collect()
    assert sorted((r["line"], r["rule"]) for r in got if r["rule"] in (fake, latin)) == want
    duck.sql("create or replace temp table t as select * from (values " + ", ".join(f"({k * 10 + 1}, '{t}')" for k, t in enumerate(texts)) + ") v(doc_id, text)")
    rules = [r for r in load_rules("ru").rules if r.kind == "builtin"]
    lines = duck.sql(f"WITH {q_text.sql_lines(rules, 't')} SELECT DISTINCT doc_id + line - 1, rule FROM l2").fetchall()
    assert sorted((int(n), r) for n, r in lines) == sorted([*want, (41, "En dash"), (42, "En dash")])


def test_language_of_whole_texts(spark):
    got = {r["doc_id"]: r["lang"] for r in registry.QUERIES["lang_of_text"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in C.texts(spark, SF).collect()}
    russian = lambda t: (n := sum(c.isalpha() for c in t)) and sum("а" <= c.lower() <= "я" or c in "Ёё" for c in t) / n >= 0.3
    assert got == {k: "ru" if t is not None and russian(t) else "en" for k, t in texts.items()}


def test_rates_as_printf_has_them(spark, duck):
    from prosegauge.operators import scoring

    rows = [(n, w) for n in range(1, 40) for w in range(1, 801, 3)] + [(1, 400), (9, 400), (7, 2000), (199, 2000), (9999, 100000)]
    given = spark.createDataFrame(rows, "n long, w long").repartition(4)
    got = {(r["n"], r["w"]): r["said"] for r in given.select("n", "w", scoring.marker_verdict(given["n"], given["n"] * 0, given["w"]).alias("said")).collect()}
    want = {(n, w): duck.execute("select printf('%.1f', ?::BIGINT::DOUBLE / ?::BIGINT * 100)", [n, w]).fetchall()[0][0] for n, w in set(rows)}
    assert {k: v.split("(")[1].split(" ")[0] for k, v in got.items()} == want
    assert got[9, 400] == "9 (2.2 per 100 words) - density is elevated, worth a look"


def test_quiet_rates(spark):
    from pyspark.sql import functions as F

    from prosegauge.operators import reports

    rows = [(1, 0, 80, "1.2"), (9, 0, 400, "2.2"), (3, 4, 2000, "0.3"), (5, 0, 0, "500.0"), (11, 0, 400, "2.8")]
    given = spark.createDataFrame(rows, "soft long, copy_paste long, words long, want string").selectExpr("*", "100 score", "'clean' band", "0L other_bans", "2L dash_bans")
    for r in given.select(reports.quiet(F.lit("doc1")).alias("line"), "want").collect():
        assert r["line"] == f"{'doc1':40} 100/100 [clean] bans: 0 (+2 dashes), markers: {r['want']}/100 words"


@pytest.mark.parametrize("shared", [False, True])
def test_repeats_leave_their_row_alone(spark, shared):
    from prosegauge.functions import text as T
    from prosegauge.operators import metrics

    rows = [(1, "One two three. " * 3 + "x"), (2, "a the of a the of a the of a the of"), (3, None), (4, ""), (5, "b b b b b b b"), (6, "b b b b"), (None, "red green blue " * 4), (7, "no no")]
    rows += [(6, "B, b, b."), (8, "q r s"), (8, "q r s t"), (8, "Q r s"), (None, "red green blue")] * shared
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    count, each = Counter(), Counter()
    for k, t in rows:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        count.update((k, " ".join(g)) for g in zip(w, w[1:], w[2:]) if set(g) - set(T.PHRASE_STOPWORDS))
        each[k, len(w)] += 1
    want = {(*x, n) for x, n in count.items() if n >= 3}
    found = metrics.repeats(docs)
    assert Counter((r["doc_id"], r["phrase"], r["n"]) for r in found.collect()) == Counter(want)
    assert shared or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    per = Counter(k for k, _, _ in want if k is not None)
    rate = lambda k, n: math.floor(per[k] / n * 1000 * 100 + 0.5) / 100 if n >= 3 else 0.0
    assert Counter((r["doc_id"], r["repeats"], r["repeat_per_1000"]) for r in metrics.repeat_rate(docs).collect()) == Counter((k, per[k], rate(k, n)) for (k, n), m in each.items() for _ in range(m))


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_hook_stream_is_the_batch(spark):
    one, other = (registry.QUERIES[n](spark, SF).select("session", "hash", "place").collect() for n in ("hook_stream", "unseen"))
    assert sorted(one) == sorted(other)
