"""The pipeline's stages, each against a plain version of its own input."""

import hashlib
import random

import corpus_pipeline
from prosegauge.llm import near_copies
from tests.llm.test_operators import plain_components, plain_fingerprint


def test_stages(spark, docs, rows, tmp_path):
    had = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, had, "")
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == had.columns, name
        before, after = had.select("doc_id", "text").collect(), out.collect()
        if name == "language ID":
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r[0]) for r in before if any(c.isalpha() for c in r[1] or ""))
        if name == "exact dedup":
            assert sorted(r["text"] for r in after) == sorted({r[1] for r in before})
        if name == "SimHash near-dedup":
            top = plain_components([plain_fingerprint(t) for _, t in before])
            named = {top[plain_fingerprint(t)] for i, t in before if i is not None}
            assert len([r for r in after if r["doc_id"] is not None]) == len(named)
        if name == "byte-level BPE":
            assert len(after) == len(before) and all(r["round_trip"] for r in after)
        had = out


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    once, again = (corpus_pipeline.run(spark, f"file://{tmp_path}") for _ in range(2))
    digest = lambda df: sorted(hashlib.sha256(bytes(r["ids"])).hexdigest() for r in df.collect())
    assert digest(once) == digest(again)


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_copies_by_similarity(spark):
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    texts += [" ".join(base[:at] + [f"new{at}"] + base[at + 1 :]) for at in range(5, 300, 13)]  # similarity about 0.97
    texts += [" ".join(f"w{k}" if k % 37 else f"odd{k}" for k in range(300)), " ".join(f"v{k}" for k in range(300)), "a b", "A  b", "a c"]
    texts += [" ".join([f"v{k}" for k in range(150)] + base[:150])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_shingles(t) for t in texts]
    top = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                top = [min(top[x], top[y]) if t in (top[x], top[y]) else t for t in top]
    assert len(set(top)) < len(texts)
    for hot in (128, 4):  # all pairs of a key, and in blocks
        old, near_copies.HOT_KEY, near_copies.BLOCK = near_copies.HOT_KEY, hot, 8
        try:
            assert sorted(r["doc_id"] for r in near_copies.one_of_each(df).collect()) == sorted(set(top))
        finally:
            near_copies.HOT_KEY, near_copies.BLOCK = old, 512


def test_rows_that_share_an_id_or_have_none(spark):
    one, other, third = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, one), (1, other), (2, other + " z"), (None, third), (None, third + " z"), (None, one + " z")]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and {(1, one), (1, other)} < {(r["doc_id"], r["text"]) for r in kept}
    assert next(r["text"] for r in kept if r["doc_id"] is None) in (third, third + " z")


def through(spark, docs, path):
    """Every stage's rows, each stage on what the one before returned."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"file://{path}/{k}")
        docs = spark.read.parquet(f"file://{path}/{k}")
        out.append(docs.collect())
    return out


def test_nothing_to_learn_from(spark, tmp_path):
    rows = [(k, " ".join(f"{'abcdefgh'[k % 8]}{n}x{k}" for n in range(20)), None, "s", 9) for k in range(12)] + [(50, "12 34", None, "s", 5), (51, None, None, None, 0)]
    stages = through(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2), tmp_path)
    assert [len(x) for x in stages[:3]] == [12, 12, 12] and all(r["round_trip"] for r in stages[4])


def test_empty_table(spark, nothing, tmp_path):
    assert [len(x) for x in through(spark, nothing, tmp_path)] == [0] * 5


def test_one_id_with_two_texts(spark, tmp_path):
    text = lambda x: " ".join(f"{x}word{k}" for k in range(30))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (2, text("c"), "en", "s", 1), (2, text("c"), "en", "s", 1)]
    stages = through(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path)
    assert [sorted({r["text"] for r in x}) for x in stages[:3]] == [sorted({r[1] for r in rows})] * 3
    assert [len(x) for x in stages[:3]] == [4, 3, 3]


def test_pairs_at_the_threshold_share_keys_of_the_method(spark):
    made = []
    for k in range(60):
        words = [f"w{k}x{n}" for n in range(90)]
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:81] + [f"new{k}x{n}" for n in range(9)]))]  # similarity 0.81
    df = spark.createDataFrame(made, "doc_id long, text string")
    anchor, tables = near_copies.layout(len(made))
    rows = near_copies.signed(df, near_copies.width(anchor, tables))
    of = {r["node"]: r["doc_id"] for r in rows.select("node", "doc_id").collect()}
    keys = {}
    for r in near_copies.keyed(rows.select("node", "n", "bits"), anchor, range(tables)).collect():
        keys.setdefault(of[r["node"]], set()).add(r["key"])
    assert len(of) == len(made) and all(keys[2 * k] & keys[2 * k + 1] for k in range(60))
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(df).collect()) == list(range(0, 120, 2))


def test_disk_of_near_dedup_is_in_proportion(spark):
    # a text has as many keys however long it is, and texts that only meet by chance aren't compared on their sets
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(40 if k % 2 else 4000))) for k in range(400)], "doc_id long, text string")
    anchor, tables = near_copies.layout(400)
    assert near_copies.layout(50_000) == near_copies.layout(250_000) == (anchor, tables)
    nodes = near_copies.signed(df, near_copies.width(anchor, tables)).select("node", "n", "bits")
    keys = near_copies.keyed(nodes, anchor, range(tables)).persist()
    sizes = {r["n"]: r["count"] / 200 for r in keys.groupBy("n").count().collect()}
    assert all(2 * tables < x < 5 * tables for x in sizes.values()) and len(sizes) == 2
    assert near_copies.met(keys, near_copies.HOT_KEY).count() == 0
    keys.unpersist()


def moved_mb(spark):
    """MB that the session's stages have written for shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def test_a_group_that_is_not_alike_enough_is_not_compared_pair_by_pair(spark, monkeypatch):
    # copies of one text with 0 to 11 of 150 words changed at random: some are linked, most are near no other
    rng, texts = random.Random(5), []
    for k in range(240):
        words = [f"w{n}" for n in range(150)]
        for at in rng.sample(range(150), k % 12):
            words[at] += rng.choice("abc")
        texts.append(" ".join(words))
    sets, top = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for x in range(len(sets)):
        for y in range(x):
            if 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])):
                top = [min(top[x], top[y]) if t in (top[x], top[y]) else t for t in top]
    assert 60 < len(set(top)) < 180
    checked, real = [], near_copies.staged

    def counted(df, path):
        out = real(df, path)
        if path.endswith("/rest/pairs"):
            checked.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "staged", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot, block in ((1024, 512), (4, 8)):
        checked.clear()
        monkeypatch.setattr(near_copies, "HOT_KEY", hot)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert sorted(r["doc_id"] for r in near_copies.one_of_each(df).collect()) == sorted(set(top))
        assert len(checked) == 1 and checked[0] < 240 * 239 / 2 / 10, checked


def test_only_texts_that_are_checked_move(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(3000))) for k in range(300)]
    rows.append((300, rows[7][1] + " more"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/texts")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the asked ones are too many
    try:
        before = moved_mb(spark)
        groups = near_copies.near_groups(spark.read.parquet(f"file://{tmp_path}/texts"))
        assert groups.select("component").distinct().count() == 300
        assert moved_mb(spark) - before < 2  # all sets together take 7 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
