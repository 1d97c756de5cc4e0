import pytest

from prosegauge.functions import text as T
from prosegauge.operators import matching
from prosegauge.plans.ruleset import RuleError, allowed, load_rules, parse

CASES = [
    ("ru", "В современном мире", "В современном мире данные решают", 1),
    ("ru", "В современном мире", "в современных реалиях", 0),
    ("ru", "En dash", "Отчёт за 2020–2024 годы.", 0),
    ("ru", "En dash", "Отчёт – это важно.", 1),
    ("ru", "En dash", "с 5 – 7 и 8 – x", 1),
    ("ru", "Данный/Данная/Данное", "данный данный", 1),
    ("ru", "Данный/Данная/Данное", "данный, и данный", 2),
    ("ru", "от X до Y (ложный диапазон)", "от идеи до продукта", 1),
    ("ru", "от X до Y (ложный диапазон)", "от Москвы до Твери, от зари до зари", 0),
    ("en", "Delve into", "we DELVE  into it", 1),
    ("en", "Delve into", "indelve into it", 0),
    ("en", "robust", "Robust, robustness", 2),
    ("code", "constructor / getter / imports", "Constructor:", 1),
    ("code", "constructor / getter / imports", "constructor validates input", 0),
    ("code", "AI-generated comment", "Generated by the build script", 0),
]


def test_counts(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, _, t, _) in enumerate(CASES)], "doc_id int, text string")
    for name in ("ru", "en", "code"):
        found = {(r["doc_id"], r["rule"]): r["count"] for r in matching.hits(docs, list(load_rules(name).rules)).where("hard or true").select("doc_id", "rule", "count").collect()}
        for k, (s, rule, _, n) in enumerate(CASES):
            if s == name:
                assert found.get((k, rule), 0) == n, CASES[k]


def test_single_latin_letter(spark):
    rule = next(r for r in load_rules("ru").rules if r.pattern == "latin_in_cyrillic")
    docs = spark.createDataFrame([(1, "хорoший аbвcд latin"), (2, "a б c")], "doc_id int, text string")
    assert {r["doc_id"]: r["count"] for r in matching.scan(docs, [rule]).collect()} == {1: 3}


def test_lines(spark):
    docs = spark.createDataFrame([(1, "раз\nданный\nданный данный\n\nданный")], "doc_id int, text string")
    rule = next(r for r in load_rules("ru").bans if r.name.startswith("Данный"))
    got = matching.with_lines(matching.hits(docs, [rule])).first()
    assert got["count"] == 3 and got["lines"] == [2, 3, 5]


def test_density(spark):
    rs = load_rules("ru")
    docs = spark.createDataFrame([(1, "является " * 1, 20), (2, "является, является", 20), (3, "является, является", 2000)], "doc_id int, text string, words int")
    rule = [r for r in rs.bans if r.name == "Является"]
    got = matching.dense_enough(matching.hits(docs, rule, key=["doc_id", "words"]), rs)
    assert [r["doc_id"] for r in got.collect()] == [2]


def test_files_are_checked():
    ok = {"hard_bans": [{"name": "a", "lit": "x"}], "categories": [{"name": "c", "lift": 2, "rules": [{"lit": "y"}, {"lit": "z", "lift": 3}]}]}
    rs = parse("own", ok)
    assert [(r.name, r.lift) for r in rs.rules] == [("a", 0), ("y", 2), ("z", 3)]
    for bad in (
        {},
        {"hard_bans": [{"name": "a", "lit": "x", "re": "y"}]},
        {"hard_bans": [{"name": "a", "builtin": "nope"}]},
        {"hard_bans": [{"re": "x"}]},
        ok | {"genres": {"g": {"mute_bans": ["typo"]}}},
        ok | {"freq_bans": {"typo": 5}},
    ):
        with pytest.raises(RuleError):
            parse("own", bad)
    with pytest.raises(RuleError):
        load_rules("nope")


def test_own_file(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text("hard_bans:\n  - name: shout\n    word_re: 'hey+'\n")
    rs = load_rules("own", str(path))
    docs = spark.createDataFrame([(1, "Heyyy you, they")], "doc_id int, text string")
    assert matching.scan(docs, list(rs.rules)).first()["count"] == 1


def test_allowed():
    rules = list(load_rules("ru").rules)
    assert {r.name for r in allowed(rules, only=["em DASH"])} == {"Em dash"}
    assert all(r.category != "Calques" for r in allowed(rules, disable=["calques"]))


def test_needed():
    assert T.needed(r"стоит\s+отметить") == ["отметить"]
    assert T.needed("abc|de") == [] and T.needed("abc|defg") == ["abc", "defg"]
    assert T.needed("abcd?ef") == ["abc"] and T.needed("(?:abc)x") == [] and T.needed(r"\p{L}abc+d") == ["abc"]
    assert T.needed(r"ab{2}cdef") == ["cdef"] and T.needed("[abc]+") == [] and T.needed(r"a\.b") == ["a.b"]


def test_english_set_is_whole(spark):
    rs = load_rules("en")
    assert len(rs.bans) == 22 and len(rs.markers) == 338 and len({r.category for r in rs.markers}) == 52
    assert "Tier 3 vocabulary" in rs.muted("code")[1] and "realm(s)" in rs.muted("commit")[2]
    said = [("tapestry", "A rich tapestry."), ("realm(s)", "in the realm of build tooling"), ("studies show/suggest/indicate", "Studies show it."), ("interesting part/thing: (line opener)", "So.\n interesting part: x")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(said)] + [(9, "real estate data")], "doc_id int, text string")
    found = {(r["doc_id"], r["rule"]): r["count"] for r in matching.hits(docs, list(rs.rules)).collect()}
    assert all(found.get((k, rule)) == 1 for k, (rule, _) in enumerate(said)) and not any(k == 9 for k, _ in found)


def test_demands():
    assert T.demands(r"(?:linked|tied)\s+to", edge=True) == [[[("linked", True), ("tied", True)], [("to", True)]]]
    assert T.demands("ab?cd|x\\s*(?:(?:yes|no) z){2}") == [[[("cd", False)]], []]
    assert T.demands(r"(?i)don\x27t\s+Ask[\x{2014}\x{2705}]") == [[[("don't", False)], [("\u2014", False), ("\u2705", False)], [("ask", True)]]]
    assert T.demands(r"^(?:ab|cd)") == [[]] and T.demands(r"(?im)^(ab|cd)(?!ef)") == [[[("ab", False), ("cd", False)]]]
    assert T.demands(r"(?:is\s+ab|cd\s*:)", edge=True) == [[[("is", True)], [("ab", True)]], [[("cd", True)], [(":", False)]]]
    assert matching.literal_demand("it is Important, note") == "important" and matching.literal_demand("delve") == ""


def test_demands_hold(spark):
    """No match is lost to what texts are asked for before a regex is run."""
    from pyspark.sql import functions as F

    for name in ("ru", "en", "code"):
        rs = load_rules(name)
        said = sorted({t for r in rs.rules for t, _ in r.tests} | {f"x {t.upper()}\n— {t}, {t}" for r in rs.rules for t, _ in r.tests} | {f"{r.pattern} Ok, {r.pattern.title()}!" for r in rs.rules if r.kind == "lit"})
        docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string").repartition(4).cache()
        rules = [r for r in rs.rules if r.kind != "builtin"]
        plain = F.array(*[F.regexp_count("text", F.lit(r.jdk)) for r in rules])
        want = {(r["doc_id"], k, n) for r in docs.select("doc_id", plain.alias("n")).collect() for k, n in enumerate(r["n"]) if n}
        assert {(r["doc_id"], r["rule_no"], r["count"]) for r in matching.scan(docs, rules).collect()} == want


def test_rules_are_asked_once(spark):
    from prosegauge.plans.ruleset import Rule

    docs = spark.createDataFrame([(1, "zzqq fact, \u017feem"), (2, None), (3, "no")], "doc_id int, text string")
    rules = [Rule("x", 0, "c", "r", "word_re", r"zzqq\s+fact", "", 0.0), Rule("x", 1, "c", "l", "lit", "Seem", "", 0.0)]
    found = matching.scan(docs, rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("zzqq[") == 1
    assert {(r["doc_id"], r["rule_no"], r["count"]) for r in found.collect()} == {(1, 0, 1), (1, 1, 1)}
