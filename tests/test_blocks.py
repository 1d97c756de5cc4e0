import pytest

from prosegauge.operators import blocks as B
from prosegauge.operators import comments as S
from prosegauge.operators import relational as R
from prosegauge.sources import paths as P
from prosegauge.sources.readers import Settings, SettingsError

GO = 'package x\n\n// first\n// second\nfunc f() {\n\ts := "// not" // trailing\n\t/* in\n\tside */\n}\n'


def test_go():
    got = [(b[1], b[2], b[4], b[7]) for b in S.extract("a.go", GO)]
    assert got == [(3, 4, "first\nsecond", "func f() {"), (6, 6, "trailing", 's := "// not"'), (7, 8, "in\n\tside", "}")]


@pytest.mark.parametrize(
    "path, src, want",
    [
        ("a.ts", "const a = `x // ${b /* in */ + `// ${c}`} // out`; // real", ["in", "real"]),
        ("a.ts", "const r = /[/*]\\/\\//; // after\nconst d = a / b; // div", ["after", "div"]),
        ("a.js", "return /\\/\\*/.test(x) // y", ["y"]),
        ("a.java", 'String s = """\n// not\n"""; // yes', ["yes"]),
        ("a.kt", "/* a /* b */ c */ val x = 1", ["a /* b */ c"]),
        ("a.c", "/* a /* b */ c */ int x;", ["a /* b"]),
        ("a.swift", 'let s = "\\"// no" // yes', ["yes"]),
        ("a.svelte", "<!-- m -->\n<script>\n// s\nlet a = 1</script>\n<p>// text</p><style>/* c */</style>", ["m", "s", "c"]),
        ("a.go", "x := '\"' // q", ["q"]),
        ("a.go", "// a\n\n// b\n\n\n// c\n", ["a", "b", "c"]),
    ],
)
def test_languages(path, src, want):
    assert [b[4] for b in S.extract(path, src)] == want


def test_depth():
    assert S.block_depth("func f() {\n\treturn\n}".split("\n"), 0) == 0
    assert S.block_depth("func f() {\n\tif a {\n\t\tfor b {\n\t\t\tx()\n\t\t}\n\t}\n}".split("\n"), 0) == 2
    assert S.block_depth(["x := 1"], 0) == 0


def blocks(spark, rows):
    made = [("f", 1, raw.count("\n") + 1, raw.count("\n") + 1, raw, following) for raw, following in rows]
    df = spark.createDataFrame([(f"f{k}", *r[1:]) for k, r in enumerate(made)], "file string, start int, end int, lines int, raw string, next string")
    return df.withColumn("text", B.strip_markers(df["raw"])).withColumn("doc", B.is_doc(df["raw"]))


def test_shapes(spark):
    rows = [
        ("// set user name", "func setUserName(n string) {", {"Comment restates the code"}),
        ("// why it is so", "func setUserName(n string) {", set()),
        ("// a\n// b\n// c", "x()", {"Long comment"}),
        ("// a\n// b\n// c", "package x", set()),
        ("// " + "y" * 101, "x()", {"Long comment line"}),
        ("// https://e.example/" + "y" * 101, "x()", set()),
        ("// ======", "x()", {"Separator banner"}),
        ("// TODO: later", "x()", {"TODO with no owner"}),
        ("// TODO(ann): later", "x()", set()),
        ('// say "TODO: x" here', "x()", set()),
        ("// if a {\n//   b();\n// }", "x()", {"Long comment", "Commented-out code"}),
        ("// Author: x", "x()", {"Changelog in a comment"}),
        ("// # Head", "x()", {"Markdown essay in a comment"}),
        ("// Step 1: a\n// Step 2: b", "x()", {"Step-by-step instructions"}),
    ]
    found = {}
    for r in B.comment_findings(blocks(spark, [x[:2] for x in rows])).collect():
        found.setdefault(r["file"], set()).add(r["rule"])
    for k, (raw, _, want) in enumerate(rows):
        assert found.get(f"f{k}", set()) == want, raw


def test_quotes_on_a_long_line(spark):
    from time import time

    from pyspark.sql import functions as F

    rows = [('say "x', True), ('say "x"', False), ('"\nplain', False), ("a `b", True), ("«a", True), ("«a»", False), ("", False), ('"' + "a " * 150_000, True), ("a " * 150_000 + "\n«", True)]
    began = time()
    got = spark.createDataFrame(rows, "t string, want boolean").select(B.in_quotes(F.col("t")).alias("q"), "want").collect()
    assert all(r["q"] == r["want"] for r in got) and time() - began < 20


def test_weight(spark):
    from pyspark.sql import functions as F

    rows = [(0.0, False, 1), (9.4, False, 9), (1.2, False, 1), (3.1, True, 9), (0.0, True, 3), (99.0, False, 10)]
    got = spark.createDataFrame(rows, "lift double, hard boolean, want int").select(B.weight(F.col("lift"), F.col("hard")).alias("w"), "want").collect()
    assert all(r["w"] == r["want"] for r in got)


def test_percentiles(spark):
    values = spark.createDataFrame([(x,) for x in [1, 1, 1, 1, 1, 2, 2, 3, 5, 40]], "value int")
    assert {r["p"]: r["value"] for r in R.percentiles(values, [50, 90, 99]).collect()} == {50: 2, 90: 40, 99: 40}
    assert {r["limit"]: r["over"] for r in R.cost(values, [1, 3]).collect()} == {1: 5, 3: 2}


def test_snapshot_versions(spark):
    from prosegauge.functions import text as T

    lines = spark.createDataFrame([("# note",), ("aa\tRule\tpath/x",), ("aa\tRule\tother",), ("",)], "line string")
    assert R.parse_snapshot(lines, 1).count() == 1
    assert R.parse_snapshot(lines, 2).count() == 3
    code = spark.range(1).select(T.rule_code(T.F.lit("Rule"))).first()[0]
    assert R.parse_snapshot(lines, 1).first()["code"] == code
    with pytest.raises(Exception, match="expected a hash"):
        R.parse_snapshot(spark.createDataFrame([("aa",)], "line string")).collect()


@pytest.mark.parametrize("glob, path, want", [("docs/*.go", "docs/a.go", True), ("docs/*.go", "docs/sub/a.go", False), ("**/a.go", "a.go", True), ("**/a.go", "x/y/a.go", True), ("x/**", "x/y/z", True), ("a?.go", "ab.go", True), ("a?.go", "a/.go", False)])
def test_globs(glob, path, want):
    import re

    assert bool(re.search(P.glob_regex(glob), path)) is want


def test_edits(spark):
    src = "a()\n// old text\nb() // t\n\t/* x */\nc()\r\n"
    rows = {b[4]: b for b in S.extract("f.go", src)}
    cut = lambda key, **how: (lambda p: src[: p[0]] + p[2] + src[p[1] :])(S.plan(src, rows[key][10], rows[key][11], rows[key][5], **how))
    assert cut("old text", delete=True) == src.replace("// old text\n", "")
    assert cut("t", delete=True) == src.replace(" // t", "")
    assert cut("x", delete=True) == src.replace("\t/* x */\n", "")
    assert cut("old text", delete=False, body="new") == src.replace("// old text", "// new")
    for key, body in (("t", "new"), ("old text", "..."), ("old text", "<new text>")):
        with pytest.raises(S.EditError):
            S.plan(src, rows[key][10], rows[key][11], rows[key][5], False, body)
    files = spark.createDataFrame([("f.go", src), ("g.go", "x")], "file string, text string")
    edits = spark.createDataFrame([("f.go", b[10], b[11], b[5], b[4] != "old text", "new") for b in rows.values()], "file string, so int, eo int, raw string, delete boolean, body string")
    got = S.apply_edits(files, edits).collect()
    assert [(r["file"], r["text"], r["edits"]) for r in got] == [("f.go", "a()\n// new\nb()\nc()\r\n", 3)]


def test_render():
    assert S.render("\t", "// x", "one two") == ["\t// one two"]
    assert S.render("", "/** x", "w " * 60, 60)[0] == "/**" and S.render("", "/** x", "w " * 60, 60)[-1] == " */"
    assert S.render("", "<!-- x", "short") == ["<!-- short -->"]
    assert all(len(r) <= 40 for r in S.render("", "# x", "word " * 30, 40))


def test_answers(spark):
    from pyspark.sql import functions as F

    rows = [("```go\n// Sorts rows\n// by key.\n```", "Sorts rows\nby key."), ('"Quoted"', "Quoted"), ('"a" and "b"', '"a" and "b"'), ("/** Doc */", "Doc */"), ("", "")]
    got = spark.createDataFrame(rows, "a string, want string").select(S.clean_answer(F.col("a")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_settings(tmp_path):
    from prosegauge.operators.reports import patch_settings

    assert Settings.parse({"comments": {"max_lines": 3}}).comments == {"max_lines": 3}
    for bad in ({"nope": 1}, {"comments": {"nope": 1}}, {"comments": {"max_line": -1}}, {"languages": {"only": ["cobol"]}}):
        with pytest.raises(SettingsError):
            Settings.parse(bad)
    (tmp_path / ".prosegauge.yaml").write_text("genre: code\n")
    (tmp_path / "a").mkdir()
    assert Settings.find(str(tmp_path / "a")).genre == "code"
    text = "version: 1\ncomments:\n  max_lines: 2 # why\nrules:\n  only: []\n"
    assert patch_settings(text, {"comments.max_lines": 4, "comments.max_line": 90, "genre": "code"}).count("\n") == text.count("\n") + 2
    assert "  max_lines: 4 # why" in patch_settings(text, {"comments.max_lines": 4})
