"""Sources, function metrics, rescans and places, against plain versions."""

import subprocess

import pytest

from prosegauge.functions import text as T
from prosegauge.operators import blocks as B
from prosegauge.operators import comments, matching
from prosegauge.operators import relational as R
from prosegauge.operators import source_metrics as SM
from prosegauge.plans.ruleset import load_rules
from prosegauge.sources import readers
from prosegauge.streaming import rescan

GO = """package a

func one(a int, b string) int {
	if a > 0 && b != "x || y" {
		for i := range b {
			// if not counted
			use(i)
		}
	}
	return 1
}

func (s *S) two() {
}
	func three(x int) { return }
"""


def test_functions(spark):
    df = spark.createDataFrame([("a.go", GO), ("none", None), ("empty", ""), ("b", "no function\n  here")], "path string, text string")
    got = sorted(tuple(r) for r in SM.functions(df).collect())
    assert got == [("a.go", 3, "one", 2, 6, 4, 2), ("a.go", 13, "two", 0, 0, 1, 0), ("a.go", 15, "three", 0, 0, 1, 1)]


def test_function_within_a_function():
    text = "func a() {\n    x\n    func b() {\n        if y {\n)\n        }\n    }\n    z\n}\nfunc c() {"
    assert [(r[0], r[1], r[3]) for r in SM.functions_of(text)] == [(1, "a", 7), (10, "c", 0)]
    assert SM.step(["a", "  b", "    c", "a", "  b"]) == 2 and SM.step(["a", " b"]) == 4


def test_tree(spark, tmp_path):
    for name, text in (("a/b.go", "package b"), ("a/b.txt", "x"), ("node_modules/c.js", "y"), ("a/d.ts", "// Code generated by x. DO NOT EDIT\n"), (".git/e.go", "z"), ("f.py", "import os\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["text"] for r in readers.tree(spark, str(tmp_path)).collect()}
    assert got == {"a/b.go": "package b"} | ({"f.py": "import os\n"} if "f.py" in got else {})


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.go").write_text("one\n")
    (tmp_path / "b.go").write_text("same\n")
    git("add", "."), git("commit", "-qm", "First")
    (tmp_path / "a.go").write_text("two\n")
    (tmp_path / "c.go").write_text("new\n")
    git("add", "."), git("commit", "-qm", "Second")
    assert sorted(readers.git_files(str(tmp_path))) == ["a.go", "b.go", "c.go"]
    assert [r["text"] for r in readers.git_log(spark, str(tmp_path), 1).collect()] == ["Second"]
    assert [tuple(r) for r in readers.git_pairs(spark, str(tmp_path), "HEAD").collect()] == [("a.go", "one\n", "two\n")]


def test_edits_that_are_not_json(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"block": "a", "text": "x"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.edits(spark, str(tmp_path)).collect()


def test_version_file(spark):
    old = "head 1.2;\n1.2\nlog\n@n@\ntext\n@a@@b\n" + "x" * 300_000 + "@\n\n1.1\ntext\n@d1 1\n@\n"
    rows = spark.createDataFrame([(old,), ("nothing",)], "v string").select(readers.rcs_head("v").alias("h")).collect()
    assert [r["h"] for r in rows] == ["a@b\n" + "x" * 300_000, ""]


def test_rescan_stream(spark, tmp_path):
    text = "// First says\nx()\n\n// Second says\ny()\n"
    items = comments.extract_blocks(spark.createDataFrame([("a.go", text), ("b.go", text)], "path string, text string"))
    rescan.start(items.select("file", T.norm_hash(items["text"]).alias("hash"), "start", "end"), f"{tmp_path}/store")
    spark.createDataFrame([("a.go", "z()\n\n// First says\nx()\n\n// Else\n")], "path string, text string").write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema("path string, text string").parquet(f"{tmp_path}/in")
    rescan.follow(files, f"{tmp_path}/store", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["file"], r["start"], r["done"]) for r in rescan.items(spark, f"{tmp_path}/store", 0).collect())
    assert got == [("a.go", 3, False), ("a.go", 4, True), ("b.go", 1, False), ("b.go", 4, False)]


def test_rescan_takes_the_last_of_equal_blocks(spark):
    items = spark.createDataFrame([("a", "h", 1, 2)], "file string, hash string, start int, end int")
    now = spark.createDataFrame([("a", "h", 5, 6), ("a", "h", 9, 9)], "file string, hash string, start int, end int")
    assert [tuple(r) for r in R.rescan(items, now, now.select("file")).select("start", "end", "done").collect()] == [(9, 9, False)]


def test_lines_of_blocks(spark):
    raws = [("// one\n//\n// @tag x\n// two", "aa bb cc"), ("/** one\n * two\n *\n */", "a\n\nb " + "word " * 30), ("\t# x", ""), ("", "long" * 20)]
    df = spark.createDataFrame(raws, "raw string, body string")
    got = [tuple(r) for r in df.select(B.prose_lines(df["raw"]), B.rendered_lines(df["raw"], df["body"], 40)).collect()]

    def plain(raw, body):
        head = raw.split("\n")[0].lstrip(" \t")
        mark = " * " if head.startswith("/*") else "///" if head.startswith("///") else "#" if head.startswith("#") else "//"
        room = 40 - (len(raw.split("\n")[0]) - len(head) + len(mark) + 1)
        return sum(len(comments.wrap(p, room if room > 20 else 20)) for p in body.split("\n"))

    assert got == [(2, plain(*raws[0])), (2, plain(*raws[1])), (1, plain(*raws[2])), (0, plain(*raws[3]))]


def test_many_matches(spark):
    """Places of 20,000 matches in a text, and of markers in a block, in linear time."""
    n = 20_000
    text = "\n".join("x – y, \x01 a" for _ in range(n))
    found = matching.hits(spark.createDataFrame([(1, text)], "doc_id int, text string"), [r for r in load_rules("ru").rules if r.name == "En dash"])
    assert matching.with_lines(found).collect()[0]["lines"] == list(range(1, n + 1))
    todo = spark.createDataFrame([("«TODO\n" * n + "x\nTODO: y",), ('"TODO',), ("none",), ("a\nTODO b",)], "text string")
    assert [r[0] for r in todo.select(B.first_todo(todo["text"])).collect()] == [n + 1, None, None, 1]


def test_functions_in_small_batches(spark):
    own = spark.newSession()
    texts = ["func a() {\n  x\n}\nfunc b(y int) {\n  if y {\n    z\n  }\n}", None, "", "plain"]
    files = own.createDataFrame([(k, f"l{k % 3}", texts[k % 4]) for k in range(2500)], "doc_id long, lang string, text string").coalesce(1)
    got = SM.functions(files, ["doc_id", "lang"])
    assert got.columns == ["doc_id", "lang", *[c.split()[0] for c in SM.SCHEMA.split(", ")]]
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000 and int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    want = [(k, f"l{k % 3}", *f) for k in range(0, 2500, 4) for f in SM.functions_of(texts[0])]
    assert sorted(map(tuple, got.collect())) == want
