"""What the queries run on: the driver's tables, with snippets that rules and metrics have something to say on.

Every table is whole; snippets are added by id, with the same expression in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = [
    "В современном мире данные решают всё. Стоит отметить, что система является удобной. Она является быстрой! Почему? Потому что так…",
    "Это не просто удобство, а свобода выбора. Не только быстро, но и дёшево. Таким образом, решение готово.",
    "Отчёт за 2020–2024 годы – это важно. Путь от идеи до продукта прост — и от Москвы до Твери, от зари до зари.",
    "# Ранняя Жизнь и Образование Иванова\n\n- первый пункт\n- второй пункт\n- третий пункт\n* четвёртый пункт\n1. пятый пункт\n2) шестой пункт\n",
    "Осуществление реализации и внедрение оптимизации посредством взаимодействия. Значение решения в рамках функционирования.",
    "Очень хорoший день. Сегодня мы делали работу и писали отчёт без точки в конце строки",
    "In today's fast-paced world it is important to note that we delve into robust and seamless tools. Moreover, it's crucial.",
    "The plan serves as a guide. The plan serves as a map! Does the plan serve? (Yes.) It is not only quick but also cheap...",
    "Отличный вопрос! Давайте разберёмся. Конечно! Надеюсь это было полезно.",
    "Один два три. Один два три! Один два три? Один два три. Один два три; один два три.\n\nКонец абзаца.\n\nЕщё один.",
    "Играет ключевую роль в развитии. Подводя итог, данный подход в условиях рынка открывает новые горизонты.",
    "A short line.\n\nA second one, with a — dash.\n\nThird paragraph here. And more.\n\nFourth: x.\n\nFifth one.\n\nSixth, the last.",
    "---\ntitle: x\n---\nText with `code` and <b>tags</b>, a [link](http://a.example/b) and https://c.example/d?e=1 there.\n```\nblock — code\n```\n| a | b |\nimport x from y\n",
    "",
]

CODE = [
    "// set user name\nfunc setUserName(n string) {",
    "// TODO: handle errors\nreturn err",
    "// TODO(anna): handle errors, see #12\nreturn err",
    "// ==========\n// Section\nx := 1",
    "// if x > 0 {\n//   return x;\n// }\ny := 2",
    "/* Updated 2024-01-02 by the team\n * changed: v2.1 of the parser */\nvar p int",
    "// Step 1: read\n// Step 2: write\nrun()",
    "// # Heading\n// - one\n// - two\n// - three\n// - four\nload()",
    "/** Represents a row of the table. */\ntype Row struct {",
    "// конструктор\nnew()",
    "// This line is far too long for a comment, since it goes on and on about nothing in particular until it ends over here\nzzz()",
    "# SPDX-License-Identifier: MIT\nimport os",
    "// Делает одно\n// делает другое\n// и третье, как обычно\ndo()",
    "// eslint-disable-next-line\nq()",
    "// Error handling\nhandle()",
    "// reads the file\nreadFile(path)",
]

SUBJECTS = [
    "Update",
    "Add retry to upload",
    "Fix the parser.",
    "This commit adds a very long subject line that nobody is going to read to the end, we think\n\n- a\n- b\n- c\n- d\n- e",
    "wip",
    "Refactor loader\n\nCo-authored-by: Copilot <bot@example.org>",
    "Describe the cache\n\nThis change introduces a cache. It's fast.",
    "Drop the old index: it was never read",
]

PATHS = ["cmd/main.go", "web/app.ts", "web/app.test.ts", "node_modules/x/index.js", "lib/a.min.js", "src/View.svelte", "ios/App.swift", "core/Main.java", "core/Main.kt", "gen/x.pb.go", "docs/readme.md", "c/list.h", "c/list.cpp", ".cache/a.go", "types/a.d.ts", "svc/a_test.go"]


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(values: list[str], at: str) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + f"][({at} % {len(values)} + 1)::INT]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer partitions than there are: matching rules is all CPU.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source: documents, each with a snippet at its end."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.concat("text", F.lit("\n\n"), pick(SNIPPETS, F.col("doc_id"))).alias("text"), "lang", "source")


TEXTS = f"texts AS (SELECT doc_id, text || chr(10) || chr(10) || {sql_pick(SNIPPETS, 'doc_id')} AS text, lang, source FROM documents)"


def block_lines(turns: DataFrame) -> Column:
    """array: the lines of a turn's comment block, and the line of code below it.

    Every second turn has its whole text in the block.
    """
    code = F.split(pick(CODE, F.col("conv_id") * 3 + F.col("turn")), "\n", -1)
    said = F.split(F.concat(F.lit("// "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n// "))), "\n", -1)
    return F.when(F.pmod("turn", F.lit(2)) == 1, F.concat(F.slice(code, F.lit(1), F.size(code) - 1), said, F.slice(code, F.lit(-1), F.lit(1)))).otherwise(code)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, start, end, lines, raw, next: a comment block for each turn of a conversation, in a file for each conversation."""
    turns = spread(table(spark, sf_dir, "conversations"))
    turns = turns.withColumn("l", block_lines(turns))
    return turns.select(
        F.concat(F.lit("conv"), F.col("conv_id"), F.lit(".go")).alias("file"),
        (F.col("turn") * 10 + 1).cast("int").alias("start"),
        F.array_join(F.slice("l", F.lit(1), F.size("l") - 1), "\n").alias("raw"),
        F.element_at("l", -1).alias("next"),
        F.col("role").alias("role"),
    ).withColumn("lines", F.size(F.split("raw", "\n", -1))).withColumn("end", F.col("start") + F.col("lines") - 1)


BLOCKS = f"""bc AS (SELECT *, string_split({sql_pick(CODE, '(conv_id * 3 + turn)')}, chr(10)) AS c FROM conversations),
b0 AS (SELECT 'conv' || conv_id || '.go' AS file, (turn * 10 + 1)::INT AS start, role, CASE WHEN turn % 2 = 1 THEN list_concat(list_concat(c[1:len(c)-1], string_split('// ' || replace(coalesce(text, ''), chr(10), chr(10) || '// '), chr(10))), [c[len(c)]]) ELSE c END AS l FROM bc),
blocks AS (SELECT file, start, array_to_string(l[1:len(l)-1], chr(10)) AS raw, l[len(l)] AS next, role, (len(l) - 1)::INT AS lines, (start + len(l) - 2)::INT AS "end" FROM b0)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text: a commit message for each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("commit "), F.col("doc_id")).alias("file"), pick(SUBJECTS, F.col("doc_id")).alias("text"))


COMMITS = f"commits AS (SELECT 'commit ' || doc_id AS file, {sql_pick(SUBJECTS, 'doc_id')} AS text FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a source file for each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.col("source"), F.lit("/"), pick(PATHS, F.col("doc_id"))).alias("path"), "text", "doc_id")


FILES = f"files AS (SELECT source || '/' || {sql_pick(PATHS, 'doc_id')} AS path, text, doc_id FROM documents)"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text: a source file for each document, its whole text laid out as functions and blocks."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    unit = F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))

    def line(piece: Column, k: Column) -> Column:
        i = k + 1
        pad = F.repeat(F.lit(" "), unit * (1 + (i * i) % 6))
        named = lambda head, tail: F.concat(F.lit(head), i.cast("string"), F.lit(tail))
        return (
            F.when(i % 23 == 1, named("func f", "(a int, b string) {"))
            .when(i % 23 == 22, F.lit("}"))
            .when(i % 23 == 9, F.concat(F.repeat(F.lit(" "), unit), named("func inner", "() {")))
            .when(i % 23 == 15, F.lit(""))
            .when(i % 23 == 5, F.lit(")"))
            .when(i % 7 == 3, F.concat(pad, F.lit('if x && y == "a || b" {')))
            .when(i % 11 == 5, F.concat(pad, F.lit("// "), piece))
            .otherwise(F.concat(pad, piece))
        )

    pieces = F.transform(F.split("text", "[.,\n]", -1), lambda x: F.regexp_replace(x, r"[^\p{L}\p{Nd} ]|^ +| +$", ""))
    lang = pick(["go", "swift", "kotlin"], F.col("doc_id"))
    return docs.select("doc_id", lang.alias("lang"), F.array_join(F.transform(pieces, line), "\n").alias("text"))


_UNIT, _PAD = "[2, 4, 8][(doc_id % 3 + 1)::INT]", "repeat(' ', ([2, 4, 8][(doc_id % 3 + 1)::INT] * (1 + (i * i) % 6))::INT)"
CODE_FILES = f"""cf0 AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[.,\n]'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{Nd}} ]|^ +| +$', '', 'g')) AS p FROM documents),
cf1 AS (SELECT doc_id, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 23 = 1 THEN 'func f' || i || '(a int, b string) {{' WHEN i % 23 = 22 THEN '}}' WHEN i % 23 = 9 THEN repeat(' ', {_UNIT}) || 'func inner' || i || '() {{' WHEN i % 23 = 15 THEN ''
  WHEN i % 23 = 5 THEN ')' WHEN i % 7 = 3 THEN {_PAD} || 'if x && y == "a || b" {{' WHEN i % 11 = 5 THEN {_PAD} || '// ' || p[i] ELSE {_PAD} || p[i] END) AS l FROM cf0),
code_files AS (SELECT doc_id, {sql_pick(['go', 'swift', 'kotlin'], 'doc_id')} AS lang, array_to_string(l, chr(10)) AS text FROM cf1)"""
