"""Queries over comment blocks, commits, source paths, snapshots, pairs and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.functions import text as T
from prosegauge.operators import blocks as B
from prosegauge.operators import matching
from prosegauge.operators import relational as R
from prosegauge.operators import source_metrics as SM
from prosegauge.plans import corpus as C
from prosegauge.plans.q_text import W, sql_count, sql_dense, sql_hits, sql_lines, sql_muted, sql_re, sql_trim
from prosegauge.plans.q_text import _hash as sql_hash
from prosegauge.plans.q_text import _share as sql_share
from prosegauge.plans.ruleset import RuleSet, load_rules
from prosegauge.sources import paths as P

Q, SQL = {}, {}


def blocks(s, d):
    """file, start, end, lines, raw, next, text, doc, role."""
    b = C.blocks(s, d)
    return b.withColumn("text", B.strip_markers(F.col("raw"))).withColumn("doc", B.is_doc(F.col("raw")))


def _strip(x: str) -> str:
    right = lambda s: f"regexp_replace({s}, '[ \\t]+$', '')"
    s = right(f"regexp_replace({x}, {sql_re(B.MARKER)}, '')")
    s = right(f"regexp_replace({s}, '\\*/$', '')")
    return right(f"regexp_replace({s}, '-->$', '')")


BL = (
    C.BLOCKS
    + f""",
bl0 AS (SELECT *, {sql_trim(f"array_to_string(list_transform(string_split(raw, chr(10)), lambda x: {_strip('x')}), chr(10))")} AS text, {sql_trim("string_split(raw, chr(10))[1]")} AS head FROM blocks),
bl AS (SELECT *, (prefix(head, '/**') OR prefix(head, '///')) AS doc FROM bl0)"""
)

Q["strip_markers"] = lambda s, d: blocks(s, d).select("file", "start", "text", "doc")
SQL["strip_markers"] = f"WITH {BL} SELECT file, start, text, doc FROM bl"
Q["block_hash"] = lambda s, d: blocks(s, d).select(B.block_id(F.col("file"), F.col("start"), F.col("end")).alias("id"), T.norm_hash(F.col("text")).alias("hash"), T.rule_code(F.col("role")).alias("code"))
_id = "CASE WHEN start = \"end\" OR \"end\" = 0 THEN file || ':' || start ELSE file || ':' || start || '-' || \"end\" END"
SQL["block_hash"] = f"WITH {BL} SELECT {_id} AS id, {sql_hash('text')} AS hash, substr(sha256(role), 1, 6) AS code FROM bl"

_prose = lambda x: f"({sql_trim(x)} <> '' AND NOT regexp_matches({x}, {sql_re(B.DOC_TAG)}))"
_L = "string_split(text, chr(10))"
_match = lambda x, p: f"regexp_matches({x}, {sql_re(p)})"


def shape(s, d):
    prose, longest = B.shape(F.col("text"))
    return blocks(s, d).select("file", "start", prose.alias("prose"), longest.alias("longest"))


Q["shape"] = shape
_SHAPE = f"shapes AS (SELECT *, len(list_filter({_L}, lambda x: {_prose('x')}))::INT AS prose, coalesce(list_max(list_transform(list_filter({_L}, lambda x: {_prose('x')} AND NOT {_match('x', B.LONG_TOKEN)}), lambda x: length(x))), 0)::INT AS longest FROM bl)"
SQL["shape"] = f"WITH {BL}, {_SHAPE} SELECT file, start, prose, longest FROM shapes"

Q["generic_predicates"] = lambda s, d: blocks(s, d).select("file", "start", B.ignored(F.col("text"), F.col("start"), F.col("lines")).alias("ignored"))
_ign = f"({_match('text', B.SPDX)} OR (start <= 5 AND lines >= 3 AND {_match('text', B.LICENSE)}) OR {_match('text', B.PRAGMA)} OR {_match('text', B.KEEP_TAG)})"
SQL["generic_predicates"] = f"WITH {BL} SELECT file, start, {_ign} AS ignored FROM bl"

Q["significant_words"] = lambda s, d: blocks(s, d).select("file", "start", F.array_join(B.significant_words(F.col("text")), " ").alias("words"))
_cstop = "[" + ", ".join(map(C.sql_text, T.COMMENT_STOPWORDS)) + "]"
_sig = f"list_filter(regexp_extract_all(lower(text), {sql_re(T.WORD)}), lambda w: length(w) >= 2 AND NOT list_contains({_cstop}, w))"
SQL["significant_words"] = f"WITH {BL} SELECT file, start, array_to_string({_sig}, ' ') AS words FROM bl"
Q["camel_split"] = lambda s, d: blocks(s, d).select("file", "start", F.array_join(B.identifier_parts(F.col("next")), " ").alias("parts"))
_parts = f"list_transform(flatten(list_transform(regexp_split_to_array(next, {sql_re(B.NOT_WORD)}), lambda t: regexp_extract_all(t, {sql_re(B.IDENTIFIER)}))), lambda p: lower(p))"
SQL["camel_split"] = f"WITH {BL} SELECT file, start, array_to_string({_parts}, ' ') AS parts FROM bl"
Q["restates"] = lambda s, d: blocks(s, d).select("file", "start", B.restates(F.col("text"), F.col("lines"), F.col("next")).alias("restates"))
_restates = f"(lines = 1 AND next <> '' AND len({_sig}) BETWEEN 2 AND 8 AND len(list_filter({_sig}, lambda w: list_contains({_parts}, w)))::DOUBLE / greatest(len({_sig}), 1) >= 0.8)"
SQL["restates"] = f"WITH {BL} SELECT file, start, {_restates} AS restates FROM bl"
Q["in_quotes"] = lambda s, d: C.texts(s, d).select("doc_id", B.in_quotes(F.substring_index("text", "the", 1)).alias("quoted"))
_tail = "regexp_extract(string_split(text, 'the')[1], '([^\\n]*)$', 1)"
_odd = lambda c: f"len(regexp_extract_all({_tail}, {C.sql_text(c)}))"
SQL["in_quotes"] = f"""WITH {C.TEXTS} SELECT doc_id, ({_odd('"')} % 2 = 1 OR {_odd('`')} % 2 = 1 OR {_odd('«')} > {_odd('»')}) AS quoted FROM texts"""
Q["excerpt"] = lambda s, d: C.texts(s, d).select("doc_id", T.excerpt(F.col("text"), F.pmod(F.col("doc_id"), F.lit(5)).cast("int")).alias("excerpt"))
_ex = "CASE WHEN doc_id % 5 BETWEEN 1 AND len(string_split(text, chr(10))) THEN (doc_id % 5)::INT ELSE 1 END"
_exl = sql_trim(f"string_split(text, chr(10))[{_ex}]")
SQL["excerpt"] = f"WITH {C.TEXTS}, e AS (SELECT doc_id, {_exl} AS s FROM texts) SELECT doc_id, CASE WHEN length(s) > 90 THEN substr(s, 1, 90) || '...' ELSE s END AS excerpt FROM e"
Q["doc_lead"] = lambda s, d: blocks(s, d).select("file", "start", B.doc_lead(F.col("text"), F.col("doc"), F.col("next")).alias("lead"))
SQL["doc_lead"] = f"WITH {BL} SELECT file, start, ({_match('text', B.COPULA_LEAD)} AND (doc OR (next <> '' AND contains(next, regexp_split_to_array(text, {sql_re(f'[{T.SPACE}]+')})[1])))) AS lead FROM bl"


def fence_for(s, d):
    runs = F.transform(F.regexp_extract_all("html", F.lit("`+"), F.lit(0)), F.length)
    return C.table(s, d, "pages").select("page_id", F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)).alias("fence"))


Q["fence_for"] = fence_for
SQL["fence_for"] = "SELECT page_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(html, '`+'), lambda x: length(x))), 0) + 1)::INT) AS fence FROM pages"

# --- findings ------------------------------------------------------------------

_live = lambda s, d: blocks(s, d).where(~B.ignored(F.col("text"), F.col("start"), F.col("lines")))
Q["struct_checks"] = lambda s, d: B.comment_findings(_live(s, d)).select("file", "start", "line", "rule")


def _first(condition: str) -> str:
    return f"list_min(list_filter(list_transform(range(1, len({_L}) + 1), lambda i: CASE WHEN {condition} THEN i - 1 END), lambda k: k IS NOT NULL))"


def _struct_sql() -> str:
    x = f"{_L}[i]"
    full = f"list_filter({_L}, lambda x: {sql_trim('x')} <> '')"
    code = f"len(list_filter({full}, lambda x: {_match('x', B.CODE_LINE)}))"
    nl = lambda e: f"(length({e}) - length(replace({e}, chr(10), '')))"
    tm, ts = f"regexp_extract_all(text, {sql_re(B.TODO)})", f"regexp_split_to_array(text, {sql_re(B.TODO)})"
    before = f"list_transform(range(1, len({tm}) + 1), lambda i: array_to_string(list_transform(range(1, i + 1), lambda j: {ts}[j] || CASE WHEN j < i THEN {tm}[j] ELSE '' END), ''))"
    tail = lambda b: f"regexp_extract({b}, '([^\\n]*)$', 1)"
    odd = lambda b, c: f"len(regexp_extract_all({tail(b)}, {C.sql_text(c)}))"
    quoted = lambda b: f"""({odd(b, '"')} % 2 = 1 OR {odd(b, '`')} % 2 = 1 OR {odd(b, '«')} > {odd(b, '»')})"""
    todo = f"list_filter({before}, lambda b: NOT {quoted('b')})[1]"
    change = f"regexp_split_to_array(text, {sql_re(B.CHANGELOG)})[1]"
    prose = f"len(list_filter({_L}, lambda x: {_prose('x')}))"
    checks = [
        ("Long comment", f"CASE WHEN {prose} > {B.MAX_LINES} AND NOT prefix(next, 'package ') THEN 0 END"),
        ("Long comment line", _first(f"{_prose(x)} AND NOT {_match(x, B.LONG_TOKEN)} AND length({x}) > {B.MAX_LINE}")),
        ("Separator banner", _first(_match(x, B.BANNER))),
        ("Commented-out code", f"CASE WHEN strlen({sql_trim('text')}) >= 15 AND NOT {_match('text', B.PROSE)} AND {code} >= 2 AND {code} * 2 >= len({full}) THEN 0 END"),
        ("TODO with no owner", f"CASE WHEN NOT {_match('text', B.OWNER)} THEN {nl(todo)} END"),
        ("Changelog in a comment", f"CASE WHEN {_match('text', B.CHANGELOG)} THEN {nl(change)} END"),
        ("Markdown essay in a comment", f"CASE WHEN {_match('text', B.HEADING)} OR {sql_count('text', B.BULLET)} >= 3 THEN 0 END"),
        ("Step-by-step instructions", f"CASE WHEN {sql_count('text', B.STEP)} >= 2 THEN 0 END"),
        ("Comment restates the code", f"CASE WHEN {_restates} THEN 0 END"),
    ]
    rows = " UNION ALL ".join(f"SELECT file, start, {C.sql_text(n)} AS rule, ({c})::INT AS pos FROM live" for n, c in checks)
    return f"live AS (SELECT * FROM bl WHERE NOT {_ign}), st0 AS ({rows}), struct AS (SELECT file, start, (start + pos)::INT AS line, rule FROM st0 WHERE pos IS NOT NULL)"


SQL["struct_checks"] = f"WITH {BL}, {_struct_sql()} SELECT file, start, line, rule FROM struct"

Q["commit_checks"] = lambda s, d: B.commit_findings(C.commits(s, d)).select("file", "rule")
_subject = sql_trim("string_split(text, chr(10))[1]")
_commit = [
    ("Long commit subject", f"length({_subject}) > {B.SUBJECT_LIMIT}"),
    ("Period at the end of the subject", f"suffix({_subject}, '.')"),
    ("Empty commit subject", _match(_subject, B.GENERIC_SUBJECT)),
    ("AI trailer in the commit", _match("text", B.AI_TRAILER)),
    ("This commit ...", _match("text", B.THIS_COMMIT)),
    ("Bullet wall in the commit", f"{sql_count('text', B.BULLET)} >= 5"),
]
SQL["commit_checks"] = f"WITH {C.COMMITS} " + " UNION ALL ".join(f"SELECT file, {C.sql_text(n)} AS rule FROM commits WHERE {c}" for n, c in _commit)


def _sets():
    return [("ru", T.language(F.col("text")) == "ru"), ("en", T.language(F.col("text")) == "en"), ("code", F.lit(True))]


def rule_findings(s, d):
    return B.rule_findings(_live(s, d), [(load_rules(n), where) for n, where in _sets()])


Q["rule_findings"] = rule_findings


def _rule_findings_sql() -> str:
    out, ctes = [], [BL, _struct_sql(), f"lang AS (SELECT *, row_number() OVER () AS doc_id, {sql_share} >= 0.3 AS ru, len({W}) AS words FROM live)"]
    for n, where in (("ru", "ru"), ("en", "NOT ru"), ("code", "true")):
        rs = load_rules(n)
        rules = [r for r in rs.rules if not rs.is_muted(r, "code")]
        part = RuleSet(n, {}, rs.freq_bans, tuple(rules), "")
        lines = sql_lines(rules, f"lang WHERE {where} AND").replace(f"FROM lang WHERE {where} AND WHERE", f"FROM lang WHERE {where} AND")
        for k in ("l0", "l1", "l2", "hits", "rules", "h0"):
            lines = lines.replace(f"{k} AS", f"{n}_{k} AS").replace(f"FROM {k}", f"FROM {n}_{k}")
        ctes.append(lines)
        rows = ", ".join(f"({C.sql_text(r.category)}, {C.sql_text(r.name)}, {r.lift}::DOUBLE, {r.hard}, {C.sql_text(r.fix)})" for r in rules)
        ctes.append(f"{n}_rules(category, rule, lift, hard, fix) AS (VALUES {rows})")
        ctes.append(f"{n}_n AS (SELECT doc_id, rule, count(*) AS n FROM {n}_l1 GROUP BY ALL)")
        out.append(f"SELECT file, start, (start + line - 1)::INT AS line, category, rule, lift, hard, fix FROM (SELECT DISTINCT doc_id, rule, line FROM {n}_l2) JOIN {n}_rules USING (rule) JOIN {n}_n USING (doc_id, rule) JOIN lang USING (doc_id) WHERE {sql_dense(part)}")
    return ", ".join(ctes) + f", rf AS ({' UNION ALL '.join(out)})"


SQL["rule_findings"] = f"WITH {_rule_findings_sql()} SELECT file, start, line, category, rule, lift, hard, fix FROM rf"


def findings(s, d):
    shape = B.comment_findings(_live(s, d)).select("file", "start", "line", "category", "rule", F.lit(0.0).alias("lift"), F.lit(False).alias("hard"), F.lit("").alias("fix"))
    return rule_findings(s, d).unionByName(shape)


_FIND = f"{_rule_findings_sql()}, fi AS (SELECT file, start, line, category, rule, lift, hard, fix FROM rf UNION ALL SELECT file, start, line, '{B.SHAPE}', rule, 0.0, false, '' FROM struct)"
Q["union_rule_layers"] = findings
SQL["union_rule_layers"] = f"WITH {_FIND} SELECT file, start, line, category, rule, lift, hard, fix FROM fi"

_weight = "(CASE WHEN lift > 1 THEN least(10, floor(lift + 0.5)::INT) ELSE 1 END * CASE WHEN hard THEN 3 ELSE 1 END)"
_ITEMS = f"{_FIND}, once AS (SELECT DISTINCT file, start, line, rule, category, lift, hard FROM fi), it AS (SELECT file, start, sum({_weight})::BIGINT AS score, count(*) AS n, bool_or(hard) AS hard FROM once GROUP BY 1, 2), items AS (SELECT {_id} AS id, {sql_hash('text')} AS hash, file, start, score, n, it.hard AS hard FROM it JOIN bl USING (file, start))"


def items(s, d):
    return B.items(blocks(s, d), findings(s, d))


Q["new_item"] = lambda s, d: items(s, d).select("id", "hash", "file", "start", "score", F.size("findings").cast("long").alias("n"), "hard")
SQL["new_item"] = f"WITH {_ITEMS} SELECT id, hash, file, start, score, n, hard FROM items"
Q["limit_items"] = lambda s, d: items(s, d).orderBy(F.col("score").desc(), "file", "start").limit(20).select("id", "score")
SQL["limit_items"] = f"WITH {_ITEMS} SELECT id, score FROM items ORDER BY score DESC, file, start LIMIT 20"
Q["sink_exit_code"] = lambda s, d: items(s, d).agg(F.max(F.col("hard").cast("int")).alias("code"), F.count("*").alias("blocks"))
SQL["sink_exit_code"] = f"WITH {_ITEMS} SELECT max(hard::INT)::INT AS code, count(*) AS blocks FROM items"
Q["code_report"] = lambda s, d: findings(s, d).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("hard").alias("hard")).orderBy(F.col("n").desc(), "rule")
SQL["code_report"] = f"WITH {_FIND} SELECT rule, count(*) AS n, count(*) FILTER (hard) AS hard FROM fi GROUP BY 1"
Q["sort_findings"] = lambda s, d: findings(s, d).withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line", "rule", "start"))).select("file", "place", "line", "rule")
SQL["sort_findings"] = f"WITH {_FIND} SELECT file, (row_number() OVER (PARTITION BY file ORDER BY line, rule, start))::INT AS place, line, rule FROM fi"
Q["finding_groups"] = lambda s, d: findings(s, d).groupBy("file", "start", "rule").agg(F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("lines"))
SQL["finding_groups"] = f"WITH {_FIND}, u AS (SELECT DISTINCT file, start, rule, line FROM fi) SELECT file, start, rule, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM u GROUP BY ALL"
Q["tree"] = lambda s, d: findings(s, d).select("rule", "file", "start").distinct().groupBy("rule", "file").agg(F.count("*").alias("blocks"))
SQL["tree"] = f"WITH {_FIND} SELECT rule, file, count(DISTINCT start) AS blocks FROM fi GROUP BY 1, 2"
Q["fix_auto"] = lambda s, d: blocks(s, d).join(findings(s, d).where(F.col("rule").isin(*B.DELETABLE) | F.col("category").isin(*B.DELETABLE)), ["file", "start"], "left_semi").select("file", "start", "end")
_del = ", ".join(map(C.sql_text, B.DELETABLE))
SQL["fix_auto"] = f'WITH {_FIND} SELECT file, start, "end" FROM bl WHERE (file, start) IN (SELECT (file, start) FROM fi WHERE rule IN ({_del}) OR category IN ({_del}))'
_deletable = lambda: F.col("rule").isin(*B.DELETABLE, "Separator banner") | F.col("category").isin(*B.DELETABLE)
Q["delete_or_rewrite"] = lambda s, d: findings(s, d).groupBy("file", "start").agg(F.min(F.when(_deletable(), 1).otherwise(0)).alias("delete"))
SQL["delete_or_rewrite"] = f"WITH {_FIND} SELECT file, start, min(CASE WHEN rule IN ({_del}, 'Separator banner') OR category IN ({_del}) THEN 1 ELSE 0 END)::INT AS delete FROM fi GROUP BY 1, 2"
Q["survey"] = lambda s, d: blocks(s, d).groupBy(F.col("role").alias("lang")).agg(F.count("*").alias("comments"), F.countDistinct("file").alias("files"))
SQL["survey"] = f"WITH {BL} SELECT role AS lang, count(*) AS comments, count(DISTINCT file) AS files FROM bl GROUP BY 1"

# --- joins and snapshots -----------------------------------------------------------

def _edited(s, d):
    """Items, the blocks that some of their files have now, and those files."""
    b = blocks(s, d)
    item = b.select("file", T.norm_hash(F.col("text")).alias("hash"), "start", "end")
    again = b.where("role = 'user' and start = 1 and length(file) % 2 = 0").select("file").distinct()
    now = item.join(again, "file", "left_semi").where("start % 4 <> 3").withColumn("start", F.col("start") + 3).withColumn("end", F.col("end") + 3)
    return item, now, again


_ranges = lambda s, d: C.table(s, d, "events").select(F.concat(F.lit("conv"), F.col("user_id"), F.lit(".go")).alias("file"), F.pmod(F.col("event_id"), F.lit(60)).cast("int").alias("from_line")).withColumn("to_line", F.col("from_line") + 2)
Q["rescan"] = lambda s, d: R.rescan(*_edited(s, d)).select("file", "hash", "start", "end", "done")
Q["touching"] = lambda s, d: R.touching(blocks(s, d), _ranges(s, d)).select("file", "start", "end")
_RANGES = "ranges AS (SELECT 'conv' || user_id || '.go' AS file, (event_id % 60)::INT AS from_line, (event_id % 60 + 2)::INT AS to_line FROM events)"
_EDITED = f"""{BL}, it AS (SELECT file, {sql_hash('text')} AS hash, start, "end" FROM bl), fs AS (SELECT DISTINCT file FROM bl WHERE role = 'user' AND start = 1 AND len(file) % 2 = 0),
nw AS (SELECT file, hash, start + 3 AS start, "end" + 3 AS "end" FROM it JOIN fs USING (file) WHERE start % 4 <> 3)"""
SQL["rescan"] = f"""WITH {_EDITED}, n AS (SELECT file, hash, max((start, "end")) AS s FROM nw GROUP BY 1, 2)
SELECT file, hash, coalesce(s[1], start)::INT AS start, coalesce(s[2], "end")::INT AS "end", fs.file IS NOT NULL AND s IS NULL AS done FROM it LEFT JOIN fs USING (file) LEFT JOIN n USING (file, hash)"""
SQL["touching"] = f'WITH {BL}, {_RANGES} SELECT file, start, "end" FROM bl WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.file = bl.file AND r.from_line <= bl."end" AND bl.start <= r.to_line)'
_hashed = lambda s, d: blocks(s, d).select("file", "start", T.norm_hash(F.col("text")).alias("hash"), "role", "text", "next")
_HASHED = f"{BL}, hashed AS (SELECT file, start, {sql_hash('text')} AS hash, role, text, next FROM bl)"
Q["text_copies"] = lambda s, d: R.copies(_hashed(s, d)).select("file", "start", "copies")
SQL["text_copies"] = f"WITH {_HASHED} SELECT file, start, count(*) OVER (PARTITION BY hash) AS copies FROM hashed"
Q["locate_all"] = lambda s, d: _hashed(s, d).join(_hashed(s, d).where("start = 1").select("hash").distinct(), "hash", "left_semi").select("hash", "file", "start")
SQL["locate_all"] = f"WITH {_HASHED} SELECT hash, file, start FROM hashed WHERE hash IN (SELECT hash FROM hashed WHERE start = 1)"
_found = lambda s, d: B.comment_findings(_live(s, d)).select("file", "start", "rule", T.norm_hash(F.col("text")).alias("hash"))
_known = lambda s, d: R.snapshot(_found(s, d).where("rule not in ('Separator banner', 'Step-by-step instructions')"))
_FOUND = f"{BL}, {_struct_sql()}, found AS (SELECT DISTINCT file, start, rule, {sql_hash('text')} AS hash FROM struct JOIN bl USING (file, start)), snap AS (SELECT DISTINCT hash, substr(sha256(rule), 1, 6) AS code FROM found), known AS (SELECT DISTINCT hash, substr(sha256(rule), 1, 6) AS code FROM found WHERE rule NOT IN ('Separator banner', 'Step-by-step instructions'))"
Q["baseline_write"] = lambda s, d: R.snapshot(_found(s, d))
SQL["baseline_write"] = f"WITH {_FOUND} SELECT hash, code FROM snap"
Q["baseline_new"] = lambda s, d: R.new_findings(_found(s, d).distinct(), _known(s, d)).select("file", "start", "rule")
SQL["baseline_new"] = f"WITH {_FOUND} SELECT file, start, rule FROM found WHERE (hash, substr(sha256(rule), 1, 6)) NOT IN (SELECT (hash, code) FROM known)"
Q["baseline_fixed"] = lambda s, d: R.fixed(_found(s, d).where("rule <> 'TODO with no owner'"), R.snapshot(_found(s, d)))
SQL["baseline_fixed"] = f"WITH {_FOUND} SELECT hash, code FROM snap EXCEPT SELECT hash, substr(sha256(rule), 1, 6) FROM found WHERE rule <> 'TODO with no owner'"
Q["baseline_add"] = lambda s, d: R.keep(_known(s, d), _found(s, d).where("rule = 'Separator banner'"))
SQL["baseline_add"] = f"WITH {_FOUND} SELECT hash, code FROM known UNION SELECT hash, substr(sha256(rule), 1, 6) FROM found WHERE rule = 'Separator banner'"
Q["sink_baseline"] = lambda s, d: R.snapshot_lines(R.snapshot(_found(s, d)))
SQL["sink_baseline"] = f"WITH {_FOUND} SELECT hash, hash || chr(9) || string_agg(code, chr(9) ORDER BY code) AS line FROM snap GROUP BY 1"
Q["baseline_load"] = lambda s, d: R.parse_snapshot(R.snapshot_lines(R.snapshot(_found(s, d))))
SQL["baseline_load"] = f"WITH {_FOUND} SELECT hash, code FROM snap"
_two = lambda s, d: (_hashed(s, d).where("role = 'user'"), _hashed(s, d).where("role <> 'user'"))
Q["pair_match"] = lambda s, d: R.pair_match(*_two(s, d)).select("file", "next", "place", "kind")
SQL["pair_match"] = f"""WITH {_HASHED}, o AS (SELECT file, next, text AS a, (row_number() OVER (PARTITION BY file, next ORDER BY start))::INT AS place FROM hashed WHERE role = 'user'),
n AS (SELECT file, next, text AS b, (row_number() OVER (PARTITION BY file, next ORDER BY start))::INT AS place FROM hashed WHERE role <> 'user')
SELECT file, next, place, CASE WHEN a IS NULL OR b IS NULL THEN 'lost' WHEN a = b THEN 'same' ELSE 'pair' END AS kind FROM o FULL JOIN n USING (file, next, place)"""
_spans = lambda s, d: blocks(s, d).select("file", (F.col("start") - F.pmod(F.col("start"), F.lit(3)) * 4).alias("start"), (F.col("end") + 5).alias("end"), (F.col("lines") != 2).alias("own_line"))
Q["merge_spans"] = lambda s, d: R.merge_spans(_spans(s, d))
SQL["merge_spans"] = f"""WITH {BL}, sp AS (SELECT file, (start - (start % 3) * 4)::INT AS start, ("end" + 5)::INT AS "end", lines <> 2 AS own_line FROM bl),
j AS (SELECT *, CASE WHEN own_line AND lag(own_line) OVER w AND start <= max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS brk FROM sp WINDOW w AS (PARTITION BY file ORDER BY start, "end")),
i AS (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM j)
SELECT file, min(start) AS start, max("end") AS "end", bool_and(own_line) AS own_line, count(*) AS spans FROM i GROUP BY file, island"""


def fix_batch(s, d):
    b = _hashed(s, d)
    edits = b.where("start <= 21").select("hash", F.when(F.col("role") == "user", F.col("file")).alias("file"), F.col("start").alias("place"), F.concat(F.lit("edit "), F.col("file"), F.lit(":"), F.col("start")).alias("action"), F.col("file").alias("f"))
    last = Window.partitionBy("hash", "file").orderBy(F.col("place").desc(), F.col("f").desc())
    edits = edits.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "f")
    return R.batch(b.select("hash", "file", "start"), edits).select("file", "start", "action")


Q["fix_batch"] = fix_batch
SQL["fix_batch"] = f"""WITH {_HASHED}, e0 AS (SELECT hash, CASE WHEN role = 'user' THEN file END AS file, start AS place, 'edit ' || file || ':' || start AS action, file AS f FROM hashed WHERE start <= 21),
e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY hash, file ORDER BY place DESC, f DESC) = 1)
SELECT h.file, h.start, coalesce(a.action, b.action) AS action FROM hashed h LEFT JOIN e a ON a.hash = h.hash AND a.file = h.file LEFT JOIN e b ON b.hash = h.hash AND b.file IS NULL WHERE coalesce(a.action, b.action) IS NOT NULL"""

_wild = lambda s, d: _hashed(s, d).where("start <= 21").select(F.when(F.col("start") == 11, F.concat(F.lit("no"), F.col("hash"))).otherwise(F.col("hash")).alias("hash"), F.when(F.col("role") == "user", F.concat(F.col("file"), F.when(F.col("start") == 1, F.lit(".old")).otherwise(F.lit("")))).alias("file"), F.col("start").alias("place"))
Q["fix_batch_lost"] = lambda s, d: R.lost_edits(_hashed(s, d), _wild(s, d)).select("hash", "file", "place")
SQL["fix_batch_lost"] = f"""WITH {_HASHED}, e AS (SELECT CASE WHEN start = 11 THEN 'no' || hash ELSE hash END AS hash, CASE WHEN role = 'user' THEN file || CASE WHEN start = 1 THEN '.old' ELSE '' END END AS file, start AS place FROM hashed WHERE start <= 21)
SELECT hash, file, place FROM e WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.hash = e.hash AND (e.file IS NULL OR h.file = e.file))"""

# --- functions of source ------------------------------------------------------------


def sql_functions() -> str:
    """functions: the same rows by joins of a file's lines with its signatures.

    A signature that stands within an earlier one's body is no function of its own.
    """
    note = " OR ".join(f"prefix(bare, '{x}')" for x in SM.NOTE)
    branches = f"len(regexp_extract_all(regexp_replace(l, {sql_re(SM.STRING)}, '\"\"', 'g'), {sql_re(SM.BRANCH)}))"
    lead = "regexp_extract(l, '^[ \\t]*')"
    given = f"regexp_extract(l, {sql_re(SM.PARAMETERS)}, 1)"
    steps = ", ".join(map(str, SM.STEPS))
    return f"""ln0 AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM code_files),
ln AS (SELECT *, {sql_trim('l')} AS bare, length({lead}) + {SM.TAB - 1} * (length({lead}) - length(replace({lead}, chr(9), ''))) AS ind FROM ln0),
gr AS (SELECT doc_id, i, ind - coalesce(lag(ind) OVER (PARTITION BY doc_id ORDER BY i), 0) AS g FROM ln WHERE bare <> ''),
un AS (SELECT doc_id, g AS unit FROM (SELECT doc_id, g, count(*) AS n, min(i) AS i FROM gr WHERE g IN ({steps}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
sg AS (SELECT doc_id, lang, i, l, ind AS base FROM ln WHERE regexp_matches(l, {sql_re(SM.SIGNATURE)})),
sp AS (SELECT s.doc_id, s.lang, s.i, s.l, s.base, coalesce(min(j.i), 1000000000) AS stop FROM sg s LEFT JOIN ln j ON j.doc_id = s.doc_id AND j.i > s.i AND j.bare <> '' AND j.ind <= s.base AND NOT regexp_matches(j.bare, '^[)\\]]') GROUP BY ALL),
own AS (SELECT * FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp b WHERE b.doc_id = a.doc_id AND b.i < a.i AND a.i < b.stop)),
bd AS (SELECT o.doc_id, o.i, count(*) AS sloc, max(ind) AS deep, sum(branches) AS branches FROM own o JOIN (SELECT doc_id, i, ind, {branches} AS branches FROM ln WHERE bare <> '' AND NOT ({note})) x ON x.doc_id = o.doc_id AND x.i > o.i AND x.i < o.stop GROUP BY 1, 2),
functions AS (SELECT o.doc_id, o.lang, o.i::INT AS line, regexp_extract(o.l, 'func\\s*(?:\\([^()]*\\)\\s*)?(\\w*)', 1) AS name, greatest(0, (greatest(base, coalesce(deep, 0)) - base) // coalesce(unit, {SM.STEP}) - 1)::INT AS depth, coalesce(sloc, 0)::INT AS sloc, (1 + coalesce(branches, 0))::INT AS cc,
  CASE WHEN {sql_trim(given)} = '' THEN 0 ELSE len(string_split({given}, ',')) END::INT AS params FROM own o LEFT JOIN bd USING (doc_id, i) LEFT JOIN un ON un.doc_id = o.doc_id)"""


# --- distributions -----------------------------------------------------------------

_values = lambda s, d: C.table(s, d, "documents").select(F.col("lang"), (F.length("text")).alias("value"))
Q["calibrate_percentiles"] = lambda s, d: R.percentiles(_values(s, d), [50, 90, 95, 99], ["lang"])
SQL["calibrate_percentiles"] = """WITH v AS (SELECT lang, length(text) AS value, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), p(p) AS (VALUES (50), (90), (95), (99))
SELECT lang, p, value::INT AS value FROM v, p WHERE i = least(n * p // 100, n - 1)"""
_prose_values = lambda s, d: shape(s, d).select(F.col("prose").alias("value")).where("value > 0")
Q["calibrate_hist"] = lambda s, d: R.histogram(_prose_values(s, d), [1, 2, 3, 5, 10, 20])
SQL["calibrate_hist"] = f"WITH {BL}, {_SHAPE} SELECT CASE WHEN prose <= 1 THEN '1' WHEN prose <= 2 THEN '2' WHEN prose <= 3 THEN '3' WHEN prose <= 5 THEN '4-5' WHEN prose <= 10 THEN '6-10' WHEN prose <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n FROM shapes WHERE prose > 0 GROUP BY 1"
Q["calibrate_cost"] = lambda s, d: R.cost(shape(s, d).select(F.col("longest").alias("value")), [60, 80, 100, 120, 160])
SQL["calibrate_cost"] = f"WITH {BL}, {_SHAPE}, l(lim) AS (VALUES (60), (80), (100), (120), (160)) SELECT lim AS \"limit\", count(*) FILTER (longest > lim) AS over, count(*) FILTER (longest > lim) * 100.0::DOUBLE / count(*) AS share FROM shapes, l GROUP BY lim"
Q["calibrate_suggest"] = lambda s, d: R.percentiles(_prose_values(s, d), [90]).select(F.lit("max_lines").alias("name"), "value").unionByName(R.percentiles(shape(s, d).select(F.col("longest").alias("value")), [95]).select(F.lit("max_line").alias("name"), "value"))
SQL["calibrate_suggest"] = f"""WITH {BL}, {_SHAPE}, a AS (SELECT prose AS v, row_number() OVER (ORDER BY prose) - 1 AS i, count(*) OVER () AS n FROM shapes WHERE prose > 0), b AS (SELECT longest AS v, row_number() OVER (ORDER BY longest) - 1 AS i, count(*) OVER () AS n FROM shapes)
SELECT 'max_lines' AS name, v AS value FROM a WHERE i = least(n * 90 // 100, n - 1) UNION ALL SELECT 'max_line', v FROM b WHERE i = least(n * 95 // 100, n - 1)"""

Q["clones"] = lambda s, d: R.clones(C.table(s, d, "documents").select(F.col("doc_id").alias("key"), "text"))
_cl = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')}), lambda x: length(x) > 3)"
SQL["clones"] = f"""WITH f AS (SELECT doc_id AS key, {_cl} AS l FROM documents),
w AS (SELECT key, unnest(range(1, len(l) - 3)) AS pos, l FROM f WHERE len(l) >= 5), h AS (SELECT key, pos, sha1(array_to_string(l[pos:pos+4], chr(10))) AS h FROM w),
s AS (SELECT key, pos FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY key, pos) > 1),
m AS (SELECT key, count(DISTINCT line) AS marked FROM (SELECT key, unnest(range(pos, pos + 5)) AS line FROM s) GROUP BY 1)
SELECT key, len(l)::BIGINT AS loc, coalesce(marked, 0)::BIGINT AS marked FROM f LEFT JOIN m USING (key)"""

# functions of source files: depth, lines and branches by indentation
_metrics = lambda s, d: SM.functions(C.code_files(s, d), ["doc_id", "lang"]).where("sloc > 0")
_METRICS = f"{C.CODE_FILES}, {sql_functions()}, m AS (SELECT * FROM functions WHERE sloc > 0)"
Q["functions"] = lambda s, d: SM.functions(C.code_files(s, d), ["doc_id", "lang"])
SQL["functions"] = f"WITH {C.CODE_FILES}, {sql_functions()} SELECT doc_id, lang, line, name, depth, sloc, cc, params FROM functions"
Q["heaviest_functions"] = lambda s, d: SM.heaviest(_metrics(s, d), ["lang"]).select("lang", "place", "doc_id", "line", "cc", "sloc")
SQL["heaviest_functions"] = f"WITH {_METRICS} SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY cc * sloc DESC, doc_id, line))::INT AS place, doc_id, line, cc, sloc FROM m QUALIFY place <= 6"
_pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
Q["function_stats"] = lambda s, d: _metrics(s, d).groupBy("lang").agg(F.count("*").alias("functions"), _pct(F.col("cc") > 10).alias("cc_gt10"), _pct(F.col("depth") > 4).alias("depth_gt4"), _pct(F.col("sloc") > 60).alias("sloc_gt60"), _pct(F.col("sloc") <= 3).alias("tiny3"), _pct(F.col("sloc") <= 6).alias("tiny6"), F.count_if((F.col("cc") > 10) & (F.col("depth") > 4)).alias("both"), F.count_if((F.col("cc") > 10) & (F.col("depth") <= 4)).alias("cc_only"), F.count_if((F.col("cc") <= 10) & (F.col("depth") > 4)).alias("depth_only"))
SQL["function_stats"] = f"WITH {_METRICS} SELECT lang, count(*) AS functions, avg(CASE WHEN cc > 10 THEN 100.0::DOUBLE ELSE 0 END) AS cc_gt10, avg(CASE WHEN depth > 4 THEN 100.0::DOUBLE ELSE 0 END) AS depth_gt4, avg(CASE WHEN sloc > 60 THEN 100.0::DOUBLE ELSE 0 END) AS sloc_gt60, avg(CASE WHEN sloc <= 3 THEN 100.0::DOUBLE ELSE 0 END) AS tiny3, avg(CASE WHEN sloc <= 6 THEN 100.0::DOUBLE ELSE 0 END) AS tiny6, count(*) FILTER (cc > 10 AND depth > 4) AS both, count(*) FILTER (cc > 10 AND depth <= 4) AS cc_only, count(*) FILTER (cc <= 10 AND depth > 4) AS depth_only FROM m GROUP BY 1"
Q["function_percentiles"] = lambda s, d: R.percentiles(_metrics(s, d).select("lang", F.col("sloc").alias("value")), [50, 90, 95, 99], ["lang"])
SQL["function_percentiles"] = f"WITH {_METRICS}, v AS (SELECT lang, sloc AS value, row_number() OVER (PARTITION BY lang ORDER BY sloc) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM m), p(p) AS (VALUES (50), (90), (95), (99)) SELECT lang, p, value FROM v, p WHERE i = least(n * p // 100, n - 1)"
Q["erosion"] = lambda s, d: _metrics(s, d).groupBy("lang").agg((F.sum(F.when(F.col("cc") > 10, F.col("cc") * F.col("sloc")).otherwise(0)) / F.sum(F.col("cc") * F.col("sloc"))).alias("erosion"))
SQL["erosion"] = f"WITH {_METRICS} SELECT lang, sum(CASE WHEN cc > 10 THEN cc * sloc ELSE 0 END)::DOUBLE / sum(cc * sloc) AS erosion FROM m GROUP BY 1"

# --- lift ---------------------------------------------------------------------------


def _sides(s, d):
    """Texts that labels call good or not, as the two sides."""
    labels = C.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "ai").otherwise("human").alias("side"))
    return C.texts(s, d).join(labels, "doc_id")


def lift(s, d):
    rs = load_rules("ru")
    texts = _sides(s, d)
    sides = texts.groupBy("side").agg(F.sum(T.count_words(F.col("text"))).alias("words"), F.count("*").alias("docs"))
    return R.lift(matching.hits(texts, list(rs.rules), key=["doc_id", "side"]), sides, 5)


Q["lift"] = lift
SQL["lift"] = f"""WITH {C.TEXTS}, sd AS (SELECT texts.doc_id, text, CASE WHEN quality = 0 THEN 'ai' ELSE 'human' END AS side FROM texts JOIN labels USING (doc_id)), {sql_hits(load_rules('ru'), 'sd')},
w AS (SELECT coalesce(sum(len({W})) FILTER (side = 'ai'), 0) AS aw, coalesce(sum(len({W})) FILTER (side = 'human'), 0) AS hw, count(*) FILTER (side = 'human') AS hd FROM sd),
n AS (SELECT doc_id, n, unnest(CASE WHEN hard THEN [rule] ELSE [rule, '[' || category || ']'] END) AS name FROM hits JOIN rules USING (rule_no)),
g AS (SELECT name, coalesce(sum(n) FILTER (side = 'ai'), 0)::BIGINT AS ai_hits, coalesce(sum(n) FILTER (side = 'human'), 0)::BIGINT AS human_hits, count(DISTINCT CASE WHEN side = 'human' THEN doc_id END) AS docs FROM n JOIN (SELECT doc_id, side FROM sd) USING (doc_id) GROUP BY 1)
SELECT name, ai_hits, human_hits, ai_hits * 100000.0::DOUBLE / greatest(aw, 1) AS ai_rate, human_hits * 100000.0::DOUBLE / greatest(hw, 1) AS human_rate,
  CASE WHEN human_hits > 0 THEN (ai_hits * 100000.0::DOUBLE / greatest(aw, 1)) / (human_hits * 100000.0::DOUBLE / greatest(hw, 1)) END AS lift, docs * 100.0::DOUBLE / greatest(hd, 1) AS human_share FROM g, w WHERE ai_hits + human_hits >= 5"""
Q["model_counts"] = lambda s, d: C.table(s, d, "documents").groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "model").limit(6)
SQL["model_counts"] = "SELECT source AS model, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, model LIMIT 6"

# --- paths and listings ---------------------------------------------------------------

Q["fn_lang_of"] = lambda s, d: C.files(s, d).select("doc_id", P.lang_of(F.col("path")).alias("lang"))
_ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_case = "CASE " + " ".join(f"WHEN {_ext} IN ({', '.join(map(C.sql_text, e))}) THEN '{n}'" for n, e in P.LANGUAGES.items()) + " ELSE '' END"
SQL["fn_lang_of"] = f"WITH {C.FILES} SELECT doc_id, {_case} AS lang FROM files"
Q["src_skipdirs"] = lambda s, d: C.files(s, d).where(~P.skipped(F.col("path"))).select("doc_id", "path")
_dirs = ", ".join(map(C.sql_text, P.SKIP_DIRS))
SQL["src_skipdirs"] = f"WITH {C.FILES} SELECT doc_id, path FROM files WHERE len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ({_dirs}) OR (prefix(x, '.') AND x <> '.'))) = 0"
Q["pred_allow"] = lambda s, d: C.files(s, d).where(P.allowed(F.col("path"), skip_tests=True, ignore=["swift"], exclude=["src3/**", "*.h"])).select("doc_id", "path")
_name = "regexp_extract(path, '([^/]*)$', 1)"
SQL["pred_allow"] = f"WITH {C.FILES} SELECT doc_id, path FROM files WHERE {_case} NOT IN ('', 'swift') AND NOT regexp_matches({_name}, '(\\.d\\.ts|\\.pb\\.go|\\.min\\.js|\\.bundle\\.js)$') AND NOT (suffix({_name}, '_test.go') OR contains({_name}, '.test.') OR contains({_name}, '.spec.')) AND NOT regexp_matches(path, '^src3/.*$') AND NOT regexp_matches(path, '^[^/]*\\.h$') AND NOT regexp_matches({_name}, '^[^/]*\\.h$')"
Q["fn_glob_to_regex"] = lambda s, d: C.files(s, d).where(P.glob_match(F.col("path"), "**/*.t?")).select("doc_id")
SQL["fn_glob_to_regex"] = f"WITH {C.FILES} SELECT doc_id FROM files WHERE regexp_matches(path, '^(?:.*/)?[^/]*\\.t[^/]$') OR regexp_matches({_name}, '^(?:.*/)?[^/]*\\.t[^/]$')"
_gen = lambda s, d: C.files(s, d).select("doc_id", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("// Code generated by x. DO NOT EDIT\n"), F.col("text"))).when(F.pmod("doc_id", F.lit(7)) == 1, F.concat(F.col("text"), F.lit("\n//# sourceMappingURL=a.map"))).otherwise(F.col("text")).alias("text"))
Q["pred_generated"] = lambda s, d: _gen(s, d).select("doc_id", P.generated(F.col("text")).alias("generated"))
SQL["pred_generated"] = f"WITH g AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '// Code generated by x. DO NOT EDIT' || chr(10) || text WHEN 1 THEN text || chr(10) || '//# sourceMappingURL=a.map' ELSE text END AS text FROM documents) SELECT doc_id, doc_id % 7 IN (0, 1) OR regexp_matches(substr(text, 1, 2000), {sql_re(P.GENERATED)}) AS generated FROM g"


def git_log(s, d):
    docs = C.table(s, d, "documents")
    log = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), C.pick(C.SUBJECTS, F.col("doc_id")), F.lit("\x1fbody\n\x1e\n")).alias("log"))
    return P.parse_log(log, "log").select("file", "text")


Q["src_git_log"] = git_log
SQL["src_git_log"] = f"SELECT 'commit ' || doc_id AS file, {C.sql_pick(C.SUBJECTS, 'doc_id')} || chr(10) || chr(10) || 'body' AS text FROM documents"


def git_diff(s, d):
    ev = C.table(s, d, "events")
    e = F.col("event_id")
    hunk = F.concat(F.lit("@@ -1 +"), (e + 1).cast("string"), F.when(e % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), (e % 3 - 1).cast("string"))), F.lit(" @@ f\n+x"))
    diff = ev.select("user_id", hunk.alias("diff"))
    return P.parse_hunks(diff, "diff").select("user_id", "from_line", "to_line")


Q["src_git_diff"] = git_diff
SQL["src_git_diff"] = "SELECT user_id, (event_id + 1)::INT AS from_line, (event_id + 1)::INT AS to_line FROM events WHERE event_id % 3 <> 1"
