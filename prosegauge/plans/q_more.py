"""Queries of the scanner, edits, the hook and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import blocks as B
from prosegauge.operators import comments, matching, metrics, reports, scoring
from prosegauge.operators import relational as R
from prosegauge.plans import corpus as C
from prosegauge.plans import q_blocks, q_text
from prosegauge.plans.ruleset import RuleSet, allowed, load_rules
from prosegauge.sources import paths as P
from prosegauge.sources import readers
from prosegauge.sources.work import work_folder
from prosegauge.streaming import hook

Q, SQL = {}, {}


def sources(s, d):
    """path, text: a source file for each conversation, a block and code for each turn."""
    turns = C.table(s, d, "conversations")
    code = F.array_join(C.block_lines(turns), "\n")
    rows = turns.select("conv_id", F.struct("turn", F.concat(code, F.lit("\n\n")).alias("code")).alias("x"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(F.concat(F.lit("conv"), F.col("conv_id"), F.lit(".go")).alias("path"), F.array_join(F.transform("x", lambda x: x["code"]), "").alias("text"))


Q["extract_comments"] = lambda s, d: comments.extract_blocks(sources(s, d)).drop("so", "eo")


def fix_apply(s, d):
    """Every banner and commented-out block is deleted, every claim without an owner rewritten."""
    files = sources(s, d)
    found = comments.extract_blocks(files)
    bad = B.comment_findings(found).where(F.col("rule").isin("Separator banner", "Commented-out code", "TODO with no owner"))
    once = bad.groupBy("file", "so", "eo", "raw").agg(F.min(F.col("rule") != "TODO with no owner").alias("delete"))
    edits = once.withColumn("body", F.lit("TODO(owner): say what is to be done"))
    return comments.apply_edits(files.withColumnRenamed("path", "file"), edits)


Q["fix_apply"] = fix_apply


def _shown(blocks):
    """session, file, start, hash, score: a finding for each block, as an editor's session would report it."""
    return blocks.select(F.col("role").alias("session"), F.lit("all.go").alias("file"), "start", T.norm_hash(F.col("text")).alias("hash"), F.length("text").cast("long").alias("score"))


Q["unseen"] = lambda s, d: hook.unseen_batch(_shown(q_blocks.blocks(s, d)))
SQL["unseen"] = f"""WITH {q_blocks.BL}, f AS (SELECT role AS session, 'all.go' AS file, start, {q_text._hash('text')} AS hash, length(text)::BIGINT AS score FROM bl),
o AS (SELECT session, file, hash, max(score) AS score, min(start) AS s FROM f GROUP BY 1, 2, 3)
SELECT session, file, hash, score, (row_number() OVER (PARTITION BY session, file ORDER BY score DESC, s, hash))::INT AS place FROM o QUALIFY place <= 5"""


def hook_stream(s, d):
    """The hook over conversations as a stream, run to its end."""
    folder = work_folder(s)
    schema = C.table(s, d, "conversations").schema
    turns = s.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    code = C.block_lines(turns)
    text = B.strip_markers(F.array_join(F.slice(code, F.lit(1), F.size(code) - 1), "\n"))
    rows = turns.select(F.col("role").alias("session"), F.lit("all.go").alias("file"), (F.col("turn") * 10 + 1).cast("int").alias("start"), T.norm_hash(text).alias("hash"), F.length(text).cast("long").alias("score"))
    query = hook.unseen(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(hook.OUT).parquet(f"{folder}/out")


Q["hook_stream"] = hook_stream

_ru = load_rules("ru")
_score = lambda s, d: scoring.score(C.texts(s, d), _ru)
Q["sink_quiet"] = lambda s, d: _score(s, d).select("doc_id", reports.quiet(F.concat(F.lit("doc"), F.col("doc_id"))).alias("line"))
Q["sink_text_report"] = lambda s, d: reports.penalty_lines(_score(s, d))
Q["sink_jsonl"] = lambda s, d: q_blocks.items(s, d).select("id", F.to_json(F.struct("id", "hash", "file", "start", "end", P.lang_of(F.col("file")).alias("lang"), F.lit("comment").alias("kind"), "score", "raw", "findings")).alias("json"))
Q["sink_md"] = lambda s, d: reports.markdown(q_blocks.items(s, d), P.lang_of(F.col("file")))
Q["sink_findings_json"] = lambda s, d: reports.findings_json(q_blocks.items(s, d))
_NOTE = " Is this still true? "
Q["sink_todo"] = lambda s, d: reports.todo(q_blocks.items(s, d), F.lit(_NOTE))
# every item with its findings as a sorted list; the language of the files is that of their suffix, .go
_sample = q_text.sql_trim("string_split(text, chr(10))[CASE WHEN line - start + 1 BETWEEN 1 AND len(string_split(text, chr(10))) THEN line - start + 1 ELSE 1 END]")
_FULL = f"""{q_blocks._FIND}, fo AS (SELECT DISTINCT file, start, line, rule, category, hard, lift, fix FROM fi),
fs AS (SELECT fo.*, {_sample} AS s0 FROM fo JOIN bl USING (file, start)),
ff AS (SELECT * EXCLUDE (s0), CASE WHEN length(s0) > 90 THEN substr(s0, 1, 90) || '...' ELSE s0 END AS sample FROM fs),
fa AS (SELECT file, start, list_sort(list({{'line': line, 'rule': rule, 'category': category, 'hard': hard, 'lift': lift::DOUBLE, 'fix': fix, 'sample': sample}})) AS findings, sum({q_blocks._weight})::BIGINT AS score FROM ff GROUP BY 1, 2),
full_items AS (SELECT {q_blocks._id} AS id, {q_text._hash('text')} AS hash, file, start, "end", 'go' AS lang, 'comment' AS kind, score, raw, findings FROM fa JOIN bl USING (file, start))"""
SQL["sink_jsonl"] = f"""WITH {_FULL} SELECT id, to_json({{'id': id, 'hash': hash, 'file': file, 'start': start, 'end': "end", 'lang': lang, 'kind': kind, 'score': score, 'raw': raw, 'findings': findings}})::VARCHAR AS json FROM full_items"""
SQL["sink_findings_json"] = f"""WITH {_FULL}, e AS (SELECT id, file, unnest(findings) AS f, unnest(range(0, len(findings)))::INT AS place FROM full_items),
j AS (SELECT id, place, '{{"file":' || to_json(file) || CASE WHEN f.category <> '' THEN ',"category":' || to_json(f.category) ELSE '' END || ',"line":' || f.line || ',"rule":' || to_json(f.rule) || CASE WHEN f.fix <> '' THEN ',"fix":' || to_json(f.fix) ELSE '' END
  || CASE WHEN f.sample <> '' THEN ',"sample":' || to_json(f.sample) ELSE '' END || CASE WHEN f.lift <> 0 THEN ',"lift":' || to_json(f.lift) ELSE '' END || ',"hard":' || f.hard || '}}' AS json FROM e)
SELECT id, place, json FROM j"""
_gone = "(" + ", ".join(map(C.sql_text, B.GONE)) + ")"
_fence = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(raw, '`+'), lambda x: length(x))), 0) + 1)::INT)"
SQL["sink_md"] = f"""WITH {_FULL}, e AS (SELECT id, unnest(findings) AS f, unnest(range(0, len(findings))) AS k FROM full_items),
g AS (SELECT id, f.rule AS rule, min(k) AS k, string_agg(f.line::VARCHAR, ', ' ORDER BY k) AS lines, arg_min(f.hard, k) AS hard, arg_min(f.fix, k) AS fix FROM e GROUP BY 1, 2),
t AS (SELECT id, string_agg('- **' || rule || '** (' || CASE WHEN hard THEN 'hard, ' ELSE '' END || 'line ' || lines || ')' || CASE WHEN fix = '' THEN '' ELSE ' - ' || fix END || chr(10), '' ORDER BY k) AS said FROM g GROUP BY 1),
c AS (SELECT *, count(*) OVER (PARTITION BY hash) AS copies, {_fence} AS fence, len(list_filter(findings, lambda f: f.rule NOT IN {_gone} AND f.category NOT IN {_gone})) = 0 AS gone FROM full_items)
SELECT id, '## ' || id || chr(10) || 'block ' || hash || ' | `' || lang || '` | ' || kind || ' | weight ' || score || CASE WHEN copies > 1 THEN ' | text copies: ' || copies ELSE '' END || chr(10) || chr(10) || said || chr(10) || fence || chr(10) || raw || chr(10) || fence || chr(10) || chr(10)
  || '```bash' || chr(10) || 'prosegauge fix --block ' || hash || ' ' || CASE WHEN gone THEN '--delete' ELSE '--text "<new text>"' END || ' --write "' || file || '"' || chr(10) || '```' || chr(10) || chr(10) AS md FROM c JOIN t USING (id)"""
_quoted = f"array_to_string(list_transform(string_split(regexp_replace(raw, '\n+$', ''), chr(10)), lambda x: '  > ' || {q_text.sql_trim('x')} || chr(10)), '')"
SQL["sink_todo"] = f"""WITH {_FULL} SELECT id, chr(10) || '- [ ] `' || file || ':' || start || '` ' || {C.sql_text(_NOTE.strip())} || chr(10) || '  - rules: ' || array_to_string(list_transform(findings, lambda f: f.rule), ', ') || chr(10) || {_quoted} AS todo FROM full_items"""
Q["prose_lines"] = lambda s, d: q_blocks.blocks(s, d).select("file", "start", B.prose_lines(F.col("raw")).alias("lines"), B.rendered_lines(F.col("raw"), F.col("text"), 40).alias("rendered"))
Q["marker_verdict"] = lambda s, d: reports.verdict(_score(s, d))
_body = q_text.SQL["score"].rsplit("SELECT doc_id, words", 1)[0]
SQL["marker_verdict"] = _body + """SELECT doc_id, CASE WHEN copy_paste > 0 THEN 'chatbot copy-paste artifacts - text pasted from an AI reply' WHEN soft = 0 THEN '0 - none'
  ELSE soft || ' (' || printf('%.1f', CASE WHEN words = 0 THEN 0.0 ELSE soft::DOUBLE / words * 100 END) || ' per 100 words) - ' || CASE WHEN soft::DOUBLE / words * 100 < 1.0 THEN 'within normal range' WHEN soft::DOUBLE / words * 100 < 3.0 THEN 'density is elevated, worth a look' ELSE 'density is high, text needs editing' END END AS verdict FROM z"""
_band = f"CASE WHEN score >= {_ru.thresholds['band_clean']} THEN 'clean' WHEN score >= {_ru.thresholds['band_edit']} THEN 'edit' ELSE 'rewrite' END"
SQL["sink_quiet"] = _body + f"""SELECT doc_id, rpad('doc' || doc_id, 40, ' ') || ' ' || lpad(score::VARCHAR, 3, ' ') || '/100 [' || {_band} || '] bans: ' || other_bans || ' (+' || dash_bans || ' dashes), markers: ' || printf('%.1f', (soft + copy_paste) * 100.0::DOUBLE / greatest(words, 1)) || '/100 words' AS line FROM z"""
_lines = [("p_bans", "hard bans (phrases)"), ("p_copy", "copy-paste artifacts"), ("p_soft", "markers"), ("p_dash", "dashes"), ("p_rhythm", "flat rhythm"), ("p_nominal", "nominalization"), ("p_paragraphs", "flat paragraphs"), ("p_listicle", "listicle")]
SQL["sink_text_report"] = _body + "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN {C.sql_text(n)} || ': -' || {c} END" for c, n in _lines) + "], lambda x: x IS NOT NULL), chr(10)) AS lines FROM z"
_REPORT = [*q_text._RH[1:], "nominalizations", "verb_forms", "nominal_per_100", *q_text._ST, "not_russian", "phrase_bans", "dash_bans", "other_bans", "copy_paste", "soft", "muted_bans", "muted_markers", *[c for c, _ in _lines], "score", "band", "sterile_share"]
_more = {"not_russian": f"{q_text._share} < 0.3", "band": _band, "sterile_share": "CASE WHEN phrase_bans = 0 AND copy_paste = 0 AND soft = 0 AND words >= 100 THEN CASE WHEN words < 200 THEN 21.0 ELSE 15.1 END ELSE 0.0 END::DOUBLE"}
Q["sink_json"] = lambda s, d: reports.report_json(_score(s, d).select("doc_id", *_REPORT))
SQL["sink_json"] = _body + "SELECT doc_id, to_json({" + ", ".join(f"'{c}': {_more.get(c, c)}" for c in _REPORT) + "})::VARCHAR AS json FROM z"
SQL["hook_stream"] = SQL["unseen"]

_ANSWERS = ["```go\n// Sorts rows\n// by key.\n```", '"A quoted answer"', "/** Doc text */", "* one\n* two\n\n", "plain", '"a" and "b"', "# heading\n", ""]
Q["clean_llm_answer"] = lambda s, d: C.table(s, d, "documents").select("doc_id", comments.clean_answer(C.pick(_ANSWERS, F.col("doc_id"))).alias("answer"))
_t = q_text.sql_trim
_marks = "^(?:/\\*\\*|\\*/|///|//|/\\*|#|\\*)"
SQL["clean_llm_answer"] = f"""WITH a AS (SELECT doc_id, {_t(C.sql_pick(_ANSWERS, 'doc_id'))} AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN prefix(t, '```') THEN {_t(f"regexp_replace({_t("regexp_replace(t, '^[^\n]*\n', '')")}, '```$', '')")} ELSE t END AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_t(f"regexp_replace({_t('x')}, '{_marks}', '')")}), lambda x: x <> ''), chr(10)) AS t FROM b)
SELECT doc_id, CASE WHEN length(t) > 1 AND regexp_full_match(t, '"[^"]*"') THEN substr(t, 2, length(t) - 2) ELSE t END AS answer FROM c"""
_REFUSALS = ["429 too many, retry in 7 s", "Rate limit: retry after 12s", "rate limit", "500 oops retry in 3 s", "status 429", ""]
Q["retry_after"] = lambda s, d: C.table(s, d, "documents").select("doc_id", comments.retry_after(C.pick(_REFUSALS, F.col("doc_id"))).alias("seconds"))
SQL["retry_after"] = f"WITH r AS (SELECT doc_id, {C.sql_pick(_REFUSALS, 'doc_id')} AS m FROM documents), n AS (SELECT doc_id, m, coalesce(try_cast(nullif(regexp_extract(m, 'retry (?:in|after) (\\d+)\\s*s', 1), '') AS INT), 0) AS x FROM r) SELECT doc_id, CASE WHEN contains(m, '429') OR contains(lower(m), 'rate limit') THEN CASE WHEN x > 0 THEN x + 1 ELSE 15 END END AS seconds FROM n"

# --- rules by kind, listings, slices ------------------------------------------------


def _scan(rules):
    """The query and its SQL for some rules of the Russian set."""
    part = RuleSet("ru", {}, {}, tuple(rules), "")
    query = lambda s, d: matching.hits(C.texts(s, d), list(rules)).select("doc_id", "category", "rule", "count")
    return query, f"WITH {C.TEXTS}, {q_text.sql_hits(part)} SELECT doc_id, category, rule, n AS count FROM hits JOIN rules USING (rule_no)"


for _name, _rules in (
    ("scan_hard_bans", _ru.bans),
    ("scan_markers", _ru.markers),
    ("match_lit", [r for r in _ru.rules if r.kind == "lit"]),
    ("match_re", [r for r in _ru.rules if r.kind == "re"]),
    ("match_word_re", [r for r in _ru.rules if r.kind == "word_re"]),
    ("allow_rule", allowed(list(_ru.rules), only=["Calques", "em dash", "Bureaucratese"], disable=["является", "В РАМКАХ"])),
):
    Q[_name], SQL[_name] = _scan(_rules)

_own = [(r.category, r.name, r.lift) for r in _ru.markers]
Q["lift_inherit"] = lambda s, d: s.createDataFrame([(c, n, 0.0 if k % 2 else v, v) for k, (c, n, v) in enumerate(_own)], "category string, rule string, own double, of_category double").select("category", "rule", R.inherited(F.col("own"), F.col("of_category")).alias("lift"))
SQL["lift_inherit"] = "SELECT category, rule, coalesce(nullif(own, 0), of_category, 0.0)::DOUBLE AS lift FROM (VALUES " + ", ".join(f"({C.sql_text(c)}, {C.sql_text(n)}, {0.0 if k % 2 else v}::DOUBLE, {v}::DOUBLE)" for k, (c, n, v) in enumerate(_own)) + ") AS t(category, rule, own, of_category)"


def markup_route(s, d):
    """Files with markup lose it first; others are taken as they are."""
    files = C.files(s, d).select("doc_id", "path", F.concat("text", F.lit("\n\n"), C.pick(C.SNIPPETS, F.col("doc_id"))).alias("text"))
    routed = metrics.strip_markup(files.where(P.is_markup(F.col("path")))).unionByName(files.where(~P.is_markup(F.col("path"))))
    return routed.select("doc_id", F.sha2("text", 256).alias("sha"))


Q["src_markup_route"] = markup_route
SQL["src_markup_route"] = f"WITH {C.TEXTS}, {q_text._strip_sql('texts')}, {C.FILES} SELECT doc_id, sha256(CASE WHEN regexp_matches(lower(path), '\\.(md|mdx|markdown)$') THEN stripped.text ELSE texts.text END) AS sha FROM texts JOIN stripped USING (doc_id) JOIN files USING (doc_id)"

#: Lines shown before and after a block.
AROUND = 12
_at = "(doc_id % 17 + 1)"
Q["code_around"] = lambda s, d: C.texts(s, d).select("doc_id", F.array_join(F.slice(T.lines(F.col("text")), F.greatest(F.lit(1), F.expr(_at).cast("int") - AROUND), F.least(F.lit(2 * AROUND + 1), F.expr(_at).cast("int") + AROUND)), "\n").alias("around"))
SQL["code_around"] = f"WITH {C.TEXTS} SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(1, {_at} - {AROUND}):greatest(1, {_at} - {AROUND}) + least({2 * AROUND + 1}, {_at} + {AROUND}) - 1], chr(10)) AS around FROM texts"
Q["is_doc"] = lambda s, d: q_blocks.blocks(s, d).groupBy("doc").agg(F.count("*").alias("n"))
SQL["is_doc"] = f"WITH {q_blocks.BL} SELECT doc, count(*) AS n FROM bl GROUP BY 1"
Q["rule_code"] = lambda s, d: C.table(s, d, "documents").select("source").distinct().select("source", T.rule_code(F.col("source")).alias("code"))
SQL["rule_code"] = "SELECT DISTINCT source, substr(sha256(source), 1, 6) AS code FROM documents"
Q["src_year_slices"] = lambda s, d: C.table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count("*").alias("n")).select("year", F.col("last.o_orderkey").alias("revision"), "n")
SQL["src_year_slices"] = "SELECT year(o_orderdate)::INT AS year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS revision, count(*) AS n FROM orders GROUP BY 1"
Q["sort_items"] = lambda s, d: q_blocks.items(s, d).orderBy(F.col("score").desc(), "file", "start").select("id", "score")
SQL["sort_items"] = f"WITH {q_blocks._ITEMS} SELECT id, score FROM items"
Q["weight"] = lambda s, d: s.createDataFrame([(r.name, r.lift, r.hard) for r in _ru.rules], "rule string, lift double, hard boolean").select("rule", B.weight(F.col("lift"), F.col("hard")).alias("weight"))
SQL["weight"] = f"SELECT rule, {q_blocks._weight}::INT AS weight FROM (VALUES " + ", ".join(f"({C.sql_text(r.name)}, {r.lift}::DOUBLE, {r.hard})" for r in _ru.rules) + ") AS t(rule, lift, hard)"


# --- sources that are read from files: written to the shared folder first, and read back ----


def jsonl_corpus(s, d):
    """Labelled texts as JSON lines, with lines that aren't JSON and labels that aren't known among them."""
    folder = work_folder(s)
    docs = C.table(s, d, "documents").withColumn("label", F.when(F.pmod("doc_id", F.lit(3)) == 0, "ai").when(F.pmod("doc_id", F.lit(3)) == 1, "human").otherwise("other"))
    line = F.to_json(F.struct("lang", "label", "text", F.col("source").alias("model")))
    docs.select(F.when(F.pmod("doc_id", F.lit(10)) == 7, F.lit("{not json")).otherwise(line).alias("value")).write.text(folder)
    return readers.corpus(s, folder).select("lang", "label", "model", F.sha2("text", 256).alias("sha"))


Q["src_jsonl_corpus"] = jsonl_corpus
SQL["src_jsonl_corpus"] = "SELECT lang, CASE doc_id % 3 WHEN 0 THEN 'ai' ELSE 'human' END AS label, source AS model, sha256(text) AS sha FROM documents WHERE doc_id % 3 < 2 AND doc_id % 10 <> 7 AND coalesce(text, '') <> ''"


def jsonl_edits(s, d):
    folder = work_folder(s)
    b = q_blocks._hashed(s, d).select("hash", "file", "text", (F.col("role") == "user").alias("delete"))
    b.select(F.to_json(F.struct(*b.columns)).alias("value")).write.text(folder)
    return readers.edits(s, folder).select("hash", "file", "text", "delete", F.coalesce("keep", F.lit(False)).alias("keep"))


Q["src_jsonl_edits"] = jsonl_edits
SQL["src_jsonl_edits"] = f"WITH {q_blocks._HASHED} SELECT hash, file, text, role = 'user' AS delete, false AS keep FROM hashed"


def path_list(s, d):
    """A list of paths, read back, down to those that are source files."""
    folder = work_folder(s)
    C.files(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("path"))).write.text(folder)
    return readers.lines(s, folder).where(P.lang_of(F.col("line")) != "")


Q["src_path_list"] = path_list
SQL["src_path_list"] = f"WITH {C.FILES} SELECT doc_id || '/' || path AS line FROM files WHERE {q_blocks._case} <> ''"
Q["src_rcs"] = lambda s, d: C.table(s, d, "documents").select("doc_id", F.concat(F.lit("head 1.2;\n1.2\nlog\n@note@\ntext\n@"), F.replace("text", F.lit("@"), F.lit("@@")), F.lit("@\n\n1.1\nlog\n@old@\ntext\n@d1 1\n@\n")).alias("v")).select("doc_id", F.sha2(readers.rcs_head(F.col("v")), 256).alias("sha"))
SQL["src_rcs"] = "SELECT doc_id, sha256(text) AS sha FROM documents"


def git_show(s, d):
    """The listing of each event's commit: a file that it changed, one added, one renamed."""
    k = F.col("event_id").cast("string")
    listing = F.concat(F.lit("\nM\tsrc/f"), k, F.lit(".go\nA\tnew"), k, F.lit(".go\n"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("M\tlib/g"), k, F.lit(".c\n"))).otherwise(F.lit("D\told.c\n")))
    return P.parse_changed(C.table(s, d, "events").select("event_id", listing.alias("listing")), "listing").select("event_id", "file")


Q["src_git_show"] = git_show
SQL["src_git_show"] = "SELECT event_id, 'src/f' || event_id || '.go' AS file FROM events UNION ALL SELECT event_id, 'lib/g' || event_id || '.c' FROM events WHERE event_id % 2 = 0"

