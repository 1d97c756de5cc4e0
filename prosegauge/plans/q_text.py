"""Queries over whole texts: projections, statistics, repeats, the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import matching, metrics, scoring
from prosegauge.plans import corpus as C
from prosegauge.plans.ruleset import FAKE_RANGE, RuleSet, load_rules

Q, SQL = {}, {}


def sql_re(pattern: str) -> str:
    return C.sql_text(pattern)


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {sql_re(pattern)}))"


def sql_round(value: str, digits: int) -> str:
    return f"(floor(({value})::DOUBLE * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE)"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, {sql_re(f'^[{T.SPACE}]+|[{T.SPACE}]+$')}, '', 'g')"


def sql_sentences(text: str) -> str:
    cut = f"regexp_replace({text}, {sql_re(T.SENTENCE_END)}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_sum(values: str) -> str:
    return f"coalesce(list_sum({values}), 0)"


def sql_mean(values: str, digits: int) -> str:
    return f"CASE WHEN len({values}) > 0 THEN {sql_round(f'{sql_sum(values)}::DOUBLE / len({values})', digits)} ELSE 0.0 END"


def sql_spread(values: str) -> str:
    total, squares = sql_sum(values), sql_sum(f"list_transform({values}, lambda x: x * x)")
    root = f"sqrt((len({values}) * {squares} - {total} * {total})::DOUBLE) / {total}"
    return f"CASE WHEN len({values}) > 1 AND {total} > 0 THEN {sql_round(root, 3)} ELSE 0.0 END"


W = f"regexp_extract_all(text, {sql_re(T.WORD)})"
_RHYTHM = f"""rh0 AS (SELECT *, list_transform({sql_sentences('text')}, lambda s: {{'n': {sql_count('s', T.WORD)}, 'q': CASE WHEN suffix(s, '?') THEN 1 ELSE 0 END}}) AS per FROM texts),
rh1 AS (SELECT * EXCLUDE (per), list_filter(per, lambda x: x.n > 0) AS per FROM rh0),
rh2 AS (SELECT *, list_transform(per, lambda x: x.n::BIGINT) AS l FROM rh1),
rhythm AS (SELECT doc_id, text, len(l)::INT AS sentences, {sql_sum('l')}::BIGINT AS words, {sql_mean('l', 1)} AS mean_len, {sql_spread('l')} AS cv_len,
  coalesce(list_min(l), 0)::BIGINT AS min_len, coalesce(list_max(l), 0)::BIGINT AS max_len, {sql_sum('list_transform(per, lambda x: x.q)')}::INT AS questions,
  {sql_count('text', '—')}::INT AS em_dash, ({sql_count('text', '…')} + {sql_count('text', '[.][.][.]')})::INT AS ellipsis, {sql_count('text', '[(]')}::INT AS parentheses FROM rh2)"""
_RH = ["doc_id", "sentences", "words", "mean_len", "cv_len", "min_len", "max_len", "questions", "em_dash", "ellipsis", "parentheses"]

Q["rhythm"] = lambda s, d: metrics.rhythm(C.texts(s, d)).select(*_RH)
SQL["rhythm"] = f"WITH {C.TEXTS}, {_RHYTHM} SELECT {', '.join(_RH)} FROM rhythm"

Q["words"] = lambda s, d: C.texts(s, d).select("doc_id", T.count_words(F.col("text")).alias("words"), T.words(F.col("text"))[0].alias("first_word"))
SQL["words"] = f"WITH {C.TEXTS} SELECT doc_id, len({W})::INT AS words, {W}[1] AS first_word FROM texts"

Q["split_sentences"] = lambda s, d: C.texts(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))
SQL["split_sentences"] = f"WITH {C.TEXTS}, s AS (SELECT doc_id, {sql_sentences('text')} AS l FROM texts) SELECT doc_id, (unnest(range(1, len(l) + 1)) - 1)::INT AS place, unnest(l) AS sentence FROM s"

Q["split_paragraphs"] = lambda s, d: C.texts(s, d).select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("paragraph"))
SQL["split_paragraphs"] = rf"WITH {C.TEXTS}, p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS paragraph FROM texts) SELECT doc_id, paragraph FROM p WHERE {sql_trim('paragraph')} <> ''"

Q["word_lengths"] = lambda s, d: metrics.word_lengths(C.texts(s, d)).select("doc_id", "mean_word_len", "long_word_share")
SQL["word_lengths"] = f"""WITH {C.TEXTS}, w AS (SELECT doc_id, list_transform({W}, lambda x: length(x)) AS l FROM texts)
SELECT doc_id, {sql_mean('l', 2)} AS mean_word_len, CASE WHEN len(l) > 0 THEN {sql_round(f'len(list_filter(l, lambda x: x >= {T.LONG_WORD}))::DOUBLE / len(l) * 100', 1)} ELSE 0.0 END AS long_word_share FROM w"""

_ends = lambda w, suffixes: f"regexp_matches({w}, {sql_re('(?:' + '|'.join(suffixes) + ')$')})"
_MORPH = f"""mo0 AS (SELECT *, list_filter(regexp_extract_all(lower(text), {sql_re(T.WORD)}), lambda w: length(w) >= {T.SHORT_FORM}) AS lw FROM rhythm),
mo1 AS (SELECT * EXCLUDE (lw), len(list_filter(lw, lambda w: {_ends('w', T.NOMINAL_SUFFIXES)}))::INT AS nominalizations,
  len(list_filter(lw, lambda w: NOT {_ends('w', T.NOMINAL_SUFFIXES)} AND {_ends('w', T.VERB_SUFFIXES)}))::INT AS verb_forms FROM mo0),
morph AS (SELECT *, CASE WHEN words > 0 THEN {sql_round('nominalizations::DOUBLE / words * 100', 2)} ELSE 0.0 END AS nominal_per_100 FROM mo1)"""
Q["morph"] = lambda s, d: metrics.morph(metrics.rhythm(C.texts(s, d))).select("doc_id", "nominalizations", "verb_forms", "nominal_per_100")
SQL["morph"] = f"WITH {C.TEXTS}, {_RHYTHM}, {_MORPH} SELECT doc_id, nominalizations, verb_forms, nominal_per_100 FROM morph"

_ST = ["paragraphs", "para_mean_sent", "para_cv", "list_items", "listicle_share", "title_case_headings", "truncated"]
_item = lambda x: f"regexp_matches({x}, {sql_re(T.LIST_ITEM)})"
_cyr = lambda x: f"regexp_extract_all({x}, {sql_re(T.CYRILLIC_WORD)})"
_STRUCTURE = rf"""st0 AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: {sql_trim('p')} <> ''), lambda p: len({sql_sentences('p')})::BIGINT), lambda n: n > 0) AS pa,
  string_split(text, chr(10)) AS al FROM morph),
st1 AS (SELECT *, list_filter(al, lambda x: {sql_trim('x')} <> '') AS li FROM st0),
st2 AS (SELECT *, list_transform(range(1, len(al) + 1), lambda k: {{'raw': al[k], 's': {sql_trim('al[k]')}, 'gap': k = len(al) OR {sql_trim("coalesce(al[k + 1], '')")} = ''}}) AS hd,
  regexp_replace(li[len(li)], '[ \t]+$', '') AS last FROM st1),
structure AS (SELECT * EXCLUDE (pa, al, li, hd, last), len(pa)::INT AS paragraphs, {sql_mean('pa', 1)} AS para_mean_sent, {sql_spread('pa')} AS para_cv,
  len(list_filter(li, lambda x: {_item('x')}))::INT AS list_items,
  CASE WHEN len(li) > 0 THEN {sql_round(f"len(list_filter(li, lambda x: {_item('x')}))::DOUBLE / len(li)", 3)} ELSE 0.0 END AS listicle_share,
  len(list_filter(hd, lambda h: h.s <> '' AND (prefix(h.s, '#') OR (length(h.s) <= 80 AND NOT regexp_matches(h.s, '[.!?:;,]$') AND h.gap AND NOT {_item('h.raw')}))
    AND len({_cyr('h.s')}) >= 3 AND len(list_filter({_cyr('h.s')}[2:], lambda w: regexp_matches(w, '^\p{{Lu}}') AND NOT list_contains([{', '.join(map(C.sql_text, T.HEADING_STOPWORDS))}], lower(w)))) >= 2))::INT AS title_case_headings,
  CASE WHEN len(li) = 0 THEN false ELSE NOT prefix(last, '#') AND NOT {_item('last')} AND NOT prefix(last, '|') AND NOT prefix(last, '>') AND NOT prefix(last, '```')
    AND len({_cyr('last')}) >= 4 AND NOT regexp_matches(last, {sql_re('[.!?:)"' + "'" + '*_`]$')}) END AS truncated FROM st2)"""
Q["structure"] = lambda s, d: metrics.structure(C.texts(s, d)).select("doc_id", *_ST)
SQL["structure"] = f"WITH {C.TEXTS}, morph AS (SELECT * FROM texts), {_STRUCTURE} SELECT doc_id, {', '.join(_ST)} FROM structure"

_stop = ", ".join(map(C.sql_text, T.PHRASE_STOPWORDS))
_REPEATS = f"""rp0 AS (SELECT doc_id, regexp_extract_all(lower(text), {sql_re(T.WORD)}) AS w FROM texts),
rpe AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM rp0 WHERE len(w) >= 3),
rpl AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM rpe WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rp1 AS (SELECT doc_id, a || ' ' || b || ' ' || c AS phrase FROM rpl WHERE c IS NOT NULL AND NOT (a IN ({_stop}) AND b IN ({_stop}) AND c IN ({_stop}))),
repeats AS (SELECT doc_id, phrase, count(*)::BIGINT AS n FROM rp1 GROUP BY ALL HAVING count(*) >= {T.REPEATED})"""
Q["repeats"] = lambda s, d: metrics.repeats(C.texts(s, d))
SQL["repeats"] = f"WITH {C.TEXTS}, {_REPEATS} SELECT * FROM repeats"
Q["repeat_rate"] = lambda s, d: metrics.repeat_rate(C.texts(s, d))
SQL["repeat_rate"] = f"""WITH {C.TEXTS}, {_REPEATS}, c AS (SELECT doc_id, count(*) AS r FROM repeats GROUP BY 1)
SELECT doc_id, coalesce(r, 0)::BIGINT AS repeats, CASE WHEN len(w) >= 3 THEN {sql_round('coalesce(r, 0)::DOUBLE / len(w) * 1000', 2)} ELSE 0.0 END AS repeat_per_1000 FROM rp0 LEFT JOIN c USING (doc_id)"""

_share = rf"CASE WHEN {sql_count('text', chr(92) + 'p{L}')} = 0 THEN 0.0 ELSE {sql_count('text', '[' + T.CYRILLIC + ']')}::DOUBLE / {sql_count('text', chr(92) + 'p{L}')} END"
Q["cyrillic_share"] = lambda s, d: C.texts(s, d).select("doc_id", T.cyrillic_share(F.col("text")).alias("share"), (T.cyrillic_share(F.col("text")) < 0.3).alias("not_russian"))
SQL["cyrillic_share"] = f"WITH {C.TEXTS} SELECT doc_id, {_share} AS share, {_share} < 0.3 AS not_russian FROM texts"
Q["lang_of_text"] = lambda s, d: C.texts(s, d).select("doc_id", T.language(F.col("text")).alias("lang"))
SQL["lang_of_text"] = f"WITH {C.TEXTS} SELECT doc_id, CASE WHEN {_share} >= 0.3 THEN 'ru' ELSE 'en' END AS lang FROM texts"

Q["norm_hash"] = lambda s, d: C.texts(s, d).select("doc_id", T.norm_hash(F.col("text")).alias("hash"))
_hash = lambda t: f"substr(sha256(array_to_string(list_filter(regexp_split_to_array({t}, {sql_re(f'[{T.SPACE}]+')}), lambda w: w <> ''), ' ')), 1, 12)"
SQL["norm_hash"] = f"WITH {C.TEXTS} SELECT doc_id, {_hash('text')} AS hash FROM texts"

Q["src_text"] = lambda s, d: C.texts(s, d).where(~T.blank(F.col("text"))).select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
SQL["src_text"] = f"WITH {C.TEXTS} SELECT doc_id, length(text)::INT AS chars, strlen(text)::INT AS bytes FROM texts WHERE {sql_trim('text')} <> ''"


def _gone(text: str, pattern: str) -> str:
    """Matches as spaces, byte by byte; line breaks stay."""
    found, pieces = f"regexp_extract_all({text}, {sql_re(pattern)})", f"regexp_split_to_array({text}, {sql_re(pattern)})"
    filled = "list_transform(mm, lambda m: array_to_string(list_transform(string_split(m, ''), lambda c: CASE WHEN c = chr(10) THEN c ELSE repeat(' ', strlen(c)::INT) END), ''))"
    return found, pieces, filled


def _strip_sql(source: str) -> str:
    out, at = [], source
    for k, pattern in enumerate(metrics.MARKUP):
        found, pieces, filled = _gone("text", pattern)
        out.append(f"m{k}a AS (SELECT doc_id, {found} AS mm, {pieces} AS pp FROM {at})")
        out.append(f"m{k}b AS (SELECT doc_id, pp, {filled} AS ff FROM m{k}a)")
        out.append(f"m{k} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(pp) + 1), lambda i: pp[i] || coalesce(ff[i], '')), '') AS text FROM m{k}b)")
        at = f"m{k}"
    return ", ".join(out) + f", stripped AS (SELECT doc_id, text FROM {at})"


Q["strip_markup"] = lambda s, d: metrics.strip_markup(C.texts(s, d)).select("doc_id", "text")
SQL["strip_markup"] = f"WITH {C.TEXTS}, {_strip_sql('texts')} SELECT doc_id, text FROM stripped"
Q["strip_markup_pages"] = lambda s, d: metrics.strip_markup(C.table(s, d, "pages"), "html").select("page_id", F.sha2("html", 256).alias("sha"), T.count_words(F.col("html")).alias("words"))
SQL["strip_markup_pages"] = f"WITH p AS (SELECT page_id AS doc_id, html AS text FROM pages), {_strip_sql('p')} SELECT doc_id AS page_id, sha256(text) AS sha, {sql_count('text', T.WORD)}::INT AS words FROM stripped"


# --- the score ---------------------------------------------------------------


def sql_builtin(name: str, text: str) -> str:
    if name == "en_dash":
        # a dash stands if digits are on both sides, past any spaces
        total = sql_count(text, "–")
        left = f"list_transform(string_split({text}, '–'), lambda x: regexp_matches(x, '[0-9] *$'))"
        right = f"list_transform(string_split({text}, '–'), lambda x: regexp_matches(x, '^ *[0-9]'))"
        return f"({total} - len(list_filter(range(1, len({left})), lambda i: {left}[i] AND {right}[i + 1])))"
    if name == "latin_in_cyrillic":
# letters doubled, so that neighbours can share one
        return f"len(regexp_extract_all(regexp_replace({text}, '([{T.CYRILLIC}])', '\\1\\1', 'g'), '[{T.CYRILLIC}][a-z][{T.CYRILLIC}]'))"
    x, y = (f"regexp_extract_all({text}, {sql_re(FAKE_RANGE)}, {k})" for k in (1, 2))
    return f"len(list_filter(list_zip({x}, {y}), lambda p: lower(p[1]) <> lower(p[2]) AND NOT regexp_matches(p[1], '^\\p{{Lu}}') AND NOT regexp_matches(p[2], '^\\p{{Lu}}')))"


def sql_rule(rule, text: str = "text") -> str:
    return sql_builtin(rule.pattern, text) if rule.kind == "builtin" else sql_count(text, rule.re2)


def sql_hits(rs: RuleSet, source: str = "texts") -> str:
    """hits (doc_id, rule_no, n) and rules (rule_no, category, rule, fix, lift, hard)."""
    counted = ", ".join(f"{{'r': {k}, 'n': {sql_rule(r)}::INT}}" for k, r in enumerate(rs.rules))
    rows = ", ".join(f"({k}, {C.sql_text(r.category)}, {C.sql_text(r.name)}, {C.sql_text(r.fix)}, {r.lift}::DOUBLE, {r.hard})" for k, r in enumerate(rs.rules))
    return f"""h0 AS (SELECT doc_id, unnest(list_filter([{counted}], lambda x: x.n > 0)) AS h FROM {source}),
hits AS (SELECT doc_id, h.r AS rule_no, h.n AS n FROM h0),
rules(rule_no, category, rule, fix, lift, hard) AS (VALUES {rows})"""


def sql_muted(rs: RuleSet, genre: str) -> str:
    bans, categories, names = rs.muted(genre)
    within = lambda c, x: f"{c} IN ({', '.join(map(C.sql_text, sorted(x)))})" if x else "false"
    return f"(CASE WHEN hard THEN {within('rule', bans)} ELSE {within('category', categories)} OR {within('rule', names)} END)"


def sql_dense(rs: RuleSet) -> str:
    return " AND ".join(["true", *[f"(rule <> {C.sql_text(k)} OR NOT hard OR (n >= 2 AND n > words::DOUBLE / {v}))" for k, v in rs.freq_bans.items()]])


def sql_points(value: str, most: int) -> str:
    return f"least({most}, greatest(0, floor(({value})::DOUBLE + 0.5)::INT))"


_SCORE = ["doc_id", "words", "phrase_bans", "copy_paste", "soft", "muted_bans", "muted_markers", "p_bans", "p_copy", "p_soft", "p_dash", "p_rhythm", "p_nominal", "p_paragraphs", "p_listicle", "score", "band", "sterile_share", "not_russian"]


def sql_score(rs: RuleSet, genre: str) -> str:
    t, target = rs.thresholds, float(rs.cv_target(genre))
    dash = "0.0" if "Em dash" in rs.muted(genre)[0] else "em_dash::DOUBLE / greatest(words, 1) * 100"
    mut, cp = sql_muted(rs, genre), C.sql_text(rs.copy_paste)
    return f"""WITH {C.TEXTS}, {_RHYTHM}, {_MORPH}, {_STRUCTURE}, {sql_hits(rs)},
live AS (SELECT doc_id, n, hard, category, rule, {mut} AS muted FROM hits JOIN rules USING (rule_no) JOIN (SELECT doc_id, words FROM rhythm) USING (doc_id) WHERE {sql_dense(rs)}),
agg AS (SELECT doc_id, coalesce(sum(n) FILTER (hard AND NOT muted AND rule <> 'Em dash'), 0) AS phrase_bans, coalesce(sum(n) FILTER (NOT hard AND NOT muted AND category = {cp}), 0) AS copy_paste,
  coalesce(sum(n) FILTER (hard AND NOT muted AND contains(rule, 'dash')), 0) AS dash_bans, coalesce(sum(n) FILTER (hard AND NOT muted AND NOT contains(rule, 'dash')), 0) AS other_bans,
  coalesce(sum(n) FILTER (NOT hard AND NOT muted AND category <> {cp}), 0) AS soft, count(*) FILTER (hard AND muted) AS muted_bans, count(*) FILTER (NOT hard AND muted) AS muted_markers FROM live GROUP BY 1),
j AS (SELECT s.*, coalesce(phrase_bans, 0)::BIGINT AS phrase_bans, coalesce(copy_paste, 0)::BIGINT AS copy_paste, coalesce(dash_bans, 0)::BIGINT AS dash_bans, coalesce(other_bans, 0)::BIGINT AS other_bans, coalesce(soft, 0)::BIGINT AS soft, coalesce(muted_bans, 0)::BIGINT AS muted_bans, coalesce(muted_markers, 0)::BIGINT AS muted_markers, {dash} AS dash FROM structure s LEFT JOIN agg USING (doc_id)),
p AS (SELECT *, least(45, 12 * phrase_bans)::INT AS p_bans, CASE WHEN copy_paste > 0 THEN 60 ELSE 0 END AS p_copy, {sql_points('2 * (soft::DOUBLE / greatest(words, 1) * 100)', 30)} AS p_soft,
  CASE WHEN dash > 2.0 THEN {sql_points('3 * (dash - 2.0::DOUBLE)', 8)} ELSE 0 END AS p_dash,
  CASE WHEN sentences >= 4 AND cv_len < {target}::DOUBLE THEN {sql_points(f'({target}::DOUBLE - cv_len) / {target}::DOUBLE * 30', 20)} ELSE 0 END AS p_rhythm,
  CASE WHEN nominal_per_100 > {t['nominal_target']} THEN {sql_points(f"(nominal_per_100 - {float(t['nominal_target'])}::DOUBLE) / 1.5::DOUBLE * 3", 8)} ELSE 0 END AS p_nominal,
  CASE WHEN paragraphs >= {t['para_min_count']} AND para_cv < {float(t['para_cv_ai'])}::DOUBLE THEN {sql_points(f"({float(t['para_cv_ai'])}::DOUBLE - para_cv) / {float(t['para_cv_ai'])}::DOUBLE * 20", 10)} ELSE 0 END AS p_paragraphs,
  CASE WHEN list_items >= {t['listicle_min_items']} AND listicle_share > {float(t['listicle_share_ai'])}::DOUBLE THEN {sql_points(f"(listicle_share - {float(t['listicle_share_ai'])}::DOUBLE) * 30", 12)} ELSE 0 END AS p_listicle FROM j),
z AS (SELECT *, greatest(0, least(100, 100 - p_bans - p_copy - p_soft - p_dash - p_rhythm - p_nominal - p_paragraphs - p_listicle)) AS score FROM p)
SELECT {', '.join(c for c in _SCORE if c not in ('band', 'sterile_share', 'not_russian'))}, CASE WHEN score >= {t['band_clean']} THEN 'clean' WHEN score >= {t['band_edit']} THEN 'edit' ELSE 'rewrite' END AS band,
  CASE WHEN phrase_bans = 0 AND copy_paste = 0 AND soft = 0 AND words >= 100 THEN CASE WHEN words < 100 THEN 42.2 WHEN words < 200 THEN 21.0 ELSE 15.1 END ELSE 0.0 END::DOUBLE AS sterile_share,
  {_share} < 0.3 AS not_russian FROM z"""


for _set, _genre, _name in (("ru", "", "score"), ("ru", "academic", "score_academic"), ("en", "marketing", "score_en"), ("ru", "fiction", "score_fiction")):
    Q[_name] = lambda s, d, a=_set, g=_genre: scoring.score(C.texts(s, d), load_rules(a), g).select(*_SCORE)
    SQL[_name] = sql_score(load_rules(_set), _genre)

# --- rules -------------------------------------------------------------------

for _set in ("ru", "en", "code"):
    Q[f"scan_{_set}"] = lambda s, d, a=_set: matching.hits(C.texts(s, d), list(load_rules(a).rules)).select("doc_id", "category", "rule", "count")
    SQL[f"scan_{_set}"] = f"WITH {C.TEXTS}, {sql_hits(load_rules(_set))} SELECT doc_id, category, rule, n AS count FROM hits JOIN rules USING (rule_no)"

_words = lambda s, d: C.texts(s, d).select("doc_id", T.count_words(F.col("text")).alias("words"))


def freq_ban(s, d):
    rs = load_rules("ru")
    texts = C.texts(s, d).withColumn("words", T.count_words(F.col("text")))
    found = matching.hits(texts, rs.bans, key=["doc_id", "words"])
    return matching.dense_enough(found, rs).select("doc_id", "rule", "count")


Q["freq_ban"] = freq_ban
SQL["freq_ban"] = f"WITH {C.TEXTS}, {sql_hits(load_rules('ru'))}, w AS (SELECT doc_id, len({W}) AS words FROM texts) SELECT doc_id, rule, n AS count FROM hits JOIN rules USING (rule_no) JOIN w USING (doc_id) WHERE hard AND {sql_dense(load_rules('ru'))}"


def genre_mute(s, d, genre="academic"):
    rs = load_rules("ru")
    found = matching.hits(C.texts(s, d), list(rs.rules)).withColumn("muted", matching.muted(rs, genre))
    return found.groupBy("doc_id").agg(F.count_if("muted").alias("muted"), F.count_if(~F.col("muted")).alias("live"))


Q["genre_mute"] = genre_mute
SQL["genre_mute"] = f"WITH {C.TEXTS}, {sql_hits(load_rules('ru'))}, m AS (SELECT doc_id, {sql_muted(load_rules('ru'), 'academic')} AS muted FROM hits JOIN rules USING (rule_no)) SELECT doc_id, count(*) FILTER (muted) AS muted, count(*) FILTER (NOT muted) AS live FROM m GROUP BY 1"

Q["by_rule"] = lambda s, d: matching.by_rule(matching.hits(C.texts(s, d), list(load_rules("ru").rules)))
SQL["by_rule"] = f"WITH {C.TEXTS}, {sql_hits(load_rules('ru'))} SELECT category, rule, sum(n)::BIGINT AS hits, count(*) AS docs FROM hits JOIN rules USING (rule_no) GROUP BY 1, 2"

for _b in ("en_dash", "latin_in_cyrillic", "fake_range"):
    Q[f"builtin_{_b}"] = lambda s, d, b=_b: C.texts(s, d).select("doc_id", F.coalesce(matching.rule_count(next(r for r in load_rules("ru").rules if r.kind == "builtin" and r.pattern == b), F.col("text"), F.col("text")), F.lit(0)).cast("int").alias("n"))
    SQL[f"builtin_{_b}"] = f"WITH {C.TEXTS} SELECT doc_id, {sql_builtin(_b, 'text')}::INT AS n FROM texts"


def top_markers(s, d, most=12):
    """Per text, markers by count, in the order of the rules where counts tie, with one fix a category."""
    from pyspark.sql.window import Window

    found = matching.hits(C.texts(s, d), load_rules("ru").markers)
    by = Window.partitionBy("doc_id").orderBy(F.col("count").desc(), "rule_no")
    found = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    first = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("place")) == 1
    return found.withColumn("shown_fix", F.when(first, F.col("fix")).otherwise("")).select("doc_id", "place", "category", "rule", "count", "shown_fix")


Q["top_markers"] = top_markers
_ru_markers = RuleSet("ru", {}, {}, tuple(load_rules("ru").markers), "")
SQL["top_markers"] = f"""WITH {C.TEXTS}, {sql_hits(_ru_markers)}, p AS (SELECT doc_id, category, rule, fix, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rule_no))::INT AS place FROM hits JOIN rules USING (rule_no))
SELECT doc_id, place, category, rule, n AS count, CASE WHEN row_number() OVER (PARTITION BY doc_id, category ORDER BY place) = 1 THEN fix ELSE '' END AS shown_fix FROM p WHERE place <= 12"""


def sql_builtin_lines(rule, source: str) -> str:
    """m, s and k as in sql_lines, without look-around."""
    name = rule.pattern
    if name == "en_dash":
        text, p = "text", "'–'"
        k = "list_transform(range(1, len(m) + 1), lambda j: NOT (regexp_matches(s[j], '[0-9] *$') AND regexp_matches(s[j + 1], '^ *[0-9]')))"
    elif name == "latin_in_cyrillic":
        # letters doubled, so that neighbours can share one
        text, p = f"regexp_replace(text, '([{T.CYRILLIC}])', '\\1\\1', 'g')", f"'[{T.CYRILLIC}][a-z][{T.CYRILLIC}]'"
        k = "NULL::BOOLEAN[]"
    else:
        text, p = "text", sql_re(FAKE_RANGE)
        x, y = (f"regexp_extract(m[j], {p}, {n})" for n in (1, 2))
        k = f"list_transform(range(1, len(m) + 1), lambda j: lower({x}) <> lower({y}) AND NOT regexp_matches({x}, '^\\p{{Lu}}') AND NOT regexp_matches({y}, '^\\p{{Lu}}'))"
    pieces = f"SELECT doc_id, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS s FROM {source}"
    pieces = pieces if pieces.endswith(" AND") else f"{pieces} WHERE"
    return f"SELECT doc_id, {C.sql_text(rule.name)} AS rule, m, s, {k} AS k FROM ({pieces} regexp_matches({text}, {p}))"


def sql_lines(rules, source="texts") -> str:
    """Places by pieces between matches; of builtins, with the matches that count as `k`."""
    parts = []
    for r in rules:
        if r.kind == "builtin":
            parts.append(sql_builtin_lines(r, source))
            continue
        p = sql_re(r.re2)
        parts.append(f"SELECT doc_id, {C.sql_text(r.name)} AS rule, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS s, NULL::BOOLEAN[] AS k FROM {source} WHERE regexp_matches(text, {p})")
    nl = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    lead = "regexp_extract(m[i], '^([^\\p{L}\\p{Nd}]*)[\\p{L}\\p{Nd}]', 1)"
    at = f"coalesce(list_sum(list_transform(s[1:i], lambda x: {nl('x')})), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: {nl('x')})), 0) + {nl(lead)} + 1"
    return f"l0 AS ({' UNION ALL '.join(parts)}), l1 AS (SELECT doc_id, rule, unnest(list_filter(range(1, len(m) + 1), lambda j: k IS NULL OR k[j])) AS i, m, s FROM l0), l2 AS (SELECT doc_id, rule, ({at})::BIGINT AS line FROM l1)"


_bans = load_rules("ru").bans
Q["fill_lines"] = lambda s, d: matching.with_lines(matching.hits(C.texts(s, d), _bans)).select("doc_id", "rule", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))
SQL["fill_lines"] = f"WITH {C.TEXTS}, {sql_lines(_bans)}, u AS (SELECT DISTINCT * FROM l2) SELECT doc_id, rule, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM u GROUP BY 1, 2"
