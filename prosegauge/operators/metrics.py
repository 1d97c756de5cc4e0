"""Statistics of whole documents: one row in, one row out, no shuffle but for rows that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T


def rhythm(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> with sentences, words, mean_len, cv_len, min_len, max_len and typography."""
    t = F.col(text)
    per = F.transform(T.sentences(t), lambda s: F.struct(T.count_words(s).alias("n"), s.endswith("?").cast("int").alias("q")))
    docs = docs.withColumn("__per", F.filter(per, lambda x: x["n"] > 0)).withColumn("__len", F.transform("__per", lambda x: x["n"].cast("long")))
    length = F.col("__len")
    return docs.select(
        *[c for c in docs.columns if not c.startswith("__")],
        F.size(length).alias("sentences"),
        F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x).alias("words"),
        T.mean(length, 1).alias("mean_len"),
        T.spread(length).alias("cv_len"),
        F.coalesce(F.array_min(length), F.lit(0).cast("long")).alias("min_len"),
        F.coalesce(F.array_max(length), F.lit(0).cast("long")).alias("max_len"),
        F.aggregate("__per", F.lit(0), lambda a, x: a + x["q"]).alias("questions"),
        T.count_plain(t, "—").alias("em_dash"),
        (T.count_plain(t, "…") + T.count_plain(t, "...")).alias("ellipsis"),
        T.count_plain(t, "(").alias("parentheses"),
    )


def word_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    docs = docs.withColumn("__len", F.transform(T.words(F.col(text)), lambda w: F.length(w).cast("long")))
    long = F.size(F.filter("__len", lambda n: n >= T.LONG_WORD))
    share = F.when(F.size("__len") > 0, T.rounded(long / F.size("__len") * 100, 1)).otherwise(F.lit(0.0))
    return docs.withColumn("mean_word_len", T.mean(F.col("__len"), 2)).withColumn("long_word_share", share).drop("__len")


def morph(docs: DataFrame, text: str = "text", words: str = "words") -> DataFrame:
    """docs with a word count -> nominalizations, verb_forms, nominal_per_100."""
    # all suffixes are Cyrillic, so words that end otherwise are left out by the regex
    ending = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]++(?<=[{T.CYRILLIC}])"), F.lit(0))
    long = F.filter(ending, lambda w: F.length(w) >= T.SHORT_FORM)
    docs = docs.withColumn("__long", long)
    nominal = F.size(F.filter("__long", lambda w: T.ends_with_any(w, T.NOMINAL_SUFFIXES)))
    verbs = F.size(F.filter("__long", lambda w: ~T.ends_with_any(w, T.NOMINAL_SUFFIXES) & T.ends_with_any(w, T.VERB_SUFFIXES)))
    docs = docs.withColumn("nominalizations", nominal).withColumn("verb_forms", verbs).drop("__long")
    per = F.when(F.col(words) > 0, T.rounded(F.col("nominalizations") / F.col(words) * 100, 2)).otherwise(F.lit(0.0))
    return docs.withColumn("nominal_per_100", per)


def structure(docs: DataFrame, text: str = "text") -> DataFrame:
    """paragraphs, para_mean_sent, para_cv, list_items, listicle_share, title_case_headings, truncated."""
    t = F.col(text)
    docs = docs.withColumn("__para", F.filter(F.transform(T.paragraphs(t), lambda p: F.size(T.sentences(p)).cast("long")), lambda n: n > 0))
    docs = docs.withColumn("__all", T.lines(t)).withColumn("__lines", F.filter("__all", lambda x: ~T.blank(x)))
    items = F.size(F.filter("__lines", lambda x: T.matches(x, T.LIST_ITEM)))
    n = F.size("__lines")

    def heading(line, k):
        return T.let(T.trimmed(line), lambda s: titled(line, k, s))

    def titled(line, k, s):
        after = F.when(k + 1 < F.size("__all"), T.blank(F.try_element_at("__all", k + 2))).otherwise(F.lit(True))
        looks = (F.length(s) <= 80) & ~F.regexp_like(s, F.lit(r"[.!?:;,]\z")) & after & ~T.matches(line, T.LIST_ITEM)
        w = T.find_all(s, T.CYRILLIC_WORD)
        capped = F.filter(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x: F.regexp_like(x, F.lit(r"\A\p{Lu}")) & ~F.lower(x).isin(T.HEADING_STOPWORDS))
        return (s != "") & (s.startswith("#") | looks) & (F.size(w) >= 3) & (F.size(capped) >= 2)

    titles = F.size(F.filter(F.transform("__all", heading), lambda x: x))
    last = F.rtrim(F.element_at("__lines", -1), F.lit(" \t"))
    prose = ~last.startswith("#") & ~T.matches(last, T.LIST_ITEM) & ~last.startswith("|") & ~last.startswith(">") & ~last.startswith("```")
    # only ASCII marks end a text: the test is on its last byte
    cut = prose & (T.count(last, T.CYRILLIC_WORD) >= 4) & ~F.regexp_like(last, F.lit(r"[.!?:)\"'*_`]\z"))
    docs = (
        docs.withColumn("paragraphs", F.size("__para"))
        .withColumn("para_mean_sent", T.mean(F.col("__para"), 1))
        .withColumn("para_cv", T.spread(F.col("__para")))
        .withColumn("list_items", items)
        .withColumn("listicle_share", F.when(n > 0, T.rounded(items / n, 3)).otherwise(F.lit(0.0)))
        .withColumn("title_case_headings", titles)
        .withColumn("truncated", F.when(n > 0, cut).otherwise(F.lit(False)))
    )
    return docs.drop("__para", "__all", "__lines")


def _phrases(w: Column, least: int) -> Column:
    """Of a text's words, the phrases that repeat with their counts: sorted, equal ones stand together."""

    def phrases(stop: Column) -> Column:
        said = lambda k: F.when(~(F.get(stop, k) & F.get(stop, k + 1) & F.get(stop, k + 2)), F.concat_ws(" ", F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))
        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 3), said), lambda x: x.isNotNull()))

    def runs(s: Column, first: Column) -> Column:
        after = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(s)))
        return F.zip_with(first, after, lambda a, b: F.when(b - a >= least, F.struct(F.get(s, a).alias("phrase"), (b - a).cast("long").alias("n"))))

    def counted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (x != F.get(s, k - 1)), k)), lambda k: k.isNotNull())
        return F.filter(T.let(first, lambda f: runs(s, f)), lambda x: x.isNotNull())

    stops = F.transform(w, lambda x: x.isin(T.PHRASE_STOPWORDS))
    return F.when(F.size(w) >= 3, T.let(T.let(stops, phrases), counted)).otherwise(F.array().cast("array<struct<phrase:string,n:bigint>>"))


def _repeated(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, x: words, and the row's repeated phrases as found."""
    x = T.let(T.words(F.lower(text)), lambda w: F.struct(F.size(w).alias("words"), _phrases(w, least).alias("found")))
    return docs.select(F.col(key), x.alias("x"))


def _several(docs: DataFrame, key: str) -> DataFrame | None:
    """The keys that more than one row has; None without any.  Runs over the keys alone."""
    again = docs.groupBy(F.col(key).alias("__again")).count().where("count > 1").select("__again")
    return None if again.isEmpty() else again


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = T.REPEATED) -> DataFrame:
    """key, phrase, n: runs of three words, not all stop words, that a text has `least` times or more.

    Phrases are counted within their row, and no more than the repeated ones leave it.  Rows that share a key have
    their counts added, so all of their phrases are moved.
    """
    again = _several(docs, key)
    # outer: an inner one would find all phrases once more, to drop rows without any
    each = lambda rows, n: _repeated(rows, key, text, n).select(key, F.explode_outer("x.found").alias("x")).where("x is not null").select(key, "x.phrase", "x.n")
    alone = each(docs, least)
    if again is None:
        return alone
    same = F.col(key).eqNullSafe(F.col("__again"))
    shared = each(docs.join(again, same, "left_semi"), 1).groupBy(key, "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return alone.join(again, same, "left_anti").unionByName(shared)


def repeat_rate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, repeats, repeat_per_1000.  A null key has no repeats, as a join by key would have it."""
    if _several(docs, key) is None:
        out = _repeated(docs, key, text, T.REPEATED).select(key, F.when(F.col(key).isNotNull(), F.size("x.found")).alias("repeats"), F.col("x.words").alias("n"))
    else:
        found = repeats(docs, key, text).groupBy(key).agg(F.count("*").alias("repeats"))
        out = docs.select(key, T.count_words(F.lower(text)).alias("n")).join(found, key, "left")
    out = out.select(key, F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"), "n")
    rate = F.when(F.col("n") >= 3, T.rounded(F.col("repeats") / F.col("n") * 1000, 2)).otherwise(F.lit(0.0))
    return out.withColumn("repeat_per_1000", rate).drop("n")


# What counts as markup, in this order.
MARKUP = [
    r"(?s)\A---\n.*?\n---\n",
    r"(?ms)^```.*?^```",
    r"(?ms)^~~~.*?^~~~",
    r"`[^`\n]*`",
    r"(?m)^(?:import|export)\s+.*$",
    r"(?s)<[A-Za-z/][^<>]*>",
    r"\]\([^)\s]+\)",
    r"(?m)^\s*\|.*\|\s*$",
    r"https?://\S+",
]


def strip_markup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Markup as spaces: line breaks stay, and every byte of the rest becomes one space.

    A column for each step: as one expression it would hold the first step 2 ** 9 times.
    """
    spaces = [(r"[\x{10000}-\x{10ffff}]", "    "), (r"[\x{800}-\x{ffff}]", "   "), (r"[\x{80}-\x{7ff}]", "  "), (r"[^\n]", " ")]

    def faded(m):
        for letters, blanks in spaces:
            m = F.regexp_replace(m, letters, blanks)
        return m

    for pattern in MARKUP:
        found, pieces = T.find_all(F.col(text), pattern), F.split(text, T.jdk(pattern), -1)
        joined = F.array_join(F.zip_with(pieces, F.transform(found, faded), lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit("")))), "")
        docs = docs.withColumn(text, F.when(T.matches(F.col(text), pattern), joined).otherwise(F.col(text)))
    return docs
