"""The cleanliness score of a document: penalties by kind, in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.operators import matching, metrics
from prosegauge.plans.ruleset import RuleSet

# Shares of human texts without any marker, by words.
STERILE_FROM, STERILE = 100, [(100, 42.2), (200, 21.0), (None, 15.1)]
EM_DASH = "Em dash"


def points(value: Column, most: int) -> Column:
    """Rounded half up, from 0 to most."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor(value + 0.5).cast("int")))


def per_document(found: DataFrame, rs: RuleSet, genre: str, key: str = "doc_id") -> DataFrame:
    """hits with word counts -> key and sums: phrase_bans, copy_paste, soft, and what the genre muted."""
    found = matching.dense_enough(found, rs).withColumn("muted", matching.muted(rs, genre))
    live, hard = ~F.col("muted"), F.col("hard")
    total = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).cast("long")
    copied = F.col("category") == rs.copy_paste
    return found.groupBy(key).agg(
        total(live & hard & (F.col("rule") != EM_DASH)).alias("phrase_bans"),
        total(live & ~hard & copied).alias("copy_paste"),
        total(live & ~hard & ~copied).alias("soft"),
        F.count_if(hard & ~live).alias("muted_bans"),
        F.count_if(~hard & ~live).alias("muted_markers"),
    )


def penalties(rs: RuleSet, genre: str) -> dict[str, Column]:
    t = rs.thresholds
    words = F.greatest(F.col("words"), F.lit(1))
    per100 = lambda c: F.when(F.col("words") == 0, F.col(c) * 100.0).otherwise(F.col(c) / words * 100)
    dash = F.lit(0.0) if EM_DASH in rs.muted(genre)[0] else per100("em_dash")
    target, flat = float(rs.cv_target(genre)), float(t["para_cv_ai"])
    share = float(t["listicle_share_ai"])
    zero = F.lit(0)
    return {
        "p_bans": F.least(F.lit(45), 12 * F.col("phrase_bans")).cast("int"),
        "p_copy": F.when(F.col("copy_paste") > 0, 60).otherwise(0),
        "p_soft": points(2 * per100("soft"), 30),
        "p_dash": F.when(dash > 2.0, points(3 * (dash - 2.0), 8)).otherwise(zero),
        "p_rhythm": F.when((F.col("sentences") >= 4) & (F.col("cv_len") < target), points((F.lit(target) - F.col("cv_len")) / target * 30, 20)).otherwise(zero),
        "p_nominal": F.when(F.col("nominal_per_100") > t["nominal_target"], points((F.col("nominal_per_100") - float(t["nominal_target"])) / 1.5 * 3, 8)).otherwise(zero),
        "p_paragraphs": F.when((F.col("paragraphs") >= t["para_min_count"]) & (F.col("para_cv") < flat), points((F.lit(flat) - F.col("para_cv")) / flat * 20, 10)).otherwise(zero),
        "p_listicle": F.when((F.col("list_items") >= t["listicle_min_items"]) & (F.col("listicle_share") > share), points((F.col("listicle_share") - share) * 30, 12)).otherwise(zero),
    }


def score(docs: DataFrame, rs: RuleSet, genre: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> key, metrics, penalties, score 0..100, band, sterile share.

    Hits are summed within each row's array, so no rows are exploded and nothing is shuffled.
    """
    base = docs.select(key, F.col(text).alias("text"))
    base = metrics.structure(metrics.morph(metrics.rhythm(base)))
    base = base.withColumn("not_russian", T.cyrillic_share(F.col("text")) < 0.3).withColumn("__low", matching.lowered(F.col("text")))
    base = base.withColumn("__near", matching.near_words(list(rs.rules), F.col("__low")))
    base = base.withColumn("__n", matching.counts(list(rs.rules), F.col("text"), F.col("__low"), F.col("__near"))).drop("__low", "__near", "text")
    order = [rs.rules[k] for k in matching.in_plan(list(rs.rules))]
    # bans by density count in full or not at all
    per = {k: rs.freq_bans[r.name] for k, r in enumerate(order) if r.hard and r.name in rs.freq_bans}

    def kept(n: Column, k: Column) -> Column:
        out = n
        for at, many in per.items():
            out = F.when((k != at) | ((n >= 2) & (n > F.col("words") / many)), out).otherwise(F.lit(0))
        return out

    base = base.withColumn("__n", F.transform("__n", kept))

    def total(which, of=lambda n: n) -> Column:
        mask = F.lit([int(which(r)) for r in order])
        return F.aggregate(F.zip_with("__n", mask, lambda n, m: of(n) * m), F.lit(0).cast("long"), lambda a, x: a + x)

    live = lambda r: not rs.is_muted(r, genre)
    once = lambda n: (n > 0).cast("int")
    base = base.select(
        *[c for c in base.columns if c != "__n"],
        total(lambda r: r.hard and live(r) and r.name != EM_DASH).alias("phrase_bans"),
        total(lambda r: r.hard and live(r) and "dash" in r.name).alias("dash_bans"),
        total(lambda r: r.hard and live(r) and "dash" not in r.name).alias("other_bans"),
        total(lambda r: not r.hard and live(r) and r.category == rs.copy_paste).alias("copy_paste"),
        total(lambda r: not r.hard and live(r) and r.category != rs.copy_paste).alias("soft"),
        total(lambda r: r.hard and not live(r), once).alias("muted_bans"),
        total(lambda r: not r.hard and not live(r), once).alias("muted_markers"),
    )
    for name, p in penalties(rs, genre).items():
        base = base.withColumn(name, p)
    names = list(penalties(rs, genre))
    lost = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    base = base.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))
    band = F.when(F.col("score") >= rs.thresholds["band_clean"], "clean").when(F.col("score") >= rs.thresholds["band_edit"], "edit").otherwise("rewrite")
    bare = (F.col("phrase_bans") == 0) & (F.col("copy_paste") == 0) & (F.col("soft") == 0) & (F.col("words") >= STERILE_FROM)
    share = F.when(F.col("words") < STERILE[0][0], STERILE[0][1]).when(F.col("words") < STERILE[1][0], STERILE[1][1]).otherwise(STERILE[2][1])
    return base.withColumn("band", band).withColumn("sterile_share", F.when(bare, share).otherwise(F.lit(0.0)))


def marker_verdict(total: Column, copy_paste: Column, words: Column) -> Column:
    d = F.when(words == 0, F.lit(0.0)).otherwise(total / words * 100)
    said = lambda tail: F.concat(total.cast("string"), F.lit(" ("), T.one_digit(d), F.lit(" per 100 words) - " + tail))
    return (
        F.when(copy_paste > 0, F.lit("chatbot copy-paste artifacts - text pasted from an AI reply"))
        .when(total == 0, F.lit("0 - none"))
        .when(d < 1.0, said("within normal range"))
        .when(d < 3.0, said("density is elevated, worth a look"))
        .otherwise(said("density is high, text needs editing"))
    )
