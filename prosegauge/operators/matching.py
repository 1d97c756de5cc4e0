"""Rules against texts: counts, places, mutes.

All rules of a set are one array of counts per text, cut to what was found and exploded: one pass, no shuffle,
no cross join.  Literals, most of the rules, are data: one lambda runs over their array and counts by length
difference on the lower-cased text.  Regexes are constants of the plan, so that each is compiled once; before one is
run, the text is asked for what every match must have: first the few of its words that begin like one that a rule
demands, then all of it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import text as T
from prosegauge.plans.ruleset import FAKE_RANGE, HARD, Rule, RuleSet


#: Marks a place in a text; taken out of texts first.
PLACE = "\x01"
#: Letters by which the words of a text are told apart before rules are asked.
HEAD = 4


def rule_count(rule: Rule, text: Column, low: Column, near: Column | None = None) -> Column:
    if rule.kind == "lit":
        return literal_count(low, F.lit(rule.pattern.lower()))
    if rule.kind == "builtin" and rule.pattern == "fake_range":
        false = F.size(F.filter(fake_ranges(text), lambda x: x))
        return F.when(F.contains(low, F.lit("от")) & F.contains(low, F.lit("до")), false).otherwise(F.lit(0))
    found = F.regexp_count(text, F.lit(rule.jdk))
    if rule.kind == "builtin":
        return F.when(F.contains(low, F.lit("–")), found).otherwise(F.lit(0)) if rule.pattern == "en_dash" else found
    # a plain search for what a match must have is far cheaper than the regex
    asked = rule_demands(rule)
    if not all(asked):
        return found
    within = lambda d: near if near is not None and all(_listed(*x) for x in d) else low
    each = [_all([_any([F.contains(within(d), F.lit(x)) for x, _ in d]) for d in sorted(demands, key=_worth)]) for demands in asked]
    return F.when(_any(each), found).otherwise(F.lit(0))


def rule_demands(rule: Rule) -> list[list[list[tuple[str, bool]]]]:
    return T.demands(rule.pattern, edge=rule.kind == "word_re")


def literal_demand(literal: str) -> str:
    """The longest word within a literal that begins a word of any text the literal is in; empty without one."""
    return max(re.findall(rf"(?<=\W)\w{{{HEAD},}}", literal.lower()), key=len, default="")


def _listed(text: str, begins: bool) -> bool:
    return begins and len(text) >= HEAD and re.fullmatch(r"\w+", text) is not None


def near_words(rules: list[Rule], low: Column) -> Column:
    """The words of a text that begin like a word that some rule demands: a small part of it to search instead."""
    heads = {x[:HEAD] for r in rules if r.kind in ("re", "word_re") for demands in rule_demands(r) for d in demands for x, begins in d if _listed(x, begins)}
    heads |= {x[:HEAD] for r in rules if r.kind == "lit" for x in [literal_demand(r.pattern)] if x}
    words = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}_]{{{HEAD},}}+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: F.substring(w, 1, HEAD).isin(*sorted(heads) or [""])), " ")


def _worth(demand: list[tuple[str, bool]]) -> tuple:
    """Orders demands: those of listed words first, then few and long texts."""
    length = min(len(x) for x, _ in demand)
    return (not all(_listed(*x) for x in demand), len(demand) if length > 3 else 50, -length)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lowered(text: Column) -> Column:
    """Lower-case; the long s is an s, as it is to a regex that folds case."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def literal_count(low: Column, literal: Column) -> Column:
    without = F.length(F.replace(low, literal, F.lit("")))
    return F.when(F.contains(low, literal), ((F.length(low) - without) / F.length(literal)).cast("int")).otherwise(F.lit(0))


def in_plan(rules: list[Rule]) -> list[int]:
    """Places of the rules in counts(): literals first."""
    return [k for k, r in enumerate(rules) if r.kind == "lit"] + [k for k, r in enumerate(rules) if r.kind != "lit"]


def counts(rules: list[Rule], text: Column, low: Column, near: Column) -> Column:
    """array<int>: matches of each rule, in the order of in_plan().  low and near: columns of lowered() and near_words()."""
    literals = [r.pattern.lower() for r in rules if r.kind == "lit"]
    asked = F.lit([literal_demand(x) for x in literals])
    others = [rule_count(r, text, low, near) for r in rules if r.kind != "lit"]
    once = lambda x, k: F.when(F.contains(near, F.get(asked, k)), literal_count(low, x)).otherwise(F.lit(0))
    parts = [F.transform(F.lit(literals), once)] if literals else []
    # an array within transform() is evaluated node by node; compiled, so many rules are a method too large for the JIT
    return F.concat(*parts, *([F.transform(F.array(*others), lambda n: n)] if others else []))


def fake_ranges(text: Column) -> Column:
    """Of each `from X to Y`, whether it is a false one: two different words, neither capitalised."""
    x, y = (T.find_all(text, FAKE_RANGE, k) for k in (1, 2))
    capital = lambda w: F.regexp_like(w, F.lit(r"\A\p{Lu}"))
    return F.zip_with(x, y, lambda a, b: (F.lower(a) != F.lower(b)) & ~capital(a) & ~capital(b))


def scan(docs: DataFrame, rules: list[Rule], key: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """docs -> key, text, rule_no, count: a row for each rule with a match."""
    base = docs.select(*key, F.col(text).alias("text"), lowered(F.col(text)).alias("__low"))
    base = base.withColumn("__near", near_words(rules, F.col("__low")))
    base = base.withColumn("__n", counts(rules, F.col("text"), F.col("__low"), F.col("__near"))).drop("__low", "__near")
    found = F.filter(F.transform("__n", lambda n, k: F.struct(k.alias("k"), n.alias("n"))), lambda x: x["n"] > 0)
    # outer: an inner one would match all rules once more, to drop texts without any
    base = base.select(*key, "text", F.explode_outer(found).alias("h")).where("h is not null")
    return base.select(*key, "text", F.element_at(F.lit(in_plan(rules)), F.col("h.k") + 1).alias("rule_no"), F.col("h.n").alias("count"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a dimension: a few hundred rows, whatever the data."""
    rows = [(k, r.category, r.name, r.fix, r.lift, r.hard, "" if r.kind == "builtin" and r.pattern == "fake_range" else r.jdk) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, category string, rule string, fix string, lift double, hard boolean, pattern string")


def hits(docs: DataFrame, rules: list[Rule], key: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """key, text, count and the rule's columns."""
    return scan(docs, rules, key, text).join(F.broadcast(rule_table(docs.sparkSession, rules)), "rule_no")


def dense_enough(found: DataFrame, rs: RuleSet, words: str = "words") -> DataFrame:
    """Bans by density count from two matches on, and only if more than one in so many words."""
    keep = F.lit(True)
    for name, per in rs.freq_bans.items():
        keep = keep & ((F.col("rule") != name) | ~F.col("hard") | ((F.col("count") >= 2) & (F.col("count") > F.col(words) / per)))
    return found.where(keep)


def muted(rs: RuleSet, genre: str) -> Column:
    bans, categories, rules = rs.muted(genre)
    within = lambda c, names: F.col(c).isin(*sorted(names)) if names else F.lit(False)
    return F.when(F.col("hard"), within("rule", bans)).otherwise(within("category", categories) | within("rule", rules))


def with_lines(found: DataFrame) -> DataFrame:
    """hits -> with `lines`, where matches stand, each line once.

    A match starts at its first letter or digit.  A mark is put there, and the lines with a mark are what is
    asked for: linear in the text and its matches.  The pattern is a column here, for there are few rows.
    """
    text = F.col("text")
    pattern = F.when(F.col("pattern") == "", F.lit(T.jdk(FAKE_RANGE))).otherwise(F.col("pattern"))
    clean = F.replace(text, F.lit(PLACE), F.lit(""))
    m, pieces = F.regexp_extract_all(clean, pattern, F.lit(0)), F.split(clean, pattern, F.lit(-1))
    keep = F.when(F.col("pattern") == "", fake_ranges(clean)).otherwise(F.transform(m, lambda x: F.lit(True)))
    found = found.withColumn("__m", F.arrays_zip(m.alias("m"), keep.alias("k"))).withColumn("__s", pieces)
    start = lambda x: F.when(F.regexp_like(x, F.lit(r"[\p{L}\p{Nd}]")), F.regexp_replace(x, r"\A([^\p{L}\p{Nd}]*)", "$1" + PLACE)).otherwise(F.concat(F.lit(PLACE), x))
    placed = F.transform("__m", lambda x: F.when(x["k"], start(x["m"])).otherwise(x["m"]))
    whole = F.array_join(F.zip_with("__s", placed, lambda s, x: F.concat(s, F.coalesce(x, F.lit("")))), "")
    at = F.transform(T.lines(whole), lambda x, k: F.when(F.contains(x, F.lit(PLACE)), k + 1))
    return found.withColumn("lines", F.filter(at, lambda k: k.isNotNull())).drop("__m", "__s")


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("category", "rule").agg(F.sum("count").cast("long").alias("hits"), F.count("*").alias("docs"))


__all__ = ["HARD", "by_rule", "counts", "dense_enough", "fake_ranges", "hits", "muted", "rule_count", "rule_table", "scan", "with_lines"]
