"""Language identification by n-gram filters with a bit for each language.

One Bloom filter holds the n-grams of all languages: every position is a bit mask over languages (the filters
of all languages, bit-sliced), so the AND of the masks at an n-gram's positions gives all languages that
contain it at once.  A text's score for a language is how many of its n-grams that language contains, less
the false positives to be expected from how full the language's slice is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import power_of_two, small_batches, tidy

#: Character n-grams of words, a space on either side of each word.
NGRAM = 4
#: Positions of the filters at least, positions for each n-gram of the language that has most, and hashes.
POSITIONS, ROOM, HASHES = 1 << 20, 16, 3
#: The bounded sample of labelled rows that the filters are fitted on: texts of each language.
TEXTS_PER_LANGUAGE = 600
#: What it is for a language to contain an n-gram: this share of its sampled texts has it.  All such n-grams are
#: kept; there are at most 1 / LEAST_SHARE times as many as a sampled text has on average.
LEAST_SHARE = 0.02
#: Code points worked on at once.
AT_ONCE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: dict[str, np.ndarray] = {}


def _alphabet() -> np.ndarray:
    """code point -> itself if it is a letter, else a space."""
    if not _LETTERS:
        _LETTERS["all"] = np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)
    return _LETTERS["all"]


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, in order, and how many each text has.  None spans two words."""
    gap = " " * NGRAM
    joined = gap + gap.join(t.lower() for t in texts) + gap
    codes = _alphabet()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + NGRAM)
    space = codes == 32
    n = len(codes) - NGRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(NGRAM):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n].astype(np.uint64)
    inner = np.zeros(n, dtype=bool)
    for k in range(1, NGRAM - 1):
        inner |= space[k : k + n]
    # " ab " is a whole short word; a gram needs two letters at least, and no space between letters
    ok = ~inner
    where = np.flatnonzero(ok)
    h = h[where]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h, np.searchsorted(ends, where, side="right")


def positions(h: np.ndarray, m: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(m)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """masks: one unsigned word of bits for each position and 64 languages."""

    languages: list[str]
    masks: np.ndarray  # lanes x positions
    chance: np.ndarray  # of a false positive, for each language

    @classmethod
    def fit(cls, languages: list[str], grams: list[np.ndarray], m: int = POSITIONS) -> Filters:
        m = max(m, power_of_two(ROOM * max(len(own) for own in grams)))
        lanes = max(1, -(-len(languages) // 64))
        masks = np.zeros((lanes, m), dtype=np.uint64)
        chance = np.zeros(len(languages))
        for at, own in enumerate(grams):
            for p in positions(own.view(np.uint64), m):
                masks[at // 64, p] |= np.uint64(1 << (at % 64))
            filled = np.mean((masks[at // 64] >> np.uint64(at % 64)) & np.uint64(1))
            chance[at] = filled**HASHES
        if len(languages) <= 8:
            masks = masks.astype(np.uint8)
        return cls(languages, masks, chance)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: n-grams that the language contains, corrected; and n-grams of each text."""
        h, of = ngrams(texts)
        total = np.bincount(of, minlength=len(texts))[: len(texts)].astype(float)
        found = positions(h, self.masks.shape[1])
        out = np.zeros((len(texts), len(self.languages)))
        for lane in range(self.masks.shape[0]):
            bits = self.masks[lane][found[0]]
            for p in found[1:]:
                bits &= self.masks[lane][p]
            for at in range(64 * lane, min(len(self.languages), 64 * lane + 64)):
                on = (bits >> bits.dtype.type(at % 64)) & bits.dtype.type(1)
                out[:, at] = np.bincount(of, weights=on, minlength=len(texts))[: len(texts)]
        return np.maximum(0, (out - total[:, None] * self.chance) / (1 - self.chance)), total

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        full = [t or "" for t in texts]
        corrected, total = self.hits(full)
        best = corrected.argmax(axis=1)
        rows = np.arange(len(full))
        share = np.where(total > 0, corrected[rows, best] / np.maximum(total, 1), 0.0)
        return [self.languages[b] for b in best], np.clip(share, 0.0, 1.0).tolist()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = np.unique(ngrams([text])[0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], ["lang", "h"])


def train(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, share: float = LEAST_SHARE) -> Filters | None:
    """docs (text, lang): fit on `texts` texts of each language, chosen by hash.  None without any labelled text.

    Only texts with a letter count; very long ones count whole.  What comes to the driver are the n-grams that
    languages contain: no more for a language than 1 / share times what a text of its sample has on average.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("text", "doc_id").alias("order"))
    # thinned where it lies, by a threshold on the hash that leaves about twice the sample of each language
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("limit", (F.lit(2.0 * texts) / F.col("n") - 0.5) * F.lit(2.0**64))
    rows = known.join(F.broadcast(sizes), "lang").where(F.col("order") < F.col("limit"))
    order = Window.partitionBy("lang").orderBy("order", "text")
    picked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= texts).select("lang", "text")
    picked = picked.repartition(F.xxhash64("text"))
    sets = picked.select("lang", F.lit(None).cast("long").alias("h")).unionByName(picked.mapInArrow(tidy(_sets), "lang string, h long"))
    counts = sets.groupBy("lang", "h").agg(F.count("*").alias("n"))
    size = Window.partitionBy("lang")
    counts = counts.withColumn("texts", F.max(F.when(F.col("h").isNull(), F.col("n"))).over(size)).where("h is not null")
    counts = counts.where(F.col("n") >= F.greatest(F.lit(1), F.col("texts") * F.lit(share)))
    found = counts.select("lang", "h").toArrow().to_pandas()
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    return Filters.fit(languages, [found["h"][found["lang"] == x].to_numpy(dtype=np.int64) for x in languages])


def identified(docs: DataFrame, filters: Filters | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text and `keep`) -> kept (struct), lang_pred, score.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned.  A text none of whose
    n-grams is known gets the first language with score 0.  Whole texts are read; rows may repeat; an empty
    table gives an empty result.  What is broadcast grows with the number of languages alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*keep).alias("kept"), F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    said = spark.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = said.value
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = [], []
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= AT_ONCE):
                    size += len(texts[upto] or "")
                    upto += 1
                part = texts[at:upto]
                if model is None:
                    got, how = ["und"] * len(part), [0.0] * len(part)
                else:
                    got, how = model.decide(part)
                langs += [x if t is not None else "und" for x, t in zip(got, part, strict=True)]
                scores += [x if t is not None else 0.0 for x, t in zip(how, part, strict=True)]
                at = upto
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    kept_type = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(tidy(predict), f"kept {kept_type}, lang_pred string, score double")
