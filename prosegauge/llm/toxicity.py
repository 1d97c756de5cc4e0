"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every character n-gram of a word has an embedding in a hashed table; a window of words is the mean of its
n-grams' embeddings, and a softmax over two classes reads it.  Embeddings and softmax are trained together,
in numpy, so a misspelling that was never seen shares the vectors of the n-grams that were.

A document is as toxic as its worst window.  A label says only that a document has such a window, so training
starts from all windows of toxic documents and then keeps, of each, those that the model itself points to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import fold, small_batches, tidy, whole

GRAMS = (3, 4, 5)
BUCKETS, DIMENSIONS = 1 << 18, 4
#: Words of a window.
WINDOW = 16
#: Neutral n-grams that every mean has besides its own, so that two odd words are not yet a bad window.
NEUTRAL = 64
#: The bounded sample of labelled rows that the model is fitted on: rows labelled 0, and 1.
ROWS_PER_LABEL = (1600, 400)
#: ... and UTF-8 bytes of that sample; a row that doesn't fit any more stays out, whole.
SAMPLE_BYTES = 64 << 20
#: An n-gram that fewer texts of the sample have says nothing.
LEAST_TEXTS = 3
EPOCHS, RATE = 8, 4.0
#: Steps of gradient descent that even a small sample gets.
LEAST_STEPS = 600
AT_ONCE = 1 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD: dict[str, np.ndarray] = {}


def _alphabet() -> np.ndarray:
    """code point -> itself if a letter or digit, else a space."""
    if not _FOLD:
        _FOLD["all"] = np.array([c if chr(c).isalnum() else 32 for c in range(0x110000)], dtype=np.uint32)
    return _FOLD["all"]


def subwords(texts: list[str], window: int = WINDOW) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of n-gram, the bucket and the window of every n-gram; and the text of every window.

    Words are runs of letters and digits, with a space on either side; a word said again at once counts once.
    Every text has a window, maybe empty.
    """
    longest = max(GRAMS)
    gap = " " * longest
    low = [t.lower() for t in texts]
    codes = _alphabet()[np.frombuffer((gap + gap.join(low) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    starts = longest + np.concatenate(([0], np.cumsum([len(t) + longest for t in low])))[:-1].astype(np.int64)
    space = codes == 32
    begins = ~space
    begins[1:] &= space[:-1]
    word_at = np.cumsum(begins, dtype=np.int32) - 1  # at a letter: its word
    begin = np.flatnonzero(begins)
    word_text = np.searchsorted(starts, begin, side="right") - 1
    new = _changes(codes, begin, word_at) | np.concatenate(([True], word_text[1:] != word_text[:-1]))[: len(begin)]
    count = np.bincount(word_text, weights=new, minlength=len(texts)).astype(np.int64)
    n_windows = np.maximum(1, -(-count // window))
    base = np.cumsum(n_windows) - n_windows
    place = np.cumsum(new) - 1 - (np.cumsum(count) - count)[word_text]
    word_window = np.where(new, base[word_text] + place // window, -1).astype(np.int32)
    out = []
    n = len(codes) - longest + 1
    h = np.zeros(n, dtype=np.uint64)
    inner = np.zeros(n, dtype=bool)
    for k in range(longest):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + n]
        h += np.uint64(1)
        if k + 1 in GRAMS:
            # a gram may start or end with the space beside a word, but not hold one inside
            at = np.flatnonzero(~inner)
            x = h[at]
            x += np.uint64(k + 1)
            x ^= x >> np.uint64(31)
            x *= _MIX
            w = word_window[word_at[at + 1]]
            own = w >= 0
            out.append(((x[own] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), w[own]))
        if k:
            inner |= space[k : k + n]
    return out, np.repeat(np.arange(len(texts)), n_windows)


def _changes(codes: np.ndarray, begin: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Whether each word differs from the one before it."""
    if not len(begin):
        return np.zeros(0, dtype=bool)
    letters = np.flatnonzero(codes != 32)
    word = word_at[letters]
    x = (codes[letters] + ((letters - begin[word]).astype(np.uint64) << np.uint64(24))) * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    code = np.add.reduceat(x, first)
    return np.concatenate(([True], code[1:] != code[:-1]))


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE characters."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _all_subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams, window by window; the text of every window; and of how many texts each bucket is."""
    bs, ws, ts, texts_with = [], [], [], np.zeros(BUCKETS, dtype=np.int32)
    windows = 0
    for at, upto in _batches(texts):
        grams, text_of = subwords(texts[at:upto])
        b, w = (np.concatenate([g[k] for g in grams]) for k in (0, 1))
        order = np.argsort(w, kind="stable")
        b, w = b[order], w[order]
        texts_with += np.bincount(np.unique(text_of[w].astype(np.int64) * BUCKETS + b) % BUCKETS, minlength=BUCKETS).astype(np.int32)
        bs.append(b)
        ws.append(w + np.int32(windows))
        ts.append((text_of + at).astype(np.int32))
        windows += len(text_of)
    return np.concatenate(bs), np.concatenate(ws), np.concatenate(ts), texts_with


def _mean(values: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(w, weights=values, minlength=n) / (NEUTRAL + np.bincount(w, minlength=n))


@dataclass
class Model:
    """The softmax of a mean is a logistic of the mean of one number for each bucket: `logit`."""

    logit: np.ndarray
    bias: float

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, text_of = subwords(texts)
        total, size = np.zeros(len(text_of)), np.zeros(len(text_of), dtype=np.int64)
        for b, w in grams:
            total += np.bincount(w, weights=self.logit[b], minlength=len(text_of))
            size += np.bincount(w, minlength=len(text_of))
        return total / (NEUTRAL + size) + self.bias, text_of

    def score(self, texts: list[str]) -> np.ndarray:
        z, text_of = self.windows(texts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text_of, z)
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def _fit(b: np.ndarray, w: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Joint gradient descent on embeddings and softmax; w numbers the windows from 0, ascending."""
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, DIMENSIONS), dtype=np.float32) - 0.5) / 100
    soft = np.full((DIMENSIONS, 2), 0.5, dtype=np.float32) + rng.random((DIMENSIONS, 2), dtype=np.float32) / 10
    soft[:, 0] *= -1
    bias = np.zeros(2, dtype=np.float32)
    size = (NEUTRAL + np.bincount(w, minlength=len(y))).astype(np.float32)
    bounds = np.searchsorted(w, np.arange(len(y) + 1))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32) * len(y)
    order = np.arange(len(y))
    batch = 128
    epochs = max(EPOCHS, -(-LEAST_STEPS * batch // max(1, len(order))))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            rows = rows[bounds[rows + 1] > bounds[rows]]
            if not len(rows):
                continue
            n = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(n)
            idx = b[np.repeat(bounds[rows] - (ends - n), n) + np.arange(ends[-1])]
            bag = np.add.reduceat(table[idx], ends - n, axis=0) / size[rows, None]
            z = bag @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None]
            back = (p @ soft.T) / size[rows, None]
            soft -= rate * 0.05 * (bag.T @ p) / len(rows)
            bias -= rate * 0.05 * p.mean(axis=0)
            np.add.at(table, idx, -rate * np.repeat(back, n, axis=0))
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Two rounds: all windows of toxic texts, then only those that the first model takes for toxic."""
    y_text = np.array(labels, dtype=np.int64)
    if not len(texts) or y_text.min() == y_text.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), -4.0 if not len(texts) or y_text.max() == 0 else 4.0)
    b, w, text_of, texts_with = _all_subwords(texts)
    y = y_text[text_of]
    known = texts_with >= min(LEAST_TEXTS, len(texts))
    for _ in range(2):
        use = y >= 0
        renumber = (np.cumsum(use) - 1).astype(np.int32)
        mine = use[w]
        logit, bias = _fit(b[mine], renumber[w[mine]], y[use], seed)
        logit[~known] = 0
        z = _mean(logit[b], w, len(text_of)) + bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text_of, z)
        toxic = y_text[text_of] == 1
        clean_top = np.quantile(z[~toxic], 0.995)
        # a window of a toxic text counts as toxic if it is its worst, or worse than clean ones get
        y = np.where(~toxic, 0, np.where((z >= best[text_of]) | (z > clean_top), 1, -1))
    clean, bad = np.sort(best[y_text == 0]), np.sort(best[y_text == 1])
    # between what nearly all clean texts stay under and what nearly all toxic ones pass
    low, high = np.quantile(clean, 0.995), np.quantile(bad, 0.05)
    middle = (low + high) / 2 if high > low else low
    scale = 4 / max(0.25, (high - low) / 2) if high > low else 4.0
    return Model(logit * np.float32(scale), float((bias - middle) * scale))


def sample(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = ROWS_PER_LABEL) -> DataFrame:
    """text, toxic: at most `rows` learnable rows of each label, chosen by hash of doc_id."""
    ids = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    few = ids.where("toxic = 1").orderBy("order", "doc_id").limit(rows[1]).unionByName(ids.where("toxic = 0").orderBy("order", "doc_id").limit(rows[0]))
    few = few.select("doc_id", "toxic").collect()  # sum(rows) ids at most
    chosen = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in few], "doc_id long, toxic int")
    return docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = ROWS_PER_LABEL) -> Model:
    """Fit on the driver on sample(); a label whose doc_id has no document, or a null one, teaches nothing."""
    chosen = sample(docs, labels, rows)
    sizes = chosen.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("n")).withColumn("order", F.xxhash64("doc_id"))
    left, ids = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}, []
    for r in sorted(sizes.collect(), key=lambda r: (r["order"], r["doc_id"])):  # sum(rows) at most
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            ids.append((r["doc_id"],))
    fits = docs.sparkSession.createDataFrame(ids, "doc_id long")
    got = chosen.join(F.broadcast(fits), "doc_id", "left_semi").orderBy("doc_id", "text").toArrow()
    return fit(got["text"].to_pylist(), got["toxic"].to_pylist())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted.

    Null text counts as empty and gets the score of an empty window.  Whole texts are read; rows may repeat;
    an empty table gives an empty result; other columns aren't read.  The broadcast model has a fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), whole(F.col("text")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = said.value
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = [m.score(texts[at:upto]) for at, upto in _batches(texts)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidy(run), f"doc_id {id_type}, held_out boolean, score double, predicted int")
