"""Language-model scoring by a hierarchical Pitman-Yor model.

A text is words and one end.  Every word that occurs in training, and the end, has a context restaurant, where
the tokens that follow it are customers and their words are dishes.  All context restaurants share one parent,
in which each of their tables is a customer; its base is uniform over the words of training and one more, which
stands for every word that training lacks.  A text starts after an end.

Seating is sampled by Gibbs.  What a seating says of a cell (restaurant, dish) with c customers is its number of
tables t.  With x ~ Gamma(strength / discount + tables of the restaurant), the cells of a restaurant are
independent given x, and P(t) ~ (discount * x * base)^t S(c, t), S being generalised Stirling numbers.  So a sweep
seats every customer of every cell anew, whatever their number, and cells of one restaurant needn't share a task.
Up to EXACT customers t is drawn from that law itself; beyond, from a binomial with the law's saddle-point mean
and variance.  Strengths and discounts are drawn after every sweep from their conditionals on a grid; that of a
discount counts the cells of up to EXACT customers.  Predictive probabilities are averaged over several seatings.

Cells are dealt to buckets by context (those of a frequent context also by dish), words to owners; both are
tables of packed arrays in the shared folder, bucketed for good, and so is every seating.  Owners tell buckets how many customers
and tables a word has in the parent, buckets tell owners how many tables it got.  Only totals of fixed size, and
one number for each frequent context of a bucket, come to the driver.  All cells are kept: what is gathered
grows with the corpus.  Words are told apart by 64 bits of hash; two of n words share one with chance n^2 / 2^65.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import dropped, fold, power_of_two, released, small_batches, staged, whole, work_folder

#: Buckets that are dealt to together, so that they share a list of words.
TOGETHER = 4
#: Bytes of text to a bucket, tokens and documents that are packed together, bytes that are split at once.
BUCKET_BYTES, CHUNK_TOKENS, CHUNK_DOCS, AT_ONCE = 6 << 20, 1_500_000, 60_000, 1 << 20
BATCH_BYTES = 2 << 20
#: Texts that frequent contexts are looked for in.  Which are found changes where work is done, not the result.
SAMPLED = 4000
#: Cells of up to so many customers get their tables from the exact law.
EXACT = 128
BURN_IN, SAMPLES = 3, 3
#: Of the hyperparameters.
DISCOUNTS, STRENGTHS = np.arange(0.05, 0.96, 0.025), np.geomspace(0.001, 500, 48)
#: The hash of the end; words have others.
END = np.uint64(0)

ROWS = "bucket int, q int, chunk long, kind string, key long, n double, body binary"
_TYPES = ["<i4", "<i8", "<u8", "<f4", "<f8", "<u2", "|u1"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, after their length: they are small on disk, in shuffles and in batches.

    First bytes of an array's items stand together, then second ones: the high ones are much alike.
    """
    head = [len(arrays)]
    for a in arrays:
        head += [_TYPES.index(a.dtype.str), len(a)]
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    raw = np.array(head, dtype="<i8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes | pa.Buffer) -> list[np.ndarray]:
    body = pa.py_buffer(body)
    body = pa.decompress(body.slice(8), int.from_bytes(body.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    n = int(np.frombuffer(body, "<i8", 1)[0])
    head, at, out = np.frombuffer(body, "<i8", 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2):
        of = np.dtype(_TYPES[kind])
        planes = np.frombuffer(body, np.uint8, size * of.itemsize, at).reshape(of.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(of).reshape(size))
        at += planes.nbytes
    return out


def _table(rows: list[tuple]) -> pa.Table:
    """rows of ROWS, in batches of about BATCH_BYTES; the list is used up."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.binary())
    schema = pa.schema(list(zip(["bucket", "q", "chunk", "kind", "key", "n", "body"], kinds, strict=True)))
    batches = []
    while rows:
        upto, size = 0, 0
        while upto < len(rows) and size < BATCH_BYTES:
            size += 40 + len(rows[upto][-1] or b"")
            upto += 1
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[:upto], strict=True), kinds, strict=True)], schema=schema))
        del rows[:upto]
    return pa.Table.from_batches(batches, schema)


def _totals(kind: str, keys: np.ndarray, n: np.ndarray | None = None) -> list[tuple]:
    """Rows that the driver gets the sums of, by key."""
    if n is None:
        keys, n = np.unique(keys, return_counts=True)
    return [(-1, None, None, f"total {kind}", int(k), float(x), None) for k, x in zip(keys, n, strict=True)]


# words


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte a number, A-Z like a-z; and whether it is white space."""
    code = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code[65:91] = code[97:123]
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    code[space] = 0
    return code, space


_POWER = {"all": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> np.ndarray:
    if len(_POWER["all"]) < n:
        p = np.full(power_of_two(n), 0x9E3779B97F4A7C15, dtype=np.uint64)
        p[0] = 1
        _POWER["all"] = np.multiply.accumulate(p)
    return _POWER["all"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token, an END after each text; and how many tokens each text has."""
    code, space = _codes()
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = space[data]
    first = ~blank
    first[1:] &= blank[:-1]
    start = np.flatnonzero(first)
    of = np.searchsorted(ends, start, side="right")
    count = np.bincount(of, minlength=len(texts)) + 1
    out = np.full(int(count.sum()), END, dtype=np.uint64)
    if len(start):
        data = data[start[0] :]
        start -= start[0]
        # a word and the white space after it, which counts as nothing
        place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(np.append(start, len(data))))
        h = code[data]
        h *= _powers(int(place.max()) + 1)[place]
        h = mixed(np.add.reduceat(h, start))
        out[np.arange(len(start)) + of] = np.where(h == END, np.uint64(1), h)
    return out, count


# seating


@lru_cache(maxsize=64)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c and t up to most: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + out[c], -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_tables(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells: P(t) ~ weight^t S(c, t)."""
    out = np.minimum(c, 1).astype(np.int64)
    weight = np.maximum(weight, 1e-300)
    table = stirling(d)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        cells = order[bounds[k - 2] : bounds[k - 1]]
        t = np.arange(1, k + 1)
        for at in range(0, len(cells), step := max(1, (1 << 20) // k)):
            own = cells[at : at + step]
            p = np.log(weight[own])[:, None] * t + table[k, 1 : k + 1]
            p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[own] = 1 + (p < (rng.random(len(own)) * p[:, -1])[:, None]).sum(axis=1)
    if len(many := order[bounds[-1] :]):
        n, w = c[many].astype(float), weight[many]
        low, high = np.full(len(many), -700.0), np.zeros(len(many))
        for _ in range(60):  # where the mean of all customers is n: w (1 - y) y^(d - 1) = n
            y = (low + high) / 2
            over = np.log(w) + np.log(np.maximum(-np.expm1(y), 1e-300)) + (d - 1) * y > np.log(n)
            low, high = np.where(over, y, low), np.where(over, high, y)
        y = np.exp((low + high) / 2)
        mean = np.maximum(w * -np.expm1(d * np.log(y)) / d, 1e-12)
        spread = np.clip(mean - n * y / (1 - d + d * y), 0.02 * mean, 0.9999 * mean)
        tries = np.maximum(1, np.round(mean / (1 - spread / mean))).astype(np.int64)
        out[many] = np.minimum(c[many], 1 + rng.binomial(tries, np.minimum(1.0, mean / tries)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift - np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@dataclass
class Hyper:
    """Discount and strength of a level."""

    discount: float = 0.75
    strength: float = 1.0

    def drawn(self, tables: dict[int, float], customers: dict[int, float], cells: dict[int, float], rng: np.random.Generator) -> Hyper:
        """tables, customers: how many restaurants have so many; cells: how many cells have c * (EXACT + 1) + t."""
        if not tables:
            return self
        t, nt = (np.array(list(x), dtype=float) for x in (tables.keys(), tables.values()))
        c, nc = (np.array(list(x), dtype=float) for x in (customers.keys(), customers.values()))
        both, n = np.array(list(cells.keys()), dtype=np.int64), np.array(list(cells.values()))

        def seats(d: float, s: float) -> float:
            return float((nt * (t * np.log(d) + log_gamma(s / d + t) - log_gamma(np.array([s / d])))).sum())

        def pick(logs: list[float]) -> int:
            p = np.exp(np.array(logs) - max(logs))
            return int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))

        strength = float(STRENGTHS[pick([seats(self.discount, s) - float((nc * (log_gamma(s + c) - log_gamma(np.array([s])))).sum()) - s / 100 for s in STRENGTHS])])
        shapes = [float((n * stirling(round(float(d), 3))[both // (EXACT + 1), both % (EXACT + 1)]).sum()) if len(both) else 0.0 for d in DISCOUNTS]
        discount = round(float(DISCOUNTS[pick([seats(d, strength) + shape for d, shape in zip(DISCOUNTS, shapes, strict=True)])]), 3)
        return Hyper(discount, strength)


def coarse(x: np.ndarray) -> np.ndarray:
    """Whole numbers to about one part in 64, so that there are few different ones."""
    x = x.astype(np.int64)
    shift = np.maximum(0, np.frexp(x.astype(float))[1] - 7)
    return x >> shift << shift


def _histogram(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    small = (c <= EXACT) & (c > 1)
    return c[small].astype(np.int64) * (EXACT + 1) + t[small]


@dataclass
class State:
    """What the driver knows of a seating: hyperparameters, totals of the parent, frequent contexts."""

    low: Hyper = field(default_factory=Hyper)
    top: Hyper = field(default_factory=Hyper)
    words: int = 0
    tokens: int = 0
    customers: float = 0.0  # of the parent
    tables: float = 0.0
    hot_customers: np.ndarray | None = None
    hot_tables: np.ndarray | None = None

    def parent(self, own: np.ndarray) -> np.ndarray:
        """Probabilities of words with so many customers less discounts in the parent."""
        new = (self.top.strength + self.top.discount * self.tables) / (self.words + 1)
        return (own + new) / (self.top.strength + self.customers)

    def predict(self, c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Of a dish in a restaurant: c, t of the cell; customers, tables of the restaurant."""
        own = np.maximum(0.0, c - self.low.discount * t)
        return (own + (self.low.strength + self.low.discount * tables) * parent) / (self.low.strength + customers)


@dataclass
class Plan:
    """How cells are dealt."""

    buckets: int
    owners: int
    dealt: int  # groups of TOGETHER buckets
    hot: np.ndarray  # hashes of frequent contexts, ascending ...
    spread: np.ndarray  # ... and over how many buckets each goes
    seed: int

    def parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts: over how many parts each is spread, the number of its first part, and each part's bucket."""
        hot = self.places(words)
        spread = np.where(hot >= 0, self.spread[hot] if len(self.spread) else 1, 1)
        begin = np.cumsum(spread) - spread
        own = np.repeat((mixed(words + np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64), spread)
        return spread, begin, (own + np.arange(len(own)) - np.repeat(begin, spread)) % self.buckets

    def places(self, u: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.full(len(u), -1)
        at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
        return np.where(self.hot[at] == u, at, -1)

    def slices(self, w: np.ndarray) -> np.ndarray:
        """Where each owner's words begin in w, ascending; owners have equal ranges of hashes."""
        shift = 64 - (self.owners.bit_length() - 1)
        owner = (w >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(w), dtype=np.int64)
        return np.searchsorted(owner, np.arange(self.owners + 1))

    def rng(self, *of: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, *of])


# buckets


def _dealt(batches: Iterator[pa.RecordBatch], plan: Plan, posts: bool) -> Iterator[pa.RecordBatch]:
    """(digest, text, learn) -> one row for TOGETHER buckets of a chunk: their pairs of words, and how often they
    are learned or, for posts, which documents have them; and for posts one row on the documents."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    digests: list[bytes] = []
    learn: list[bool] = []
    size = 0

    def chunk() -> Iterator[pa.RecordBatch]:
        nonlocal number
        count = np.concatenate([n for _, n in held])
        w, words = pd.factorize(np.concatenate([t for t, _ in held]))
        held.clear()
        order = np.argsort(words)
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        words, w = words[order], rank[w]
        u = np.concatenate((np.searchsorted(words, [END]), w[:-1]))
        spread, part_of, bucket_of = plan.parts(words)
        part_of = part_of[u]
        if (spread > 1).any():
            some = np.flatnonzero(spread[u] > 1)
            part_of[some] += (mixed(words[w[some]] + np.uint64(2)) % spread[u[some]].astype(np.uint64)).astype(np.int64)
        # parts by bucket; then a part, a word and a document are one number
        by_bucket = np.argsort(bucket_of, kind="stable")
        rank = np.empty(len(by_bucket), dtype=np.uint64)
        rank[by_bucket] = np.arange(len(by_bucket), dtype=np.uint64)
        context_of = np.repeat(np.arange(len(words)), spread)[by_bucket]
        bucket_of = bucket_of[by_bucket]
        key = rank[part_of]
        del u, part_of, rank
        key <<= np.uint64(22)
        key |= w.astype(np.uint64)
        del w
        key <<= np.uint64(16)
        key |= np.repeat(np.arange(len(count), dtype=np.uint64), count)
        key.sort()
        of = key.astype(np.uint16)
        key >>= np.uint64(16)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(new, len(key))).astype(np.int32)
        learned = np.add.reduceat(np.array(learn, dtype=np.int32)[of], new)
        key = key[new]
        part, w = (key >> np.uint64(22)).astype(np.int64), (key & np.uint64(0x3FFFFF)).astype(np.int32)
        del key
        run = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))  # of one part
        bucket = bucket_of[part]
        name = int.from_bytes(hashlib.blake2b(b"".join(digests) + b"%d %d" % (task, number), digest_size=8).digest(), "little", signed=True)
        number += 1
        pairs_upto = np.searchsorted(bucket, np.arange(plan.dealt * TOGETHER + 1))
        runs_upto = np.searchsorted(run, pairs_upto)
        for k in range(plan.dealt):
            cuts, own_runs = pairs_upto[k * TOGETHER : (k + 1) * TOGETHER + 1], runs_upto[k * TOGETHER : (k + 1) * TOGETHER + 1]
            a, b = int(cuts[0]), int(cuts[-1])
            if a == b:
                continue
            first = run[own_runs[0] : own_runs[-1]]
            own, at = np.unique(w[a:b], return_inverse=True)
            body = [words[context_of[part[first]]], np.diff(np.append(first, b)).astype(np.int32), words[own], at.astype(np.uint16 if len(own) <= 65536 else np.int32), cuts - a, own_runs - own_runs[0]]
            if posts:
                upto = new[b] if b < len(new) else len(of)
                body += [n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.int32), of[new[a] : upto], np.array([len(count)], dtype=np.int32)]
            else:
                body.append(learned[a:b])
            yield from _table([(k, None, name, "pairs", None, None, pack(*body))]).to_batches()
        if posts:
            yield from _table([(abs(name) % plan.dealt, None, name, "docs", None, None, pack(np.frombuffer(b"".join(digests), dtype=np.uint8), count.astype(np.int64)))]).to_batches()

    for b in batches:
        texts, at = b.column("text").to_pylist(), 0
        flags, ids = b.column("learn").to_pylist(), b.column("digest").to_pylist()
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and (upto == at or n + len(texts[upto]) <= AT_ONCE):
                n += len(texts[upto])
                upto += 1
            if held and (size + n // 4 > CHUNK_TOKENS or len(digests) + upto - at > CHUNK_DOCS):
                yield from chunk()
                digests, learn, size = [], [], 0
                released()
            held.append(tokens(texts[at:upto]))
            digests += ids[at:upto]
            learn += flags[at:upto]
            size += len(held[-1][0])
            at = upto
    if held:
        yield from chunk()
    released()


def _bodies(rows: pa.Table, kind: str) -> list[list[np.ndarray]]:
    """Unpacked bodies of a kind, by owner if they have one."""
    at = [k for k, x in enumerate(rows.column("kind").to_pylist()) if x == kind]
    owner, body = rows.column("q").to_pylist(), rows.column("body")
    return [unpack(body[k].as_buffer()) for k in sorted(at, key=lambda k: -1 if owner[k] is None else owner[k])]


def _own(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that are pointed at, and where they are then."""
    used = np.zeros(len(words), dtype=bool)
    used[at] = True
    return words[used], (np.cumsum(used) - 1)[at]


def _of_bucket(body: list[np.ndarray], k: int) -> list[np.ndarray]:
    """What dealt pairs have for the kth of their buckets."""
    u, runs, words, at, cuts, own_runs, *more = body
    (a, b), (c, d) = cuts[k : k + 2], own_runs[k : k + 2]
    out = [u[c:d], runs[c:d], words, at[a:b]]
    if len(more) == 1:
        return [*out, more[0][a:b]]
    n, of, docs = more
    ends = np.cumsum(n[:b], dtype=np.int64)
    lo, hi = (int(ends[x - 1]) if x else 0 for x in (a, b))
    return [*out, n[a:b], of[lo:hi], docs]


def _merged(rows: pa.Table, plan: Plan) -> pa.Table:
    """Dealt pairs -> the cells of each bucket, a first seating with a table for each, and what owners must know."""
    dealt = rows.column("bucket")[0].as_py()
    bodies = _bodies(rows, "pairs")
    out = []
    for k in range(TOGETHER):
        parts = [p for p in (_of_bucket(body, k) for body in bodies) if len(p[3])]
        if parts:
            out.append(_table(_merged_one(dealt * TOGETHER + k, parts, plan)))
    return pa.concat_tables(out)


def _merged_one(bucket: int, parts: list[list[np.ndarray]], plan: Plan) -> list[tuple]:
    parts = [[u, runs, *_own(words, at), c] for u, runs, words, at, c in parts]
    contexts, words = (np.unique(np.concatenate([p[k] for p in parts])) for k in (0, 2))
    cell = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]) << 32, p[1]) | np.searchsorted(words, p[2])[p[3]] for p in parts])
    c = np.concatenate([p[4] for p in parts])
    order = np.argsort(cell, kind="stable")
    cell, c = cell[order], c[order]
    del order
    new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    c = np.add.reduceat(c, new).astype(np.int32)
    cell = cell[new]
    ui, wi = (cell >> 32).astype(np.int32), (cell & 0xFFFFFFFF).astype(np.int32)
    del cell, new
    many = np.flatnonzero(c > 1)
    ones = np.bincount(ui[c == 1], minlength=len(contexts)).astype(np.int32)
    customers = np.bincount(ui, weights=c, minlength=len(contexts)).astype(np.int64)
    deep = np.bincount(ui[many], minlength=len(contexts)).astype(np.int32)
    said = np.bincount(wi[c == 1], minlength=len(words)).astype(np.int64)
    count = np.bincount(wi, weights=c, minlength=len(words)).astype(np.int64)
    sums = np.bincount(wi[many], minlength=len(words)).astype(np.int32)
    hot = plan.places(contexts)
    at = np.flatnonzero(hot >= 0)
    cuts = plan.slices(words)
    out = [
        (bucket, None, None, "cells", None, None, pack(contexts, words, np.bincount(ui, minlength=len(contexts)).astype(np.int32), wi, c)),
        (bucket, None, None, "many", None, None, pack(deep, wi[many], c[many], ones, at, hot[at], cuts)),
        (bucket, None, None, "seats", None, None, pack(np.ones(len(many), dtype=np.int32), ones + deep)),
    ]
    for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            out.append((bucket, q, None, "words", None, None, pack(words[a:b], said[a:b], count[a:b])))
            out.append((bucket, q, None, "sums", None, None, pack(sums[a:b])))
    cold = (hot < 0) & (customers > 0)
    out += _totals("customers", coarse(customers[cold])) + _totals("tables", coarse((ones + deep)[cold]))
    out += _totals("hot customers", hot[at], customers[at]) + _totals("hot tables", hot[at], (ones + deep)[at])
    return out


def _vocabulary(rows: pa.Table) -> pa.Table:
    """What buckets say of an owner's words -> their totals, where each bucket's words stand, and counts for all."""
    q = rows.column("q")[0].as_py()
    rows = rows.sort_by("bucket")
    buckets = rows.column("bucket").to_pylist()
    parts = [unpack(x) for x in rows.column("body").to_pylist()]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    said, count = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(words)).astype(np.int64) for k in (1, 2))
    sizes = np.array([len(p[0]) for p in parts])
    out = [(-1, q, None, "owned", None, None, pack(said, at.astype(np.int32), np.array(buckets), sizes))]
    for bucket, own in zip(buckets, np.split(at, np.cumsum(sizes)[:-1]), strict=True):
        out.append((bucket, q, None, "counts", None, None, pack(count[own])))
    return _table(out + _totals("words", np.zeros(1), np.array([float((count > 0).sum())])) + _totals("tokens", np.zeros(1), np.array([float(count.sum())])))


def _parent(rows: pa.Table, plan: Plan, state: State, number: int) -> pa.Table:
    """Tables that an owner's words got in buckets -> the parent's seating of them, told to the buckets."""
    q = rows.column("q")[0].as_py()
    said, at, buckets, sizes = _bodies(rows, "owned")[0]
    ends = np.cumsum(sizes)
    place = {int(b): (int(e - n), int(e)) for b, e, n in zip(buckets, ends, sizes, strict=True)}
    count = said.copy()
    for kind, bucket, body in zip(*(rows.column(x).to_pylist() for x in ("kind", "bucket", "body")), strict=True):
        if kind == "sums":
            a, b = place[bucket]
            count[at[a:b]] += unpack(body)[0]  # a bucket has a word once
    rng = plan.rng(1, number, q)
    x = plan.rng(2, number).gamma(state.top.strength / state.top.discount + state.tables)
    t = draw_tables(count, np.full(len(count), state.top.discount * x / (state.words + 1)), state.top.discount, rng)
    own = np.maximum(0, count - state.top.discount * t).astype(np.float32)
    out = [(b, q, None, "parent", None, None, pack(own[at[lo:hi]])) for b, (lo, hi) in place.items()]
    out += _totals("parent customers", np.zeros(1), np.array([float(count.sum())])) + _totals("parent tables", np.zeros(1), np.array([float(t.sum())]))
    return _table(out + _totals("parent cells", _histogram(count, t)))


def _seated(rows: pa.Table, plan: Plan, state: State, number: int) -> pa.Table:
    """A sweep over a bucket: all cells are seated anew, given their restaurants' x and the parent."""
    bucket = rows.column("bucket")[0].as_py()
    deep, wi, c, ones, at, hot, cuts = _bodies(rows, "many")[0]
    _, before = _bodies(rows, "seats")[0]
    parent = state.parent(np.concatenate([x[0] for x in _bodies(rows, "parent")]).astype(float))
    rng, d = plan.rng(3, number, bucket), state.low.discount
    x = rng.gamma(state.low.strength / d + before)
    if len(at):  # the same in every bucket
        x[at] = plan.rng(4, number).gamma(state.low.strength / d + state.hot_tables)[hot]
    t = draw_tables(c, d * np.repeat(x, deep) * parent[wi], d, rng).astype(np.int32)
    tables = ones + np.bincount(np.repeat(np.arange(len(deep)), deep), weights=t, minlength=len(deep)).astype(np.int32)
    sums = np.bincount(wi, weights=t, minlength=int(cuts[-1])).astype(np.int32)
    out = [(bucket, None, None, "seats", None, None, pack(t, tables))]
    out += [(bucket, q, None, "sums", None, None, pack(sums[a:b])) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    cold = tables > 0
    cold[at] = False
    out += _totals("tables", coarse(tables[cold])) + _totals("hot tables", hot, tables[at])
    return _table(out + _totals("cells", _histogram(c, t)))


def _priced(rows: pa.Table, plan: Plan, states: list[State]) -> pa.Table:
    """A bucket's cells and several seatings of them -> their mean predictions, and what is counted by word."""
    bucket = rows.column("bucket")[0].as_py()
    contexts, words, runs, wi, c = _bodies(rows, "cells")[0]
    ui = np.repeat(np.arange(len(contexts), dtype=np.int32), runs)
    customers = np.bincount(ui, weights=c, minlength=len(contexts))
    hot = plan.places(contexts)
    at = np.flatnonzero(hot >= 0)
    total = np.zeros(len(wi))
    many = c > 1
    for k, state in enumerate(states):
        t = np.minimum(c, 1)
        t[many], tables = _bodies(rows, f"seats {k}")[0]
        tables = tables.astype(float)
        tables[at], customers[at] = state.hot_tables[hot[at]], state.hot_customers[hot[at]]
        parent = state.parent(np.concatenate([x[0] for x in _bodies(rows, f"parent {k}")]).astype(float))
        total += state.predict(c, t, customers[ui], tables[ui], parent[wi])
    score = np.log10(total / max(1, len(states))).astype(np.float32)
    count = np.concatenate([x[0] for x in _bodies(rows, "counts")])
    return _table([(bucket // TOGETHER, bucket % TOGETHER, None, "priced", None, None, pack(contexts, words, runs, wi, score, count))])


def _posted(rows: pa.Table, state: State) -> pa.Table:
    """Priced cells of TOGETHER buckets, and the documents that have them -> sums for documents, chunk by chunk."""
    kinds, names = rows.column("kind").to_pylist(), rows.column("chunk").to_pylist()
    bodies, places = rows.column("body"), rows.column("q").to_pylist()
    dealt, out, cells = rows.column("bucket")[0].as_py(), [], {}
    for k, kind in enumerate(kinds):
        if kind == "docs":
            out.append((dealt, None, names[k], "docs", None, None, bodies[k].as_py()))
        if kind == "priced":
            contexts, words, runs, wi, score, count = unpack(bodies[k].as_buffer())
            cell = np.repeat(np.arange(len(contexts)) << 32, runs) | wi
            cells[places[k]] = contexts, words, cell, wi, score, count > 0, np.log10((count + 0.1) / (state.tokens + 0.1 * (state.words + 1)))
    for k, kind in enumerate(kinds):
        if kind != "pairs":
            continue
        body = unpack(bodies[k].as_buffer())
        sums = np.zeros((4, int(body[-1][0])))
        for at, (contexts, words, cell, wi, score, known, base) in cells.items():
            u, runs, own, w, n, of, _ = _of_bucket(body, at)
            if not len(w):
                continue
            found = np.searchsorted(cell, np.repeat(np.searchsorted(contexts, u) << 32, runs) | np.searchsorted(words, own)[w])
            word = wi[found]
            for j, x in enumerate((np.ones(len(word)), known[word], base[word], score[found])):
                sums[j] += np.bincount(of, weights=np.repeat(x, n), minlength=sums.shape[1])
        has = np.flatnonzero(sums[0])
        out.append((dealt, None, names[k], "sums", None, None, pack(has.astype(np.uint16), sums[1, has].astype(np.int32), sums[2, has], sums[3, has].astype(np.float32))))
    return _table(out)


def _summed(rows: pa.Table) -> pa.Table:
    """A chunk's sums from all buckets -> a row for each document."""
    rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    digests, count = _bodies(rows, "docs")[0]
    total = np.zeros((3, len(count)))
    for has, *sums in _bodies(rows, "sums"):
        for k, x in enumerate(sums):
            total[k, has] += x
    data = digests.tobytes()
    return pa.table([pa.array([data[32 * k : 32 * k + 32] for k in range(len(count))], pa.binary()), pa.array(count), pa.array(total[0].astype(np.int64)), pa.array(total[1]), pa.array(total[2])], names=["digest", "n_tokens", "n_known", "base_score", "score"])


ROWS_NAMES = [x.split()[0] for x in ROWS.split(", ")]


# the whole


def _plan(rows: DataFrame, seed: int) -> Plan:
    """Buckets by bytes of text; frequent contexts by a sample."""
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-size // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w, k = np.unique(tokens(b.column("text").to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k)], ["w", "n"])

    some = rows.where(F.pmod(F.xxhash64("digest"), F.lit(max(1, n // SAMPLED))) == 0).select("text")
    words = some.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    all_ = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # of more than a quarter of a bucket; there can't be more than four times as many as buckets
    found = words.where(F.col("n") * (4 * buckets) > all_).toArrow() if buckets > 1 and all_ else None
    hot = found["w"].to_numpy().view(np.uint64) if found else np.zeros(0, dtype=np.uint64)
    share = found["n"].to_numpy() / all_ if found else np.zeros(0)
    order = np.argsort(hot)
    spread = np.clip(np.ceil(share * buckets * 4), 1, buckets).astype(np.int64)
    return Plan(buckets, power_of_two(buckets), -(-buckets // TOGETHER), hot[order], spread[order], seed)


@dataclass
class Options:
    burn_in: int = BURN_IN
    samples: int = SAMPLES
    seed: int = 5
    #: Keep these hyperparameters instead of drawing them.
    fixed: tuple[Hyper, Hyper] | None = None


def lm_scores(docs: DataFrame, folds: int = 10, options: Options | None = None) -> DataFrame:
    """Learn from the documents whose id's crc32 isn't 0 modulo folds, and score them all.

    docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Null text counts
    as empty, so it is one token, the end.  Very long texts are read whole, each in one task.  Rows may repeat,
    and each is learned from; equal texts have equal scores.  An empty table gives an empty result, one without
    training documents the base alone; other columns aren't read.
    """
    spark, options = docs.sparkSession, options or Options()
    small_batches(spark)
    folder = work_folder(spark)
    text = whole(F.col("text"))
    held_out = fold(F.col("doc_id"), folds) == 0
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"), (~held_out).alias("learn"))
    plan = _plan(rows, options.seed)
    rng = plan.rng(0)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names: dict[str, str] = {}

    def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Stage by kind, and dealt by a column for good: what is joined on it later isn't moved again."""
        write = df.write.partitionBy("kind").format("parquet")
        if by:
            names[name] = f"lm_{uuid.uuid4().hex}"
            write.bucketBy(partitions, by).option("path", f"{folder}/{name}").saveAsTable(names[name])
            out = spark.table(names[name])
        else:
            write.save(f"{folder}/{name}")
            out = spark.read.schema(ROWS).parquet(f"{folder}/{name}")
        free()
        return out

    def free(*paths: str) -> None:
        """Remove tables; and have Spark remove the files of shuffles that are over."""
        dropped(spark, *[f"{folder}/{x}" for x in paths])
        for x in paths:
            if x in names:
                spark.sql(f"drop table if exists {names.pop(x)}")
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def totals(df: DataFrame) -> dict[str, dict[int, float]]:
        out: dict[str, dict[int, float]] = {}
        for kind, key, n in df.where("kind like 'total %'").groupBy("kind", "key").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False):
            out.setdefault(kind[6:], {})[int(key)] = n
        return out

    def grouped(df: DataFrame, by: str, run: Callable[[pa.Table], pa.Table], schema: str = ROWS) -> DataFrame:
        def own(t: pa.Table) -> pa.Table:
            released()
            return run(t)

        return df.groupBy(by).applyInArrow(own, schema)

    def beside(lying: DataFrame, moved: DataFrame, by: str, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """Like grouped() over both; lying is dealt by `by` already."""

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            released()
            return run(pa.concat_tables([x for x in (a, b) if x.num_rows]))

        moved = moved.select(*[F.col(c).alias(c) for c in ROWS_NAMES])  # both may come from one table
        return lying.groupBy(by).cogroup(moved.groupBy(by)).applyInArrow(both, ROWS)

    def of(df: DataFrame, kind: str, name: str | None = None) -> DataFrame:
        df = df.where(F.col("kind") == kind).select(*ROWS_NAMES)
        return df if name is None else df.withColumn("kind", F.lit(name))

    def at(run: Callable[[pa.Table, Plan, State, int], pa.Table], state: State, number: int) -> Callable[[pa.Table], pa.Table]:
        return lambda t: run(t, plan, state, number)

    def hot(sums: dict[int, float]) -> np.ndarray:
        return np.array([sums.get(k, 0.0) for k in range(len(plan.hot))])

    dealt, posts = partial(_dealt, plan=plan, posts=False), partial(_dealt, plan=plan, posts=True)
    cells = stage(grouped(rows.mapInArrow(lambda b: dealt(b), ROWS), "bucket", lambda t: _merged(t, plan)), "cells", "bucket")
    owned = stage(grouped(of(cells, "words"), "q", _vocabulary), "owned", "q")
    free("cells/kind=words")
    said, known = totals(cells), totals(owned)
    state = State(words=int(known.get("words", {}).get(0, 0)), tokens=int(known.get("tokens", {}).get(0, 0)))
    state = replace(state, tables=float(state.words), hot_customers=hot(said.get("hot customers", {})), hot_tables=hot(said.get("hot tables", {})))
    if options.fixed:
        state = replace(state, low=options.fixed[0], top=options.fixed[1])
    # contexts that several buckets share are restaurants like any other
    customers = dict(said.get("customers", {}))
    for k in coarse(state.hot_customers):
        customers[int(k)] = customers.get(int(k), 0) + 1

    seats, samples = cells, []
    for number in range(options.burn_in + options.samples):
        if number:  # the first parent is that of one table a cell
            last = seats
            seats = stage(beside(of(cells, "many"), of(last, "seats").unionByName(of(parent, "parent")), "bucket", at(_seated, state, number)), f"seats{number}")
            said = totals(seats)
            state = replace(state, hot_tables=hot(said.get("hot tables", {})))
        parent = stage(beside(of(owned, "owned"), of(seats, "sums"), "q", at(_parent, state, number)), f"parent{number}")
        free(f"seats{number}/kind=sums" if number else "cells/kind=sums")
        top = totals(parent)
        state = replace(state, customers=top.get("parent customers", {}).get(0, 0.0), tables=top.get("parent tables", {}).get(0, 0.0))
        if number >= options.burn_in:
            samples.append((state, seats, parent))
        if 1 <= number <= options.burn_in:  # what came before the samples
            free(f"parent{number - 1}", f"seats{number - 1}" if number > 1 else "cells/kind=seats")
        if not options.fixed:
            tables = dict(said.get("tables", {}))
            for k in coarse(state.hot_tables):
                tables[int(k)] = tables.get(int(k), 0) + 1
            low = state.low.drawn(tables, customers, said["cells"], rng) if "cells" in said else state.low
            root = state.top.drawn({int(state.tables): 1.0}, {int(state.customers): 1.0}, top.get("parent cells", {}), rng) if state.words else state.top
            state = replace(state, low=low, top=root)

    free("cells/kind=many", "owned/kind=owned")
    states, moved = [s for s, _, _ in samples], of(owned, "counts")
    for k, (_, s, p) in enumerate(samples):
        moved = moved.unionByName(of(s, "seats", f"seats {k}")).unionByName(of(p, "parent", f"parent {k}"))
    priced = stage(beside(of(cells, "cells"), moved, "bucket", lambda t: _priced(t, plan, states)), "priced", "bucket")
    free("cells", "owned", *[f"{x}{k}" for x in ("seats", "parent") for k in range(options.burn_in + options.samples)])
    sums = beside(of(priced, "priced"), rows.mapInArrow(lambda b: posts(b), ROWS), "bucket", lambda t: _posted(t, states[-1]))
    scores = grouped(sums, "chunk", _summed, "digest binary, n_tokens long, n_known long, base_score double, score double")
    scores = staged(scores.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]), f"{folder}/scores")
    free("priced")
    out = docs.select("doc_id", held_out.alias("held_out"), F.unhex(F.sha2(text, 256)).alias("digest")).join(scores, "digest")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(states[-1].tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame, of: str = "score") -> DataFrame:
    """scores -> held_out, perplexity by token."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(of) / F.sum("n_tokens")).alias("perplexity"))
