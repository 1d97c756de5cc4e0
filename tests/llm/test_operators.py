"""Each operator against a plain version of itself, on texts of every odd kind, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from prosegauge.llm import bpe, exact_dedup, langid, lm_scoring, mixing, queries, secrets, sharding, simhash, sketching, toxicity
from prosegauge.llm.common import fold

SPACE = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return SPACE.findall(t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_mixing(docs, nothing, rows):
    got = mixing.mixed(docs).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget = 1.5 * sum(sizes.values())
    want, open_ = {}, set(order)
    while True:  # shares by weight; what is over a ceiling goes to the others
        left = budget - sum(want.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= longest[s] + 1
    again = mixing.mixed(docs).select("row.doc_id", "row.source", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["source"], r["taken"]) for r in got)
    out = mixing.taken_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + (out.where("n_chars < 4 or trim(text) = ''").count())
    assert mixing.mixed(nothing).count() == 0


def test_sharding(docs, nothing, rows):
    got = sharding.sharded(docs, 16).collect()
    assert len(got) == len(rows)
    slots, of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"] and 0 <= r["shard"] < 16
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    heavy = Counter(r["shard"] for r in sharding.sharded(docs.sparkSession.range(4000).selectExpr("id as doc_id", "'x' as text"), [1.0, 0.0, 3.0]).collect())
    assert heavy[1] == 0 and 2.4 < heavy[2] / heavy[0] < 3.7
    assert sharding.sharded(nothing).count() == 0


def chained(run):
    h = 42
    for w in run:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def sketch(t, scale=8):
    w = words(t)
    h = {chained(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    h = {x - 2**64 if x >= 2**63 else x for x in h}
    low = {x for x in h if x < 2**64 // scale - 2**63}
    return low or ({min(h)} if h else set())


def test_fingerprints(docs, nothing, rows):
    got = sketching.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1] or "")))
    assert len(got) == len(rows)
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    want = Counter()
    for k, (i, t, _, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        name = lambda s: "8:" + "".join(f"{x % 2**64:016x}" for x in sorted(s))
        want[i, len(t), sha(edited), name(a), name(b), round(likeness(a, b), 9), round(likeness(a, c), 9)] += 1
    have = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert have == want
    assert sketching.fingerprints(nothing).count() == 0


def test_golay():
    check, errors, found = simhash.golay()
    assert sorted(Counter(found.tolist()).items()) == [(1, 2325), (6, 1771)]
    weights = Counter((k << 12 | int(c)).bit_count() for k, c in enumerate(check))
    assert weights == {0: 1, 8: 759, 12: 2576, 16: 759, 24: 1}


def test_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, size=k % 4, replace=False):
            y[k] ^= np.uint64(1 << int(b))
    a, b = [set() for _ in x], [set() for _ in x]
    for fps, own in ((x, a), (y, b)):
        for key, of in zip(*simhash.keys(fps), strict=True):
            own[of].add(int(key))
    assert all(p & q for p, q in zip(a, b, strict=True))


def plain_fingerprint(t):
    w = SPACE.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    if not w:
        return 0
    runs = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = {f: f for f in fps}
    top = lambda f: f if label[f] == f else top(label[f])
    some = sorted(label)
    for k, f in enumerate(some):
        for g in some[k + 1 :]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((top(f), top(g)))
                label[b] = a
    return {f: top(f) for f in some}


@pytest.mark.parametrize("hot", [128, 2])
def test_simhash(docs, nothing, rows, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    got = simhash.near_groups(docs).collect()
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    top = plain_components(fps)
    least = {}
    for (i, _, _, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    want = Counter((i, f, least.get(top[f])) for (i, _, _, _), f in zip(rows, fps, strict=True))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    if hot == 128:
        kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
        assert sorted(x for x in kept if x is not None) == sorted(set(least.values())) and kept.count(None) == 2
        assert simhash.near_groups(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long"), exact_dedup.work_folder(spark)).collect()}
    assert got == {k: k // 20 * 20 for k in range(60)} | {100: 100, 150: 100, 200: 100}


def test_exact_dedup(docs, nothing, rows):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[t or ""].append(i)
    best = {t: max((x for x in v if x is not None), default=None) for t, v in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), sha(t or "")) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(sha(t) for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_dedup_goes_on(spark, docs, tmp_path):
    """A second run with the same checkpoint reads new files alone, and its state has both."""
    path, checkpoint = f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    part = docs.where("doc_id is not null").select("doc_id", "text").coalesce(1)
    part.where("doc_id < 40").write.parquet(path)
    exact_dedup.run_stream(spark, path, part.schema, checkpoint)
    first = exact_dedup.read_state(spark, checkpoint).agg({"n": "sum"}).first()[0]
    part.where("doc_id >= 40").write.mode("append").parquet(path)
    exact_dedup.run_stream(spark, path, part.schema, checkpoint)
    both = exact_dedup.read_state(spark, checkpoint).agg({"n": "sum"}).first()[0]
    assert first == part.where("doc_id < 40").count() and both == part.count()


def plain_spans(t):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    out = []
    for k, (name, p, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in p.finditer(t) if len(m[group]) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_secrets(spark, docs, nothing, rows, tmp_path):
    odd = ["token=token: abcdefgh", "token=abc secret:defghi", "é\U0001f600 API_KEY = \"abc.def/ghi\"", "AKIAAKIA" + "A" * 12, "AKIA" + "Z" * 15, "a" * 24, "a" * 23, "g" + "f" * 30 + "G", "PASSWORD:  'x'", "secret=" + "q" * 3000 + " token=abcdef" * 50, ""]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    ledger = f"file://{tmp_path}/ledger"
    both = docs.select("doc_id", "text").unionByName(more)
    got = secrets.digest(secrets.scan(both, ledger)).collect()
    want = Counter((i, plain_spans(t or "")) for i, t in [(r[0], r[1]) for r in rows] + [(1000 + k, t) for k, t in enumerate(odd)])
    assert Counter((r["doc_id"], r["spans"]) for r in got) == want
    assert all(r["base_sha256"] == sha(r["spans"]) and r["n_assign"] == r["spans"].count("assign:") for r in got)
    # what the ledger has isn't scanned again; a new version of a rule is, and of that rule alone
    size = spark.read.parquet(ledger).count()
    assert Counter((r["doc_id"], r["spans"]) for r in secrets.digest(secrets.scan(both, ledger)).collect()) == want
    assert spark.read.parquet(ledger).count() == size
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"(?<![0-9a-f])[0-9a-f]{23,}"))
    found = {r["doc_id"]: r["n_hex"] for r in secrets.digest(secrets.scan(both, ledger, newer), newer).collect()}
    assert found[1006] == 1 and spark.read.parquet(ledger).count() == size + size // 3
    assert secrets.scan(nothing).count() == 0


def stirling_numbers(d, most):
    out = [[0.0] * (most + 2) for _ in range(most + 2)]
    out[1][1] = 1.0
    for c in range(1, most):
        for t in range(1, c + 2):
            out[c + 1][t] = out[c][t - 1] + (c - d * t) * out[c][t]
    return out


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [1, 0, 5, 1000, 0, 3, 70_000]):
        arrays = [rng.integers(0, 256, n * np.dtype(k).itemsize, dtype=np.uint8).view(k) for n, k in zip(sizes, lm_scoring._TYPES, strict=False)]
        body = lm_scoring.pack(*arrays)
        for form in (body, pa.array([body])[0].as_buffer()):
            got = lm_scoring.unpack(form)
            assert [x.dtype for x in got] == [x.dtype for x in arrays]
            assert [x.tobytes() for x in got] == [x.tobytes() for x in arrays]


def test_tables_follow_their_law():
    rng = np.random.default_rng(3)
    for d, c, weight in ((0.5, 2, 0.3), (0.75, 7, 1.5), (0.3, 12, 4.0)):
        s = stirling_numbers(d, c)
        p = np.array([weight**t * s[c][t] for t in range(1, c + 1)])
        got = np.bincount(lm_scoring.draw_tables(np.full(40_000, c), np.full(40_000, weight), d, rng), minlength=c + 1)[1:] / 40_000
        assert np.abs(got - p / p.sum()).max() < 0.012
    # beyond the exact law: mean and variance
    for d, c, weight in ((0.8, 300, 3.0), (0.6, 300, 40.0), (0.9, 200, 0.05), (0.5, 400, 0.9)):
        p = np.exp(np.log(weight) * np.arange(1, c + 1) + lm_scoring.stirling(d, c)[c, 1 : c + 1] - lm_scoring.stirling(d, c)[c, 1])
        p /= p.sum()
        mean = (p * np.arange(1, c + 1)).sum()
        got = lm_scoring.draw_tables(np.full(20_000, c), np.full(20_000, weight), d, rng)
        assert got.mean() == pytest.approx(mean, rel=0.1, abs=0.12) and got.std() == pytest.approx((p * (np.arange(1, c + 1) - mean) ** 2).sum() ** 0.5, rel=0.2, abs=0.12)
    assert lm_scoring.draw_tables(np.array([0, 1]), np.array([0.0, 2.0]), 0.5, rng).tolist() == [0, 1]


def test_sweeps_of_one_restaurant():
    """Cells given x, x given the tables: in the long run the joint law of a Pitman-Yor restaurant."""
    import itertools

    rng, d, strength = np.random.default_rng(5), 0.6, 0.7
    c, base = np.array([5, 3, 4]), np.array([0.5, 0.1, 0.02])
    s = stirling_numbers(d, 5)
    want, whole = 0.0, 0.0
    for t in itertools.product(*[range(1, n + 1) for n in c]):
        p = math.prod(strength + d * k for k in range(sum(t))) * math.prod(base[k] ** t[k] * s[c[k]][t[k]] for k in range(3))
        want, whole = want + p * np.array([*t, sum(t) ** 2]), whole + p
    t, total, n = np.ones(3, dtype=np.int64), np.zeros(4), 8000
    for _ in range(n):
        x = rng.gamma(strength / d + t.sum())
        t = lm_scoring.draw_tables(c, d * x * base, d, rng)
        total += [*t, t.sum() ** 2]
    assert total / n == pytest.approx(want / whole, rel=0.04)


def test_hyperparameters_come_back():
    """Drawn from restaurants of known discount and strength."""
    rng, d, strength = np.random.default_rng(8), 0.6, 3.0
    tables, cells, customers = Counter(), Counter(), Counter()
    for _ in range(150):
        seats: list[list[int]] = []  # of one dish each: the base has no atoms
        for k in range(60):
            p = [strength + d * len(seats), *[x - d for x in seats]]
            at = rng.choice(len(p), p=np.array(p) / (strength + k))
            seats = [*seats, 1] if at == 0 else [x + (j == at - 1) for j, x in enumerate(seats)]
        tables[len(seats)] += 1
        customers[60] += 1
        cells.update(int(x) * (lm_scoring.EXACT + 1) + 1 for x in seats if x > 1)
    h, drawn = lm_scoring.Hyper(), []
    for k in range(60):
        h = h.drawn(dict(tables), dict(customers), dict(cells), rng)
        drawn += [h] * (k > 20)
    assert abs(np.mean([x.discount for x in drawn]) - d) < 0.08 and 1.5 < np.mean([x.strength for x in drawn]) < 6


def test_words_hash_alike():
    texts = ["The tHE the", "", "  a\x0bb\x1cc ", "É é", "x" * 3000]
    got, n = lm_scoring.tokens([t.encode() for t in texts])
    plain = [["the"] * 3, [], ["a", "b\x1cc"], ["É", "é"], ["x" * 3000]]
    assert n.tolist() == [len(w) + 1 for w in plain]
    flat = [x for w in plain for x in [*w, "\n"]]
    assert all((a == b) == (flat[i] == flat[j]) for i, a in enumerate(got) for j, b in enumerate(got))


def test_predictions_are_a_distribution():
    rng = np.random.default_rng(6)
    c, t = rng.integers(0, 9, 50), np.zeros(50, dtype=np.int64)
    t[c > 0] = 1 + rng.integers(0, 9, (c > 0).sum()) % c[c > 0]
    own = rng.integers(1, 30, 50) - 0.4
    state = lm_scoring.State(lm_scoring.Hyper(0.7, 2.0), lm_scoring.Hyper(0.4, 5.0), words=50, customers=float((own + 0.4).sum()), tables=50.0)
    parent = state.parent(np.append(own, 0.0))  # and the word that training lacks
    assert parent.sum() == pytest.approx(1)
    assert state.predict(np.append(c, 0), np.append(t, 0), c.sum(), t.sum(), parent).sum() == pytest.approx(1)


def plain_gibbs(train, texts, low, top, sweeps, burn_in, seed=1):
    """Customers leave their table one by one and sit down again; mean predictions over sweeps."""
    import random

    rnd = random.Random(seed)
    rest: dict = defaultdict(lambda: defaultdict(list))  # restaurant -> dish -> sizes; the parent is None
    words_ = {w for t in train for w in t} | {"\n"}

    def p(r, w):
        base = 1 / (len(words_) + 1) if r is None else p(None, w)
        d, s = (top if r is None else low).discount, (top if r is None else low).strength
        own = rest[r][w] if r in rest and w in rest[r] else []
        n, k = (sum(sum(x) for x in rest[r].values()), sum(map(len, rest[r].values()))) if r in rest else (0, 0)
        return (sum(own) - d * len(own) + (s + d * k) * base) / (s + n)

    def come(r, w):
        d, s = (top if r is None else low).discount, (top if r is None else low).strength
        base = 1 / (len(words_) + 1) if r is None else p(None, w)
        own, k = rest[r][w], sum(map(len, rest[r].values()))
        at = rnd.choices(range(len(own) + 1), [*[x - d for x in own], (s + d * k) * base])[0]
        if at == len(own):
            own.append(1)
            if r is not None:
                come(None, w)
        else:
            own[at] += 1

    def leave(r, w):
        own = rest[r][w]
        at = rnd.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            del own[at]
            if r is not None:
                leave(None, w)

    pairs = [x for t in train for x in zip(["\n", *t], [*t, "\n"], strict=True)]
    for r, w in pairs:
        come(r, w)
    total = [np.zeros(len(t) + 1) for t in texts]
    for k in range(burn_in + sweeps):
        for r, w in pairs:
            leave(r, w)
            come(r, w)
        for at in range(8):  # the parent's customers, too
            for w in list(rest[None]):
                if rest[None][w]:
                    leave(None, w)
                    come(None, w)
        if k >= burn_in:
            for t, x in zip(texts, total, strict=True):
                x += [p(r, w) for r, w in zip(["\n", *t], [*t, "\n"], strict=True)]
    return [float(np.log10(x / sweeps).sum()) for x in total]


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 150])
def test_lm_agrees_with_plain_gibbs(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", bucket_bytes)
    rng = np.random.default_rng(9)
    texts = [["abcdefghij"[int(x)] for x in np.minimum(9, rng.geometric(0.3, int(n)) - 1)] for n in rng.integers(0, 12, 60)] + [["z", "a", "b"], ["a", "zz"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    low, top = lm_scoring.Hyper(0.6, 0.8), lm_scoring.Hyper(0.4, 2.0)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, options=lm_scoring.Options(3, 8, fixed=(low, top))).collect()}
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    want = plain_gibbs(train, texts, low, top, 60, 20)
    off = [(got[k] - want[k]) / (len(t) + 1) for k, t in enumerate(texts)]
    assert max(map(abs, off)) < 0.06 and abs(float(np.mean(off))) < 0.015


def test_lm_scoring(docs, nothing, rows, monkeypatch):
    got = lm_scoring.lm_scores(docs).collect()
    assert len(got) == len(rows)
    train = [words((t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t)) for i, t, _, _ in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10]
    c = Counter(w for ws in train for w in [*ws, "\n"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _, _ in rows:
        ws = [*words("".join(x.lower() if x.isascii() else x for x in t or "")), "\n"]
        want[i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.lm_scores(nothing).count() == 0


@pytest.mark.parametrize("how", [{}, {"chunk": 300, "overlap": 40}, {"chunk": 40, "overlap": 6}])
def test_bpe(docs, nothing, rows, how):
    ranks, pattern = queries.tokenizer()
    encoding = bpe.codec(ranks, pattern)
    got = bpe.round_trip(docs, ranks, pattern, **how).collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(t or "")] += 1
    assert Counter(map(tuple, got)) == want
    if not how:
        assert bpe.round_trip(nothing, ranks, pattern).count() == 0
        one = bpe.encoded(docs.where("doc_id = 304"), ranks, pattern).select(bpe.as_ids("ids").alias("ids")).first()["ids"]
        assert one == encoding.encode_ordinary(next(t for i, t, _, _ in rows if i == 304))


def test_chunks_meet_anywhere():
    """Joints of chunks are boundaries of the whole text's tokens, whatever runs of space and marks it has."""
    import random

    ranks, pattern = queries.tokenizer()
    split = bpe.splitter(pattern)
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "re", "'s", "'", " ", "  ", "\n", "!", "7", "é", "　"]) for _ in range(200))
        ends = {m.end() for m in split.finditer(text)}
        parts = bpe.cuts(text, 40, 12)
        both = [bpe.joints(text[a:b], a, k == len(parts) - 1, 40, 12, pattern) for k, (a, b) in enumerate(parts)]
        for (_, tail), (head, _) in zip(both, both[1:], strict=False):
            if common := set(tail) & set(head):
                assert min(common) in ends


def test_langid(docs, nothing, rows):
    filters = langid.train(docs.where(fold(docs["doc_id"], 4) != 2), share=0.05)
    got = {(r["doc_id"], r["kept"]["text"]): r for r in langid.identified(docs, filters, keep=("doc_id", "text")).select("kept.doc_id", "kept", "lang_pred", "score").collect()}
    letters = lambda t: any(c.isalpha() for c in t or "")
    for i, t, lang, _ in rows:
        r = got[i, t]
        assert (r["lang_pred"] == "und") == (not letters(t)) and 0 <= r["score"] <= 1
        if i is not None and i < 60:
            assert r["lang_pred"] == lang
    assert langid.train(nothing) is None
    assert langid.identified(nothing, filters).count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}


def test_langid_learns_from_texts_with_letters(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(langid.Filters, "fit", classmethod(lambda cls, languages, grams, m=0: learned.extend(zip(languages, map(len, grams), strict=True))))
    own = lambda k: "".join(chr(97 + int(c)) for c in f"{k:06d}")
    rows = [(k, own(k), "xx") for k in range(40)] + [(1000 + k, None if k % 2 else "12 34", "xx") for k in range(4000)]
    rows += [(10_000 + k, own(k), f"l{k:04d}") for k in range(1100)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=20, share=0.0)
    assert len(learned) == 1101 and dict(learned)["xx"] >= 20


def test_filters_hold_all(spark):
    rng = np.random.default_rng(2)
    own = [rng.integers(0, 2**62, 500) for _ in range(70)]
    f = langid.Filters.fit([f"l{k}" for k in range(70)], own, 1 << 14)
    assert f.masks.shape[0] == 2
    for k in (0, 5, 63, 64, 69):
        bits = np.bitwise_and.reduce([f.masks[k // 64][p] for p in langid.positions(own[k].view(np.uint64), 1 << 14)])
        assert ((bits >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_toxicity(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 4)
    bad = ["vilescum", "vilescub", "grubworm", "grubwurm"]
    texts = [(k, r["text"] + (" " + bad[k % 4] if k % 3 == 0 else "")) for k, r in enumerate(docs.where("doc_id < 60").collect())]
    more = [(1000 + k, t + (" and " + bad[k % 4] + " too" if y else "")) for k, (_, t) in enumerate(texts) for y in (k % 2,)]
    rows = texts + more
    d = spark.createDataFrame(rows, "doc_id long, text string")
    toxic = lambda t: int("vile" in t or "grub" in t)
    labels = spark.createDataFrame([(i, 1, toxic(t)) for i, t in rows] + [(None, 1, 1), (5, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    got = toxicity.scored(d, model).collect()
    right = [r["predicted"] == toxic(dict(rows)[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.8 and all((r["score"] >= 0.5) == bool(r["predicted"]) for r in got)
    unseen = model.score(["the of and it was " + w + " for on are as with they at be" for w in ("vilescux", "house")])
    assert unseen[0] > unseen[1]
    assert toxicity.scored(docs, model).count() == docs.count()
    assert toxicity.scored(nothing, toxicity.train(nothing, labels.limit(0))).count() == 0


def test_windows_number_words():
    grams, text_of = toxicity.subwords(["one two three", "", "x " * 40, "a b " * 20, "!!"], 16)
    assert text_of.tolist() == [0, 1, 2, 3, 3, 3, 4]
    seen = np.unique(np.concatenate([w for _, w in grams]))
    assert seen.tolist() == [0, 2, 3, 4, 5]


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1] or "")))
    out = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        out[i, sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])] += 1
    return out


def test_runs_of_any_ids(spark, monkeypatch):
    """One id far off, an id that a third of the rows have, rows without an id."""
    monkeypatch.setattr(sketching, "ROWS_PER_RUN", 4)
    rows = [(k * 3 + 10**15, f"a{k} b{k} c{k}") for k in range(60)] + [(-(2**62), "far off"), (2**62, "far up")]
    rows += [(10**15 + 30, f"same id {k}") for k in range(50)] + [(None, f"none {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in sketching.fingerprints(docs).collect()) == plain_fingerprints(rows)
    sizes = [r["count"] for r in docs.withColumn("run", sketching._runs(docs)).groupBy("run").count().collect()]
    assert max(sizes) <= 16 and len(sizes) > 25


def test_sketches_merge(spark):
    """The sketch of the parts' hashes is that of the whole, also where a part has none below the threshold."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        h = rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 9))).tolist()
        at = int(rng.integers(0, len(h) + 1))
        rows.append((h, h[:at], h[at:]))
    df = spark.createDataFrame(rows, "all array<bigint>, a array<bigint>, b array<bigint>")
    both = df.select(sketching.sketch(F.col("all")).alias("x"), sketching.merge(sketching.sketch(F.col("a")), sketching.sketch(F.col("b"))).alias("y"))
    assert both.where("x != y").count() == 0


def test_exact_dedup_renames_local_files_itself(spark):
    """Over a local file system no process is started to rename a file; elsewhere Spark's usual way stays."""
    key, none = "spark.sql.streaming.checkpointFileManagerClass", "none"
    assert exact_dedup._session(spark, None, "file:///c").conf.get(key, none).endswith(".FileSystemBasedCheckpointFileManager")
    assert exact_dedup._session(spark, None, "hdfs://h/c").conf.get(key, none) == none


def test_exact_dedup_checks_bytes(docs, rows):
    """With a digest of one hex digit most hits are false; texts still decide."""
    from pyspark.sql import functions as F

    got = exact_dedup.exact_groups(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1)).collect()
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[t or ""].append(i)
    best = {t: max((x for x in v if x is not None), default=None) for t, v in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), sha(t or "")) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want


def test_exact_dedup_reads_its_path(spark, tmp_path):
    """The way of the query: a path with signs of a glob, no copy of the table."""
    path = f"file://{tmp_path}/x[1]y"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "doc_id long, text string").coalesce(1).write.parquet(path)
    escaped = path.replace("[", "\\[").replace("]", "\\]")
    exact_dedup.run_stream(spark, path, "doc_id long, text string", f"file://{tmp_path}/c")
    assert sorted(r["n"] for r in exact_dedup.read_state(spark, f"file://{tmp_path}/c").collect()) == [2, 2]
    plain = f"file://{tmp_path}/plain"
    spark.read.parquet(escaped).write.parquet(plain)
    got = exact_dedup.exact_groups(spark.read.parquet(plain), plain).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(1, 2), (2, 2), (3, 4), (4, 4)]


def test_secrets_of_a_long_text(spark):
    """100,000 matches in one text, in seconds."""
    import time

    text = "token=abcdef12 é" * 100_000
    began = time.time()
    got = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert time.time() - began < 30
    assert got["n_assign"] == 100_000 and got["spans"] == plain_spans(text)


def test_secrets_of_a_pair_that_stands_twice(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "none")], "doc_id long, text string")
    want = Counter((r["doc_id"], r["spans"]) for r in secrets.digest(secrets.scan(docs, ledger)).collect())
    twice = spark.createDataFrame(spark.read.parquet(ledger).collect(), spark.read.parquet(ledger).schema)
    twice.write.mode("append").parquet(ledger)
    assert Counter((r["doc_id"], r["spans"]) for r in secrets.digest(secrets.scan(docs, ledger)).collect()) == want


def test_toxicity_sample_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (texts, labels))
    rows = [(k, "word " * (10 if k % 5 else 1000)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, labels = toxicity.train(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int"))
    assert set(labels) == {0, 1} and all(t in {"word " * 10} for t in texts) and sum(map(len, texts)) <= 4000


def test_mixing_takes_a_known_size(docs):
    from pyspark.sql import functions as F

    known = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("words"))
    a = mixing.mixed(known, size=F.col("words")).select("row.doc_id", "row.source", "size", "target", "taken").collect()
    b = mixing.mixed(docs).select("row.doc_id", "row.source", "size", "target", "taken").collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_filters_grow_with_ngrams():
    own = [np.arange(200_000, dtype=np.int64) * 7919, np.arange(10, dtype=np.int64)]
    f = langid.Filters.fit(["a", "b"], own, 1 << 14)
    assert f.masks.shape[1] == 1 << 22 and (f.chance < 0.01).all()


def test_shards_by_plain_rendezvous(docs, rows):
    """Spark's hash of a key and a shard: XXH64 of the long's eight bytes, seeded 42, then of the int's four."""

    def shard(key, weights):
        h = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        bids = []
        for s, w in enumerate(weights):
            if w:
                u = ((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h) >> 11) + 0.5) / (1 << 53)
                bids.append((-math.log(u) / w, s))
        return min(bids)[1]

    keyed = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    for weights in ([1.0] * 16, [1.0, 0.0, 3.0, 0.5]):
        got = sharding.sharded(keyed, weights).collect()
        assert {r["doc_id"] for r in got} == {i for i, _, _, _ in rows}
        assert all((r["shard"], r["grown_shard"]) == (shard(r["doc_id"], weights), shard(r["doc_id"], [*weights, 1.0])) for r in got)


def plain_grams(text):
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    return [f" {w} "[k : k + 4] for w in spaced.split(" ") if len(w) > 1 for k in range(len(w) - 1)]


def test_languages_by_plain_sets(spark):
    """Filters against exact sets of n-grams: the same language, and a share that false positives hardly move."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = table.where(fold(table["doc_id"], 4) != 2)
    known = [(r["lang"], set(plain_grams(r["text"]))) for r in learned.collect() if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    of, texts = defaultdict(Counter), Counter(lang for lang, _ in known)
    assert max(texts.values()) <= langid.TEXTS_PER_LANGUAGE
    for lang, grams in known:
        of[lang].update(grams)
    sets = {lang: {g for g, n in c.items() if n >= max(1, texts[lang] * langid.LEAST_SHARE)} for lang, c in of.items()}
    filters = langid.train(learned)
    got = {r["doc_id"]: r for r in langid.identified(table.select("doc_id", "text"), filters).select("kept.doc_id", "lang_pred", "score").collect()}
    assert sorted(sets) == filters.languages
    for r in table.collect():
        grams = plain_grams(r["text"] or "")
        hits = {lang: sum(g in own for g in grams) for lang, own in sets.items()}
        best = sorted(hits, key=lambda x: (-hits[x], x))
        said = got[r["doc_id"]]
        if grams and (len(best) < 2 or hits[best[0]] - hits[best[1]] > 0.01 * len(grams)):
            assert said["lang_pred"] == best[0] and abs(said["score"] - hits[best[0]] / len(grams)) < 0.01


def test_toxicity_by_plain_windows(docs, rows):
    """A model with any weights, against windows of words counted one by one."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32) * 40, 0.25)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        h = (h + len(gram)) % 2**64
        return ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (65 - toxicity.BUCKETS.bit_length())

    def plain(text):
        runs = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ")
        run = [w for w in runs if w]
        run = [w for k, w in enumerate(run) if not k or w != run[k - 1]]
        worst = -math.inf
        for at in range(0, max(1, len(run)), toxicity.WINDOW):
            grams = [f" {w} "[k : k + n] for w in run[at : at + toxicity.WINDOW] for n in toxicity.GRAMS for k in range(len(w) + 3 - n)]
            worst = max(worst, sum(float(model.logit[bucket(g)]) for g in grams) / (toxicity.NEUTRAL + len(grams)) + model.bias)
        return 1 / (1 + math.exp(-max(-30, min(30, worst))))

    got = toxicity.scored(docs, model).collect()
    mine = sorted((i is None, i or 0, plain(t)) for i, t, _, _ in rows)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got)
    assert len(have) == len(mine) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(have, mine, strict=True))
