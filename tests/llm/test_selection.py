"""Resampling, source divergence and near vectors against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from libsight.llm import audit, pivots, resample, terms, words

DOCS = "doc_id bigint, text string, lang string, source string, score double, rank int, value int, n int, term string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHA = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeEéß日0_9") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    out = [(i, " ".join(rng.choice(vocab[:40 + i % 80]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    out += [(150, ""), (151, None), (152, "... 12 !\x00"), (153, "w" * 500 + " x"), (3, out[3][1]), (3, out[4][1]),
            (None, out[5][1]), (None, out[5][1]), (None, None), (154, " ".join(rng.choice(vocab) for _ in range(40_000)))]
    return out + [(7, out[7][1])] * 60


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "", "de", "fr"][k % 4], [None, "", "a", "b", "ü"][k % 5], 1.0, 2, 3, 4, "t")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(6)


def target_of(spark):
    return spark.createDataFrame([("a b É c d 99", 1), ("eé eé abc", 2), (None, 3)], "text string, item_id int")


def brute_resample(texts, target, percent, least, width, buckets, seed=2024):
    def features(text):
        found = ALNUM.findall(lower(text))
        return found, [zlib.crc32(" ".join(found[i:i + w]).encode()) % buckets
                       for w in range(1, width + 1) for i in range(len(found) - w + 1)]
    s, t = Counter(), Counter()
    for _, text in texts:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, text in texts:
        found, got = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in got)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(got), weight, weight + noise, len(found)))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = order[:percent * len(order) // 100]
    rest = Counter(rows) - Counter(drawn)
    return Counter((*r[:4], k) for k, r in enumerate(drawn, 1)) + Counter({(*r[:4], None): n for r, n in rest.items()})


@pytest.mark.parametrize("percent,width,least,buckets", [(10, 1, 20, 10_000), (60, 3, 5, 37), (0, 1, 0, 5), (100, 2, 1, 97)])
def test_resampling_draws_the_highest_scores(spark, docs, texts, percent, width, least, buckets):
    target = target_of(spark)
    got = resample.resample(docs, target, percent, least, width, buckets).collect()
    want = brute_resample(texts, [r["text"] for r in target.collect()], percent, least, width, buckets)
    assert Counter(tuple(r)[:5] for r in got) == want


def test_ranks_are_exact_over_many_ranges_and_ties(spark, folder):
    """Few samples, one score for most rows, ids that are null: ranks still run 1 to k."""
    from libsight.llm.scratch import Scratch
    rows = [(i if i % 3 else None, 20, 1 + i % 2, 0, 5 if i < 2500 else i % 40) for i in range(4000)]
    scored = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    with Scratch(spark) as keep:
        got = resample.rank_highest(scored.repartition(7), 3100, keep, samples=300).collect()
    order = sorted(rows, key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 3101)) and len(got) == 4000
    assert [(r["doc_id"], r["n_features"], r["score"]) for r in ranked] == [(r[0], r[2], r[4]) for r in order[:3100]]


def test_resampling_of_empty_tables(spark, docs):
    none = docs.limit(0)
    assert resample.resample(none, target_of(spark)).count() == 0
    assert resample.resample(docs, none).where("rank is not null").count() > 0
    assert resample.resample(none, none).columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


def test_checksums_and_terms_of_awkward_texts():
    column = pa.array(["", None, "A-b É1", "x" * 64 + " " + "y" * 65 + " " + "z" * 300, "\x00", "日 日"])
    for block in words.blocks(column, kind=terms.AlnumBlock):
        sums, owner = terms.run_checksums(block, 2)
        found = [ALNUM.findall(lower(t)) for t in column.to_pylist()]
        assert sorted(zip(owner.tolist(), sums.tolist())) == sorted(
            (i, zlib.crc32(" ".join(f[j:j + w]).encode())) for i, f in enumerate(found)
            for w in (1, 2) for j in range(len(f) - w + 1))


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", ALPHA.findall(lower(text))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {None: Counter(t for d in own for t in d[2] if t in kept)}
        for source in {d[1] for d in own}:
            counts[source] = Counter(t for d in own if d[1] == source for t in d[2] if t in kept)
        rates = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts.keys() - {None}:
            pair = [(o, sum(f(rates[s][t], rates[o][t]) for t in kept)) for o in counts if o not in (None, s)]
            term = [(t, f(rates[s][t], rates[None][t])) for t in kept if counts[s][t] and rates[s][t] > rates[None][t]]
            for part, found, cut in (("pair", pair, None), ("term", term, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least,top,cells", [(10, 10, 100_000), (2, 3, 50), (10_000, 5, 10)])
def test_divergence_of_sources(docs, monkeypatch, least, top, cells):
    """Whole blocks and many small ones, groups without words, null text, lang and source."""
    monkeypatch.setattr(audit, "BLOCK_CELLS", cells)
    got = [tuple(r) for r in audit.divergence(docs, least, top).collect()]
    want = brute_divergence([tuple(r) for r in docs.select("text", "lang", "source").collect()], least, top)
    assert len(got) == len(set(got)) and set(got) == want


def test_divergence_of_many_sources_and_an_empty_table(spark, docs, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(8)), "en", f"s{i % 70}") for i in range(400)]
    monkeypatch.setattr(audit, "MATRIX", 100)
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in audit.divergence(frame).collect()} == brute_divergence(rows, 10, 10)
    assert audit.divergence(docs.limit(0)).count() == 0


def test_rates_beyond_64_bits(spark):
    n = 4 * 10**17
    row = spark.range(1).select(audit.rate(F.lit(n), F.lit(2 * n), F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (2 * n + 6)


def near_copies(rng, base, cosine):
    other = rng.normal(size=len(base))
    other -= other @ base / (base @ base) * base
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    return cosine * base + math.sqrt(1 - cosine * cosine) * other


def brute_vectors(rows, threshold=0.93):
    def fine(v, label):
        return v is not None and label is not None and v and all(
            x is not None and math.isfinite(x) for x in v) and any(v)
    links = defaultdict(set)
    for i, (_, v, lv) in enumerate(rows):
        for j, (_, w, lw) in enumerate(rows[:i]):
            if lv == lw and fine(v, lv) and fine(w, lw) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(links[i]), least, row[0] == least))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    rows = []
    for k in range(160):
        base = rng.normal(size=24).astype(np.float32).astype(float)
        rows.append((base, k % 3))
        rows += [(near_copies(rng, base, c), k % 3) for c in rng.uniform(0.9, 1, size=k % 4)]
    chain = rng.normal(size=24)
    for _ in range(25):
        rows.append((chain, 1))
        chain = near_copies(rng, chain, 0.945)
    crowd = rng.normal(size=24)
    rows += [(near_copies(rng, crowd, 0.985), 0) for _ in range(120)] + [(crowd * 3, 0)] * 40
    rows = [(1000 - i, np.asarray(v, np.float32).astype(float).tolist(), label) for i, (v, label) in enumerate(rows)]
    zero, gap = [0.0] * 24, [1.0] * 23 + [None]
    return rows + [
        (5001, zero, 1), (5002, None, 1), (5003, gap, 1), (5004, [1.0] * 23 + [float("nan")], 1), (5005, [float("inf")] * 24, 1),
        (5006, rows[0][1], None), (5007, [], 1), (5008, [1.0, 2.0], 1), (5009, [1.0, 2.0], 1), (None, rows[0][1], 0),
        (None, [3.0, -1.0], 2), (None, [3.0, -1.0], 2), (1000, rows[5][1], 0), (1000, rows[0][1], 0), (5010, [1e30] * 24, 2),
        (5011, [1e-30] * 24, 2)]


def test_near_vectors(spark, vectors):
    """Copies, chains, a crowd, vectors that link with nothing, lengths and labels apart."""
    frame = spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in vectors],
                                  "vec_id bigint, embedding array<float>, label int, n bigint, node int, pivot int")
    want = Counter(brute_vectors(vectors))
    for chunk in (1024, 9):
        got = Counter(tuple(r) for r in pivots.near_vectors(frame.repartition(5), chunk=chunk).collect())
        assert got == want
    assert pivots.near_vectors(frame.limit(0)).count() == 0
    assert pivots.near_vectors(frame.where("vec_id > 5000")).count() == 11


def test_recall_of_the_pivot_index_at_the_threshold(spark):
    """Pairs just above the threshold, among many unrelated vectors: nearly all are found."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(3000):
        base = rng.normal(size=64)
        rows += [(2 * k, base.tolist(), 0), (2 * k + 1, near_copies(rng, base, 0.9305).tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = pivots.near_vectors(frame).where("n_links > 0").count()
    assert found >= 0.985 * len(rows)
    # as many pivots as ten million vectors have
    wide = pivots.choose_pivots(rng.normal(size=(4096, 64)), 3163)
    near = pivots.describe(frame.select("vec_id", F.col("embedding").alias("vector")), wide).select("vec_id", "near").collect()
    by_id = {r["vec_id"]: set(r["near"]) for r in near}
    assert sum(len(by_id[2 * k] & by_id[2 * k + 1]) >= 2 for k in range(3000)) >= 0.97 * 3000


def test_cosines_at_the_threshold_are_decided_exactly():
    a, b = np.array([[1.0, 0.0], [3.0, 4.0]]), np.array([[0.6, 0.8], [0.8, 0.6]])
    every = np.ones((2, 2), dtype=bool)
    assert pivots.linked(a, b, every, 0.6).tolist() == [[True, True], [True, True]]
    assert pivots.linked(a, b, every, 0.96).tolist() == [[False, False], [True, True]]
    assert pivots.linked(a, b, every & np.eye(2, dtype=bool), 0.97).tolist() == [[False, False], [False, False]]
