"""Clustering, importance resampling and toxicity against brute force, with the cases that every operator must take."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import clustering, importance, toxicity

ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, cluster string, v string, near string"
DOCS = "doc_id long, text string, score string, rank string, toxic string, n_words string"

# 11 -----------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    """Lloyd's rounds with all distances, in Python's whole numbers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "null" if i is None else str(i)
    centers = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        held = [[] for _ in centers]
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centers, strict=True)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, c, d in told:
        by[c] += d
    return sorted((name(i), c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in told)


def clusters(df, **options):
    state, centers, figures = clustering.cluster_vectors(df, **options)
    return sorted(("null" if r.vec_id is None else str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.digest(state, centers).collect()), figures


def vector_rows(n, dims, seed=1, spread=0.1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(9, dims))
    return [(k, [float(x) for x in np.float32(middles[r.integers(9)] + spread * r.normal(size=dims))]) for k in range(n)]


def test_clustering(spark):
    dims = 8
    rows = vector_rows(600, dims)
    same = rows[3][1]
    rows += [(700, None), (701, [1.0] * (dims - 1)), (702, [None, *same[1:]]), (703, [float("nan"), *same[1:]]), (704, [float("inf"), *same[1:]]), (705, same), (3, same), (None, same), (706, []), (3, rows[9][1])]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS).repartition(3)
    for n_near in (None, 0, 1, 7, 20):
        told, figures = clusters(df, k=16, rounds=3, n_near=n_near, dims=dims)
        assert told == brute_clusters(rows, 16, 3, dims)
        assert len(figures) == 4 and figures[0]["distances"] == 16 * figures[0]["rows"] == 16 * len(told)
    assert clusters(df.limit(0), dims=dims)[0] == []
    assert clusters(df.where("vec_id = 700"), dims=dims)[0] == []


def test_few_and_equal_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    assert clusters(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], VECTORS), dims=2)[0] == brute_clusters(rows, 16, 3, 2)
    ties = [(k, [float(x), float(y)]) for k, (x, y) in enumerate((x, y) for x in range(-6, 7) for y in range(-6, 7))]
    for n_near in (1, 3):
        assert clusters(spark.createDataFrame([(i, v, "", "", "") for i, v in ties], VECTORS), k=7, rounds=6, n_near=n_near, dims=2)[0] == brute_clusters(ties, 7, 6, 2)


def test_large_components(spark):
    rows = [(k, [x * 1e6 for x in v]) for k, v in vector_rows(80, 4)]
    rows = [(k, [min(2e6, max(-2e6, x)) for x in v]) for k, v in rows]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in [*rows, (900, [1e30, 0.0, 0.0, 0.0])]], VECTORS)
    assert clusters(df, k=5, dims=4)[0] == brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5, 3, 4)


def test_bounds_spare_distances(spark):
    """On vectors in clear groups most assignments after the first are certified by bounds, and the bounds listed get fewer."""
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in vector_rows(800, 8, spread=0.05)], VECTORS)
    _, figures = clusters(df, k=9, rounds=4, n_near=7, dims=8)
    assert all(f["distances"] < 0.5 * 9 * f["rows"] for f in figures[1:]) and figures[-1]["distances"] == figures[-1]["rows"]
    assert [f["listed"] for f in figures[:2]] == [7, 7] and figures[-1]["listed"] < 7


# 12 -----------------------------------------------------------------------------------------------------------------


def brute_resample(docs, target, percent=25, min_words=20, seed=7, buckets=10_000, runs=2):
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOWER))
    feats = lambda ws: [zlib.crc32(" ".join(ws[p : p + k]).encode()) % buckets for k in range(1, runs + 1) for p in range(len(ws) - k + 1)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(feats(words(text)))
    for _, text in target:
        t.update(feats(words(text)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        ws = words(text)
        fs = feats(ws)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([-1 if i is None else i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= min_words])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))[: percent * sum(r[4] for r in out) // 100]
    rank = {}
    for k, r in enumerate(drawn):
        rank.setdefault((r[0], r[3]), []).append(k + 1)
    told = []
    for r in out:
        left = rank.get((r[0], r[3])) if r[4] else None
        told.append((*r[:4], left.pop(0) if left else 0))
    return sorted(told)


def random_texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "OF", "Äh", "é", "日本", "it's", "ÀB", "x_y", "…"]
    return [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 12, 19, 20, 21, 40, 90]))) for _ in range(n)]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_importance(spark, runs, monkeypatch):
    texts = random_texts(120, 5)
    rows = list(enumerate(texts)) + [(200, None), (201, ""), (202, " \n\t--"), (203, "y" * 70_000 + " " + "Z" * 300 + " word" * 3000), (204, texts[8]), (204, texts[8]), (None, texts[9] + " w1" * 25), (205, "a b " * 40)]
    target = [(k, " ".join(t.split()[:30])) for k, t in enumerate(texts[:15])] + [(99, None), (98, ""), (97, "never met here")]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "n") for i, t in rows], DOCS).repartition(3)
    items = spark.createDataFrame(target, "item_id long, text string")
    read = lambda d, t: sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in importance.resample(d, t, runs=runs).collect())
    assert read(df, items) == brute_resample(rows, target, runs=runs)
    assert read(df, items.limit(0)) == brute_resample(rows, [], runs=runs)
    assert read(df.limit(0), items) == []
    short = df.where("doc_id IN (200, 201, 202)")
    assert read(short, items) == brute_resample([r for r in rows if r[0] in (200, 201, 202)], target, runs=runs)


def test_tries_of_any_size_count_alike(spark, monkeypatch):
    """Tries that are emptied all the time give the same totals and weights."""
    texts = random_texts(60, 9)
    trie = importance.WordTrie(2)
    for limit, group in ((5, 100), (400_000, 4 << 20)):
        monkeypatch.setattr(importance, "MOST_WORDS", limit)
        monkeypatch.setattr(importance, "GROUP_BYTES", group)
        totals = np.zeros(10_000, dtype=np.int64)
        import pyarrow as pa

        for words in importance._groups(pa.array([t.encode() for t in texts])):
            for _, nodes, states in trie.walk(words):
                np.add.at(totals, states % 10_000, np.bincount(nodes, minlength=len(states)))
        expected = np.zeros(10_000, dtype=np.int64)
        for t in texts:
            ws = ALNUM_WORD.findall(t.translate(LOWER))
            for run in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]:
                expected[zlib.crc32(run.encode()) % 10_000] += 1
        assert (totals == expected).all()


def test_crc_states():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 64, 1000, 100_003):
        a, b = r.randbytes(13), r.randbytes(n)
        told = importance.extended(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([n]))
        assert told[0] == zlib.crc32(a + b)


# 13 -----------------------------------------------------------------------------------------------------------------


def labelled_texts(n=500, seed=4):
    """(id, text, toxic): syllable prose, in toxic ones one or two sentences with forms of a few stems."""
    r = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "te", "so", "vi", "po", "da", "fe"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    stems = ["zorgl", "quixx", "blurgh"]
    out = []
    for k in range(n):
        toxic = r.random() < 0.25
        said = [" ".join(word() for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 25))]
        for at in r.sample(range(len(said)), min(len(said), r.randint(1, 2))) if toxic else ():
            said[at] += f" {r.choice(stems)}{word()}"
        out.append((k, ". ".join(said) + ".", int(toxic)))
    return out


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    rows = labelled_texts()
    odd = [(900, None), (901, ""), (902, " .!? \n"), (903, "ba ke lo " * 20_000 + "zorglba"), (904, rows[0][1]), (904, rows[0][1]), (None, rows[1][1]), (905, "ba. " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "n") for i, t in [(i, t) for i, t, _ in rows] + odd], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, 1), (None, 0, 1), (rows[0][0], 0, None)], "doc_id long, quality int, toxic int")
    told = toxicity.find_toxic(df, labels).collect()
    assert len(told) == len(rows) + len(odd)
    by = {r.doc_id: r for r in told}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in told)
    assert all(r.held_out == (r.doc_id is None or is_held_out(r.doc_id)) for r in told)
    hidden = [(by[i], t, y) for i, t, y in rows if is_held_out(i)]
    assert sum(r.predicted == y for r, _, y in hidden) >= 0.95 * len(hidden) and {y for _, _, y in hidden} == {0, 1}
    for r, text, y in hidden:  # offending sentences are found where they are
        for s in r.sentences if y else ():
            assert any(stem in text[s.start : s.end] for stem in ("zorgl", "quixx", "blurgh"))
    assert by[900].score == by[901].score == by[902].score == 0 and by[903].predicted == 1 and by[905].predicted == 0
    text = odd[3][1]
    assert [text[s.start : s.end] == text for s in by[903].sentences] == [True]
    assert toxicity.find_toxic(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.find_toxic(df.limit(20), labels.limit(0)).collect()} == {0.0}


def test_toxicity_reads_only_allowed_labels(spark):
    """Labels of held-out rows, and ids, change nothing."""
    rows = labelled_texts(120)
    df = spark.createDataFrame([(i, t, "x", "y", "z", "n") for i, t, _ in rows], DOCS)
    schema = "doc_id long, quality int, toxic int"
    read = lambda flip: {r.doc_id: r.score for r in toxicity.find_toxic(df, spark.createDataFrame([(i, 1, 1 - y if flip and is_held_out(i) else y) for i, _, y in rows], schema)).collect()}
    assert read(False) == read(True)


def test_noisy_or_gradient():
    """The gradient of a bag against differences of its likelihood."""
    texts = ["bad words here. good day. more text here", "good day"]
    bags = toxicity.Bags(texts)
    r = np.random.default_rng(0)
    weights = np.append(r.normal(size=toxicity.BUCKETS + 1), -1.0)
    weights[toxicity.BUCKETS] = 0

    def loss(k, w, toxic):
        z = [sum(w[f] for word in words for f in toxicity.features(word)) + w[-1] for _, _, words in toxicity.sentences(texts[k])]
        p = toxicity.noisy_or(np.array(z))
        return -math.log(p if toxic else 1 - p)

    for k in (0, 1):
        for toxic in (True, False):
            buckets, slopes, bias = bags.gradient(k, weights, toxic)
            for b, slope in [*list(zip(buckets.tolist(), slopes.tolist(), strict=True))[::5], (-1, bias)]:
                if b == toxicity.BUCKETS:
                    continue
                up, down = weights.copy(), weights.copy()
                up[b] += 1e-5
                down[b] -= 1e-5
                assert (loss(k, up, toxic) - loss(k, down, toxic)) / 2e-5 == pytest.approx(slope, rel=1e-3, abs=1e-6)
