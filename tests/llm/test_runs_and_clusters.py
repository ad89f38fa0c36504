"""Periodic runs and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from binascii import crc32

import numpy as np
import pytest

from shoebox.llm import clustering, periodic_runs, queries


def all_runs(words):
    """Every run by comparing words one period apart; the smallest period of a stretch wins."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_runs(rng, n):
    """Texts of few or many different words, with repeated parts inside repeated parts."""
    for _ in range(n):
        size = rng.choice([1, 2, 3, 5, 50])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            part = words[(a := rng.randrange(len(words) + 1)) : a + rng.randrange(12)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part * rng.randrange(1, 9) + part[: rng.randrange(len(part) + 1)]
        yield words


def test_runs_equal_brute_force():
    for words in texts_with_runs(random.Random(7), 1500):
        ids = [hash(w) for w in words]
        assert periodic_runs.runs_between(ids, 0, len(ids)) == all_runs(words), words


def test_regions_hold_every_run(spark):
    rows = [(i, rng_sep.join(w)) for i, (w, rng_sep) in enumerate(zip(texts_with_runs(random.Random(8), 700), [" ", "\n", "\t \x0b"] * 300))]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == 700
    for r in found:
        words = rows[r["doc_id"]][1].split()
        runs = all_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_of_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "A a A a A a A a"), (5, "a a a a a"), (6, "é " * 7), (7, "x y " * 60_000)]
    docs = spark.createDataFrame([(i, t, "r", 1, "w") for i, t in rows], "doc_id bigint, text string, row string, id int, runs string")
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()]
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (None, [(0, 8, 2)], "A a"), (5, [], "a a a a a"), (6, [(0, 7, 1)], "é"), (7, [(0, 120_000, 2)], "x y")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    carried = periodic_runs.periodic_runs(docs, carry=True)
    assert carried.select("row.*").columns == docs.columns
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def told(doc_id, text):
    """The rows of the query, step by step."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-math.floor(1e12 * r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *digest)


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", " \x0c"]).join(w) or None) for i, w in enumerate(texts_with_runs(rng, 400))]
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(300))) for i in range(400, 600)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [told(*r) for r in rows]
    assert sum(crc32(str(i).encode()) % 10 == 0 for i in range(600)) > 30
    assert sorted(map(tuple, found.collect())) == sorted(want)


def plain_clusters(rows, k, rounds):
    """Every vector against every centroid in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for n, (_, v) in zip(at, kept, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = [place(v) for _, v in kept]
    total = {c: sum(d for d, n in ends if n == c) for c in range(len(centroids))}
    return [(i, n, d, total[n], sum(total.values()), centroids[n]) for (i, _), (d, n) in zip(kept, ends, strict=True)]


@pytest.mark.parametrize("kind", ["spread", "tight", "line", "same", "far"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n, dims = 300, 6
    v = {
        "spread": rng.normal(size=(n, dims)),
        "tight": rng.integers(-2, 3, (n, dims)) + rng.normal(scale=0.01, size=(n, dims)),
        "line": np.outer(rng.integers(-9, 9, n), np.ones(dims)),
        "same": np.ones((n, dims)),
        "far": rng.normal(size=(n, dims)) * np.where(rng.random(n) < 0.02, 1e5, 1e-2)[:, None],
    }[kind]
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [rows[5], (5, rows[6][1]), (None, rows[7][1])]
    more = [(900, None), (901, [1.0] * (dims - 1)), (902, [None] + [1.0] * (dims - 1)), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, [])]
    table = spark.createDataFrame([(i, x, 1, "c") for i, x in rows + more], "vec_id bigint, embedding array<double>, id int, cluster string")
    found = clustering.cluster(table, dims=dims, k=12, rounds=4).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_clusters(rows, 12, 4), key=repr)


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert clustering.cluster(empty).count() == 0
    three = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "vec_id bigint, embedding array<float>")
    assert sorted((r["vec_id"], r["distance"]) for r in clustering.cluster(three, dims=2).collect()) == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(spark.createDataFrame([(1, [1e9])], "vec_id bigint, embedding array<double>"), dims=1)


def test_bounds_leave_few_comparisons_on_clusters():
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (40, 64))
    vectors = centres[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 64))
    base = clustering.simplex(centres)
    found, best, compared = clustering.nearest(vectors, clustering.apexes(vectors, base), centres, clustering.apexes(centres, base))
    exact = ((vectors[:, None, :] - centres[None]) ** 2).sum(2)
    assert (found == exact.argmin(1)).all() and (best == exact.min(1)).all() and compared < 2 * len(vectors)
