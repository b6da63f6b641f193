"""Hard negatives, centroids and exact copies against brute force, with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import elkan, exact_dedup, norm_search, vectors

ROWS = "vec_id long, embedding array<float>, label int, row string, x string, norm string, cluster string, n string"


def table(spark, rows):
    """Rows of vec_id, embedding and label with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], ROWS)


def whole(v):
    return [max(-vectors.LARGEST, min(vectors.LARGEST, math.floor(256 * float(np.float32(x))))) for x in v]


def is_finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def awkward(rng, dims):
    return [
        (3, None, 1),
        (4, [0.5] * dims, None),
        (None, [0.25] * dims, 1),
        (5, [float("nan")] * dims, 2),
        (6, [0.1] * (dims - 1) + [float("inf")], 2),
        (8, [0.1] * (dims - 1) + [None], 2),
        (9, [], 1),
        (200, [], 1),
        (10, [0.5] * (dims - 3), 1),
        (300, [0.5] * (dims - 3), 1),
        (11, [1e30] + [0.0] * (dims - 1), 3),
        (400, [-1.0] * dims, 1),
    ]


# 11: hard negatives


def brute_negatives(rows):
    kept = [(n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole(v)) for n, (i, v, label) in enumerate(rows) if label is not None and is_finite(v)]
    first = lambda found, k: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    out = []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, j, other, w in kept if m != n and len(w) == len(v)]
        for p, positive, _ in first([s for s in scored if s[2] == label], 5):
            window = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, positive, rank + 1, j, p, s) for rank, (s, j, _) in enumerate(first(window, 10))]
    return sorted(map(repr, out))


def negatives(spark, rows):
    df = table(spark, rows)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = norm_search.hard_negatives(df, "vec_id", "embedding", label, F.col("id") % 100 == 0)
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_negatives_equal_brute_force(spark, spread):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) * math.exp(rng.gauss(0, spread)) for _ in range(8)], rng.randrange(4)) for i in range(3, 903)]
    rows += awkward(rng, 8)
    assert negatives(spark, rows) == brute_negatives(rows)


def test_negatives_with_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0], 1) for i in range(1000, 1400)] + [(2000, [1.0, 1.0, 1.0], 2)] * 3
    rows += [(i, [-1.0, 0.0, 0.0], 9) for i in (500, 501)]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_negatives_over_many_blocks_and_rounds(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("PACKED", 64), ("QUERY_BYTES", 4000)):
        monkeypatch.setattr(norm_search, name, value)
    rng = random.Random(2)
    rows = [(i * 20, [rng.gauss(0, 1) * (1 + i % 9) for _ in range(5)], rng.randrange(3)) for i in range(1, 600)]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_norms_exclude_blocks():
    """Of two blocks of small norm none is scored once the lists are full: their product of norms is below the kth score."""
    block = lambda x, first: norm_search.Block(
        {"n": len(x), "top": float(np.linalg.norm(x, axis=1).max()), "x": np.array(x, np.int32).tobytes(), "rows": np.arange(first, first + len(x)).tobytes()}
        | {"ids": np.arange(first, first + len(x)).tobytes(), "absent": np.zeros(len(x), bool).tobytes(), "labels": np.ones(len(x), np.int64).tobytes(), "low": b"", "high": b""}
    )
    asked = block([[10, 0]], 0)
    asked.low, asked.high = np.array([[norm_search.NONE]]), np.array([[1 << 60]])
    best = norm_search.Best(asked, 2)
    norm_search.meet(asked, block([[9, 1], [9, 2], [8, 0]], 10), best, True)
    assert best.scores.tolist() == [[[90, 90]]] and best.ids.tolist() == [[[10, 11]]]
    low = block([[5, 5], [6, 0]], 20)
    low.labels = None  # would fail if it were looked at
    norm_search.meet(asked, low, best, True)
    equal = block([[9, 0]], 5)
    norm_search.meet(asked, equal, best, True)
    assert best.ids.tolist() == [[[5, 10]]]


def test_no_negatives_without_rows_or_anchors(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert negatives(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []


def test_large_numbers_are_exact(spark):
    rows = [(i * 50, [float(400_000 + i), float(i)], i % 2) for i in range(40)]
    assert negatives(spark, rows) == brute_negatives(rows)


# 12: centroids


def brute_clusters(rows, k, rounds, size):
    kept = [(i, whole(v)) for i, v, _ in rows if is_finite(v) and len(v) == size]
    points = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(points))
    for _ in range(rounds):
        own = [[] for _ in points]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        points = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(points, own)]
    return sorted(repr((i, n, d)) for i, v in kept for d, n in [nearest(v)]), points


def told(df, points):
    return sorted(repr((r["vec_id"], r["cluster"], r["distance"])) for r in df.collect()), points


@pytest.mark.parametrize("step", [0.001, 1.0])
def test_clusters_equal_brute_force(spark, step):
    """Also on a coarse grid, where many distances are equal and rows repeat."""
    rng = random.Random(12)
    rows = [(i, [round(rng.gauss(0, 1) / step) * step for _ in range(4)], 1) for i in range(600)] + [(1000 + i, [1.0] * 4, 1) for i in range(200)]
    rows += [(7, [2.0] * 4, 1)] * 3 + awkward(rng, 4)
    assert told(*elkan.cluster(table(spark, rows), k=12, rounds=5, size=4)) == brute_clusters(rows, 12, 5, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1), (3, [3.0, 2.0], 1)]
    found = elkan.cluster(table(spark, rows), size=2)
    assert told(*found) == brute_clusters(rows, 40, 5, 2)
    assert {r["inertia"] for r in elkan.with_inertia(*found).collect()} == {0}
    none = elkan.with_inertia(*elkan.cluster(table(spark, [(1, None, 1), (2, [1.0], 1)]), size=2))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_skip_distances_and_stay_bounds():
    rng = np.random.default_rng(3)
    middles = rng.integers(-2000, 2000, (10, 6))
    x = (middles[rng.integers(0, 10, 3000)] + rng.integers(-30, 30, (3000, 6))).astype(np.int64)
    points, before = x[:10].tolist(), None
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf, np.float32), np.zeros((len(x), 10), np.float32)
    computed = []
    for _ in range(5):
        cluster, upper, lower, _, n = elkan.assign(x, cluster, upper, lower, elkan.Centroids(points, before))
        far = np.sqrt(((x[:, None, :] - np.array(points)[None, :, :]) ** 2).sum(2))
        assert (cluster == far.argmin(1)).all() and (upper >= far.min(1)).all() and (lower <= far).all()
        computed.append(n.sum())
        before, points = points, [(x[cluster == c].sum(0) // max(1, (cluster == c).sum())).tolist() if (cluster == c).any() else points[c] for c in range(10)]
    assert computed[0] < 10 * len(x) and computed[-1] < 0.3 * 10 * len(x)


def test_inertia_and_digest(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], 1) for i in range(50)]
    df, points = elkan.cluster(table(spark, rows), k=4, rounds=2, size=3)
    got = elkan.with_inertia(df, points).collect()
    assert len(got) == 50 and {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for r in got:
        assert r["cluster_inertia"] == sum(o["distance"] for o in got if o["cluster"] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, points[r["cluster"]])).encode()).hexdigest()


# 13: exact copies

LOW = {i: i + 32 for i in range(65, 91)}


def copies(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, digest string, salt int, keep_id int")


def brute_marks(rows):
    """Marks of every row; of rows that repeat the largest id of a class, one is kept."""
    classes = {}
    for i, t in rows:
        classes.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for t, ids in classes.items():
        keep = max((i for i in ids if i is not None), default=None)
        marks = [(i, keep, len(ids), False) for i in ids]
        marks[ids.index(keep)] = (keep, keep, len(ids), True)
        out += [repr((*m, hashlib.sha256(t.encode()).hexdigest())) for m in marks]
    return sorted(out)


def texts_with_copies():
    long = " ".join(f"Word{i}" for i in range(40_000))
    rows = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, "ÉTÉ"), (4, "été"), (5, "Été"), (6, None), (7, ""), (8, " "), (10, long), (11, long.upper()), (12, long + "."), (13, "K"), (14, "k")]
    rows += [(None, "lost"), (None, "Lost"), (15, "LOST"), (None, "none"), (None, "none"), (16, "twice"), (16, "twice"), (16, "other"), (16, "Twice")]
    return rows + [(100 + i, "Hot Copy" if i % 3 else f"text {i % 40}") for i in range(3000)]


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_marks_equal_brute_force(spark, digest_bytes):
    """Also where different texts share a digest."""
    rows = texts_with_copies()
    found = exact_dedup.marked(copies(spark, rows).repartition(7), digest_bytes=digest_bytes)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_marks(rows)


def test_marks_of_no_rows(spark):
    assert exact_dedup.marked(copies(spark, [])).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a"), (2, "A"), (3, None), (4, ""), (5, "b")]
    stay = exact_dedup.deduplicated(copies(spark, rows))
    assert stay.columns == ["doc_id", "text", "digest", "salt", "keep_id"]
    assert sorted((r["doc_id"], r["text"], r["digest"]) for r in stay.collect()) == [(2, "A", "x"), (4, "", "x"), (5, "b", "x")]


def test_marks_need_no_python_worker(spark):
    from panelwright.llm import queries

    plan = queries.op13_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
