"""Integer Lloyd against plain Python; tests/llm/test_oracle.py has the SQL."""

import hashlib
import math

import numpy as np
import pytest

from dunning.llm.centroids import lloyd, matrix_of, op11_centroids, smallest_type

SCHEMA = "vec_id long, embedding array<float>, cluster string, tile int, id string"


def brute_force(rows, dims=64, clusters=16, rounds=3, seed=1):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-(2**27), min(2**27, math.floor(64 * float(np.float32(x))))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for c in range(len(at)):
            if own := [v for (_, v), f in zip(kept, found, strict=True) if f == c]:
                at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    sums = {c: sum(d for d, x in last if x == c) for _, c in last}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    out = [(i, c, d, sums[c], sum(sums.values()), names[c]) for (i, _), (d, c) in zip(kept, last, strict=True)]
    return sorted(out, key=lambda r: (r[0] is None, r))


def run(spark, tmp_path, rows):
    data = [(i, v, "c", 1, "x") for i, v in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in op11_centroids(spark, str(tmp_path)).collect()), key=lambda r: (r[0] is None, r))


def test_rounds_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(i % 5 - 2, 0.4, 64)).astype(np.float32).tolist()) for i in range(300)]
    rows += rows[:7]  # repeated rows
    rows += [(i, [0.5] * 64) for i in range(1000, 1200)]  # equal vectors
    rows += [(None, [0.25] * 64), (None, [0.26] * 64)]
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [float("nan")] + [0.1] * 63), (2005, [float("inf")] * 64), (2006, [None] + [0.1] * 63)]
    assert run(spark, tmp_path, rows) == brute_force(rows)


def test_large_components_do_not_overflow(spark, tmp_path):
    rows = [(i, [(-1.0) ** (i + j) * 10.0 ** (i % 12) for j in range(64)]) for i in range(40)]
    got, want = run(spark, tmp_path, rows), brute_force(rows)
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    assert all(a[4] == (b[4] if b[4] < 2**63 else None) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, tmp_path, n):
    rows = [(i, [i / 10] * 64) for i in range(n)]
    assert run(spark, tmp_path, rows) == brute_force(rows)


def test_blocks_of_any_width_agree(spark):
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, rng.normal(0, 1, 10).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    results = []
    for width in (3, 10):
        found, centroids = lloyd(table, dims=10, clusters=4, rounds=2, width=width)
        results.append((sorted(map(tuple, found.collect())), centroids.tolist()))
    assert results[0] == results[1] and len(results[0][0]) == 200


def test_packing():
    for x in (np.array([[-128, 127]]), np.array([[-129, 0]]), np.array([[1 << 40, -1]]), np.zeros((3, 2), np.int64)):
        assert (matrix_of(smallest_type(x.astype(np.int64)).tobytes(), *x.shape) == x).all()
    assert smallest_type(np.array([-128, 127])).itemsize == 1 and smallest_type(np.array([128])).itemsize == 2
