import hashlib
import math
import random

import numpy as np
import pytest
from data import SF, rows_of

from citesight.llm import queries
from citesight.llm import zone_clusters as Z

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, dim=64):
    """The contract in Python integers."""
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
    cents = [v for _, v in key[:k]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in rows]
    for _ in range(rounds):
        own = near()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(rows, own) if c == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = near()
    total = [sum(d for d, c in own if c == n) for n in range(len(cents))]
    cap = Z.LONG
    return sorted(((i, c, min(d, cap), min(total[c], cap), min(sum(total), cap),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(rows, own)), key=repr)


def f32(x):
    return None if x is None else float(np.float32(x))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(150).collect()]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert rows_of(Z.cluster(df, block=16)) == brute(rows)
    assert queries.op13(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [f32(rng.choice([-1.5, -0.0004, 0.0, 0.3, 2.25]) * rng.random()) for _ in range(64)]) for i in range(60)]
    rows += [rows[0]] * 40 + [(7, rows[1][1]), (None, rows[2][1]), (100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65),
                              (104, [None] + [0.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [1.0] * 63),
                              (107, [float("-inf")] + [1.0] * 63), (-5, [0.0] * 64), (108, [f32(3e5)] * 64), (109, [f32(-3e9)] * 64)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    for c in ("cluster", "distance", "key", "v", "a.b"):
        df = df.withColumn(c, df.label)
    assert rows_of(Z.cluster(df, block=7)) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [f32(-0.1)] * 64)]
    assert rows_of(Z.cluster(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))) == brute(rows)
    assert Z.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Z.cluster(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_each_cell_once_by_unit_steps(dim, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
    keys = [k.tobytes() for k in Z.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest_and_prune_far_ones():
    rng = np.random.default_rng(5)
    far = rng.integers(-5000, 5000, (40, 6))
    for _ in range(50):
        box = rng.integers(-5000, 5000, 6) + rng.integers(0, 300, (30, 6))
        low, high = box.min(0), box.max(0)
        near = Z.candidates(low, high, far)
        d = ((box[:, None] - far[None]) ** 2).sum(2)
        assert set(d.argmin(1)) <= set(near) and len(near) < 20
        got, dist = Z.assign(box, low, high, far)
        assert (got == d.argmin(1)).all() and (dist == d.min(1)).all()
