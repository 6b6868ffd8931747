"""Centroid clustering of integer vectors over Hilbert-ordered blocks with zone maps.

Vectors become integers, ``floor(scale * x)``. They are ordered along a
Hilbert curve over a grid of ``2**BITS`` cells per dimension between the
smallest and largest component of all, and cut into blocks of at most
``BLOCK`` vectors; a block is one row with its ids, its vectors and the
smallest and largest value of each dimension (its box). The blocks are written
once and read by every round.

A round compares a block's box with the centroids first. The distance from a
centroid to the nearest point of the box bounds its distance to any vector of
the block from below, that to the farthest corner from above: only centroids
whose lower bound does not exceed the smallest upper bound can be nearest to
any of the block's vectors, ties included. Exactly those are compared with all
its vectors in integer arithmetic. A task adds up its blocks and hands on at
most one row per centroid; Spark adds these, and the driver sees the sums of
``k`` centroids only.

Everything is exact: components within 2**27 are squared and summed in 64
bits, a block or centroid with larger ones is worked through in Python
integers.

Cases: vectors that are null, of another length, or hold a null, NaN or
infinite component are left out; scaled components beyond +-2**62 count as
that bound, distances and inertias beyond 2**63 - 1 are shown as that number;
repeated rows and equal ids are vectors of their own, ties among starting
centroids of equal id go to the smaller vector; a null id is hashed as an
empty one; with fewer than ``k`` vectors there are that many centroids; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesight.functions.columns import with_scalars
from citesight.llm.common import stage
from citesight.session import ship_package, shuffle_partitions

DIM, SCALE, K, ROUNDS = 64, 1024, 8, 10
BLOCK, BITS = 512, 4
#: Scaled components are held within this bound; within SAFE their squares fit 64-bit sums.
EDGE, SAFE = 1 << 62, 1 << 27
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the whole vectors of ``dim`` finite components as integers."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(float(EDGE))), F.lit(-float(EDGE)))))
    return vectors.where((F.size("embedding") == dim) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (0 to 2**bits - 1), as big-endian bytes.

    Gray-code descent from the top bit: where a dimension's bit is set the first dimension's lower bits
    are flipped, else they are exchanged with the first one's where they differ; then the bits are
    interleaved, first dimension first.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    planes = np.stack([x >> b & 1 for b in range(bits - 1, -1, -1)], axis=1)  # rows x bits x dimensions
    return np.packbits(planes.reshape(len(x), bits * n).astype(np.uint8), axis=1)


def blocks(ints: DataFrame, dim: int = DIM, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(n, ids, known, vectors, low, high): vectors in Hilbert order, a row for at most ``block`` of them."""
    span = ints.agg(F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most"))
    schema = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("vector", pa.binary())])

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                least, most = int(b.column("least")[0].as_py()), int(b.column("most")[0].as_py())
                cells = ((v.astype(np.float64) - least) * ((1 << bits) / max(most - least, 1))).astype(np.int64)
                keys = hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.tobytes() for k in keys], pa.binary()), b.column("vec_id"),
                     pa.array([r.tobytes() for r in np.ascontiguousarray(v, "<i8")], pa.binary())], schema=schema)

    def packed(batches):
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            while n >= block:
                t = pa.Table.from_batches(kept)
                yield pack(t.slice(0, block))
                kept, n = t.slice(block).to_batches(), n - block
        if n:
            yield pack(pa.Table.from_batches(kept))

    def pack(t):
        raw = b"".join(t["vector"].to_pylist())
        v = np.frombuffer(raw, "<i8").reshape(-1, dim)
        ids = t["vec_id"].combine_chunks()
        known = np.asarray(ids.is_valid())
        cells = [len(v), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.tobytes(), raw,
                 v.min(0).astype("<i8").tobytes(), v.max(0).astype("<i8").tobytes()]
        return pa.RecordBatch.from_pydict(dict(zip(("n", "ids", "known", "vectors", "low", "high"), [[c] for c in cells])))

    rows = with_scalars(ints, span).mapInArrow(keyed, "key binary, vec_id long, vector binary")
    n = shuffle_partitions(ints.sparkSession)
    rows = rows.repartitionByRange(n, "key", "vec_id", "vector").sortWithinPartitions("key", "vec_id", "vector").drop("key")
    return rows.mapInArrow(packed, "n long, ids binary, known binary, vectors binary, low binary, high binary")


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if squares of their differences fit 64-bit sums, else as Python integers."""
    small = all(len(a) == 0 or (a.min() >= -SAFE and a.max() <= SAFE) for a in arrays)
    return list(arrays) if small else [a.astype(object) for a in arrays]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that can be nearest to some vector of the box."""
    low, high, c = exact(low, high, centroids)
    gap = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(high - c))
    return np.flatnonzero((gap * gap).sum(1) <= (far * far).sum(1).min())


def assign(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number among equals) and squared distance of each vector."""
    near = candidates(low, high, centroids)
    v, c = exact(vectors, centroids[near])
    gap = v[:, None, :] - c[None, :, :]
    d = (gap * gap).sum(2)
    best = d.argmin(1)
    return near[best], d[np.arange(len(v)), best]


def _cells(batch: pa.RecordBatch, i: int, dim: int):
    low, high = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("low", "high"))
    return np.frombuffer(batch.column("vectors")[i].as_py(), "<i8").reshape(-1, dim), low, high


def _sums(centroids: np.ndarray):
    """Task: per centroid the number and the component sums (as text, any size) of its vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            for i in range(batch.num_rows):
                v, low, high = _cells(batch, i, dim)
                near, _ = assign(v, low, high, centroids)
                for c in np.unique(near):
                    own = exact(v[near == c])[0]
                    counts[c] += len(own)
                    sums[c] += own.sum(0).astype(object)
        full = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(full, pa.int32()), "n": pa.array([counts[c] for c in full], pa.int64()),
            "sums": pa.array([[str(x) for x in sums[c]] for c in full], pa.list_(pa.string()))})
    return run


def _closest(centroids: np.ndarray):
    """Task: (vec_id, cluster, distance) of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                near, d = assign(*_cells(batch, i, dim), centroids)
                known = np.frombuffer(batch.column("known")[i].as_py(), bool)
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(ids, pa.int64(), mask=~known), "cluster": pa.array(near, pa.int32()),
                    "distance": pa.array(np.minimum(d, LONG).astype(np.int64), pa.int64())})
    return run


def fit(parts: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds; the driver holds k sums per round."""
    centroids = start
    for _ in range(rounds):
        own = parts.mapInArrow(_sums(centroids), "cluster int, n long, sums array<string>")
        one = own.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
        done = one.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for r in done.collect():  # k x dim numbers
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    ints = integers(vectors, dim, scale)
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = ints.withColumn("key", key).orderBy("key", "v").limit(k).collect()  # k rows
    start = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    parts = stage(blocks(ints, dim, block, bits), "zone-blocks")
    centroids = fit(parts, start, rounds) if len(start) else start
    near = stage(parts.mapInArrow(_closest(centroids), "vec_id long, cluster int, distance long"), "zone-rows")
    names = spark.createDataFrame(pd.DataFrame({
        "cluster": np.arange(len(centroids), dtype=np.int32),
        "centroid_sha256": [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]}),
        "cluster int, centroid_sha256 string")  # k rows
    capped = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    inertia = near.groupBy("cluster").agg(capped.alias("cluster_inertia")).join(F.broadcast(names), "cluster")
    out = near.join(F.broadcast(inertia), "cluster")
    return with_scalars(out, near.agg(capped.alias("inertia"))).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
