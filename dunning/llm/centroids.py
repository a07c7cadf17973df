"""Lloyd clustering in integers, sharded by dimension.

A vector's components are cut into column blocks.  Vectors travel in tiles: a
row of the block table holds one block of up to 4096 vectors as a matrix.

1. A block task meets only its own columns and its own slice of the centroids,
   and gives the exact partial distance of each vector to each centroid.
2. The partial distances of a tile are keyed by tile and added up; the smallest
   total (ties: smaller number) is the assignment.
3. Assignments, a byte or so for each vector, go back to the blocks.  Each block
   adds up its columns by cluster, and updates its own slice of the centroids:
   the floor of sum by count, in decimals.

Only the centroids (clusters x components) pass through the driver.  A tile
bounds what a task holds; no group depends on the data, so equal vectors or a
cluster of nearly all of them are no hot key.  The tiles are written to the
shared folder; every round starts from these files.

Defined results: vectors with another number of components, or with a null or
non-finite one, are left out.  Components are clipped to +-2**27 after scaling,
so that a squared distance always fits a long.  Repeated rows are vectors of
their own; a null id is kept, and comes last in the order of seeds; equal ids
are seeded in the order of their components.  With fewer vectors than clusters
there are as many clusters as vectors; an empty table gives no rows.  A sum of
distances that no long can hold is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, column, read_table, stage

by_value(__name__)

TILE = 4096
LARGEST = 1 << 27
BLOCKS = "tile string, block int, n int, values binary, ids array<bigint>"


def integer_vectors(table: DataFrame, key: str, value: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the components as integers, of the rows that count."""
    vector = column(table, value)
    sound = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return table.filter(F.coalesce(sound, F.lit(False))).select(column(table, key).cast("long").alias("id"), whole.alias("v"))


def smallest_type(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = max(-int(x.min()) - 1, int(x.max())) if x.size else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def matrix_of(data: bytes, rows: int, columns: int) -> np.ndarray:
    """The matrix that :func:`smallest_type` packed, as longs."""
    return np.frombuffer(data, f"<i{len(data) // (rows * columns)}").reshape(rows, columns).astype(np.int64)


def column_blocks(vectors: DataFrame, dims: int, width: int) -> DataFrame:
    """Tiles of :func:`integer_vectors` by block of ``width`` columns, and with
    block -1 the ids of each tile."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                some = batch.slice(at, TILE)
                n, tile = some.num_rows, uuid.uuid4().hex
                v = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
                parts = [smallest_type(v[:, lo : lo + width]).tobytes() for lo in range(0, dims, width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tile] * (len(parts) + 1)),
                        pa.array([-1, *range(len(parts))], pa.int32()),
                        pa.array([n] * (len(parts) + 1), pa.int32()),
                        pa.array([None, *parts], pa.binary()),
                        pa.array([some.column(0).to_pylist()] + [None] * len(parts), pa.list_(pa.int64())),
                    ],
                    ["tile", "block", "n", "values", "ids"],
                )

    return vectors.mapInArrow(cut, BLOCKS)


def assignments(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """``tile``, ``n`` and packed ``clusters`` and ``distances``."""
    k, dims = centroids.shape
    slices = {b: centroids[:, lo : lo + width] for b, lo in enumerate(range(0, dims, width))}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = slices[row["block"]]
                x = matrix_of(row["values"], row["n"], own.shape[1])
                part = np.empty((row["n"], k), np.int64)
                for c in range(k):
                    off = x - own[c]
                    part[:, c] = np.einsum("ij,ij->i", off, off)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tile"]]), pa.array([row["n"]], pa.int32()), pa.array([smallest_type(part).tobytes()], pa.binary())],
                    ["tile", "n", "part"],
                )

    def nearest(parts: pa.Table) -> pa.Table:
        n = parts.column("n")[0].as_py()
        total = np.zeros((n, k), np.int64)
        for part in parts.column("part").to_pylist():
            total += matrix_of(part, n, k)
        best = total.argmin(axis=1)
        return pa.table(
            {
                "tile": parts.column("tile").slice(0, 1).cast(pa.string()),
                "n": pa.array([n], pa.int32()),
                "clusters": pa.array([smallest_type(best).tobytes()], pa.binary()),
                "distances": pa.array([total[np.arange(n), best].tobytes()], pa.binary()),
            }
        )

    found = blocks.select("tile", "block", "n", "values").mapInArrow(partial, "tile string, n int, part binary")
    return found.groupBy("tile").applyInArrow(nearest, "tile string, n int, clusters binary, distances binary")


def updated(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The next centroids: each block's slice from its own columns."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                b, n = row["block"], row["n"]
                x = matrix_of(row["values"], n, min(width, dims - b * width))
                of = matrix_of(row["clusters"], n, 1)[:, 0]
                total.setdefault(b, np.zeros((k, x.shape[1]), np.int64))
                np.add.at(total[b], of, x)
                count[b] = count.get(b, np.zeros(k, np.int64)) + np.bincount(of, minlength=k)
        for b, t in total.items():
            c, d = np.indices(t.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((c.ravel()).astype(np.int32)),
                    pa.array((d.ravel() + b * width).astype(np.int32)),
                    pa.array(t.ravel()),
                    pa.array(np.repeat(count[b], t.shape[1])),
                ],
                ["cluster", "dim", "total", "members"],
            )

    both = blocks.select("tile", "block", "n", "values").join(assigned.select("tile", "clusters"), "tile")
    added = both.select("block", "n", "values", "clusters").mapInArrow(sums, "cluster int, dim int, total long, members long")
    added = added.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("members").cast("decimal(28,0)").alias("members"))
    floor = F.expr("CAST((total - pmod(total, members)) / members AS long)")
    after = centroids.copy()
    for row in added.filter("members > 0").select("cluster", "dim", floor.alias("at")).toLocalIterator():
        after[row["cluster"], row["dim"]] = row["at"]  # clusters x components, whatever the input
    return after


def lloyd(
    table: DataFrame, key: str = "vec_id", value: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, width: int = 16
) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``cluster`` and ``distance`` (squared, to the final centroid) of
    every vector that counts, and the centroids.  ``width`` columns to a block.

    The first centroids are the vectors with the smallest hash of seed and id.
    """
    vectors = integer_vectors(table, key, value, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = vectors.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), dims)
    if not seeds:
        return table.sparkSession.createDataFrame([], "id long, cluster int, distance long"), centroids
    tiles = stage(column_blocks(vectors, dims, width), "tiles")
    blocks = tiles.filter("block >= 0")
    for _ in range(rounds):
        centroids = updated(blocks, assignments(blocks, centroids, width), centroids, width)
    last = stage(assignments(blocks, centroids, width), "assigned")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[i].values,
                        pa.array(matrix_of(batch.column("clusters")[i].as_py(), n, 1)[:, 0].astype(np.int32)),
                        pa.array(np.frombuffer(batch.column("distances")[i].as_py(), np.int64)),
                    ],
                    ["id", "cluster", "distance"],
                )

    ids = tiles.filter("block = -1").select("tile", "ids")
    return ids.join(last, "tile").select("n", "ids", "clusters", "distances").mapInArrow(rows, "id long, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its cluster after three rounds, 16 clusters."""
    found, centroids = lloyd(read_table(spark, sf_dir, "embeddings"))
    found = stage(found, "clusters")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("inertia"))
    own = {r["cluster"]: int(r["inertia"]) for r in inertia.collect()}  # a row for each cluster

    def by_cluster(values: dict, kind: str):
        pairs = [x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(kind))]
        return F.element_at(F.create_map(*pairs), F.col("cluster")) if pairs else F.lit(None).cast(kind)

    fits = lambda v: v if v < 1 << 63 else None
    names = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        by_cluster({c: fits(v) for c, v in own.items()}, "long").alias("cluster_inertia"),
        F.lit(fits(sum(own.values()))).cast("long").alias("inertia"),
        by_cluster(names, "string").alias("centroid_sha256"),
    )
