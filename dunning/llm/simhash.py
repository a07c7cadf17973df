"""SimHash near-duplicates with vantage-point trees (operator 2).

Distinct 64-bit fingerprints that differ in at most ``most_bits`` bits are
linked.  A vantage-point tree over all 64 bits cannot prune here: distances of
unrelated fingerprints lie within a few bits of 32, so nearly every branch is
within reach.  Hence one tree for each half: if two fingerprints differ in at
most r bits, they differ in at most r // 2 bits in one half, so a tree over
that half with the smaller radius finds the pair, and few branches lie within
that radius of a boundary.

A tree is built from a bounded sample and only decides where rows go; results
do not depend on it.  Every fingerprint has one home shard for each tree, and
visits besides each shard that the triangle inequality cannot exclude.  Visitors
are compared with residents on all 64 bits.  Shards larger than a block are
dealt out block against block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, column, pieces, read_table, signed, stage, text_bytes, unwrapped, with_location
from .components import connected_components

by_value(__name__)

#: Fingerprints that the driver sees to lay out the trees, at most.
SAMPLE = 65_536
#: Residents of a shard that a tree aims at, and rows of a side of one comparison.
SHARD, BLOCK = 2_048, 4_096


# --- fingerprints -------------------------------------------------------------


def fingerprint_of_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run h[at[i]:at[i + 1]] the bits set in over half its hashes."""
    rows = len(at) - 1
    out = np.zeros(rows, np.uint64)
    n = np.diff(at)
    owner = np.repeat(np.arange(rows), n)
    bit_of = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for k in range(8):
        byte = (h >> np.uint64(8 * k)) & np.uint64(255)
        counts = np.bincount(owner * 256 + byte.astype(np.int64), minlength=rows * 256).reshape(rows, 256) @ bit_of
        bits = (2 * counts > n[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
    return out


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 with seed 42 of each k words of a lower-cased text, repeats
    included; of all words if there are fewer; none if there is none."""
    words = text.lower().split()  # on bytes: A-Z only, and space and \t to \r only
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), 42)]
    if k == 3:
        return [h(b"%b %b %b" % w, 42) for w in zip(words, words[1:], words[2:], strict=False)]
    return [h(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]


def fingerprints(located: DataFrame, text: str, doc_id: str, k: int = 3) -> DataFrame:
    """id, file, row and fp (signed 64 bits) of every row."""
    narrow = located.select(F.col("doc")[doc_id].alias("id"), "file", "row", F.col("doc")[text].cast("string").alias("text"))
    schema = narrow.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    shape = narrow.drop("text").columns

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            raw, at = text_bytes(piece.column(piece.schema.get_field_index("text")))
            raw = raw.tobytes()
            each = [shingle_hashes(raw[at[i] : at[i + 1]], k) for i in range(len(at) - 1)]
            runs = np.cumsum([0, *map(len, each)])
            fp = fingerprint_of_hashes(np.array([x for e in each for x in e], np.uint64), runs)
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in shape), pa.array(signed(fp))], [*shape, "fp"])

    return narrow.mapInArrow(run, schema)


# --- the trees ----------------------------------------------------------------


def grow(values: np.ndarray, shards: int, seed: int) -> list[tuple[int, int]]:
    """A balanced vantage-point tree over 32-bit values as a heap: node i has
    (vantage point, bound); values within the bound go to child 2i + 1, others
    to 2i + 2."""
    depth = max(0, int(np.ceil(np.log2(max(1, shards)))))
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = []
    parts = [values]
    for _ in range(depth):
        below = []
        for part in parts:
            point = int(part[rng.integers(len(part))]) if len(part) else int(rng.integers(1 << 32))
            far = np.bitwise_count(part ^ np.uint32(point))
            bound = int(np.median(far)) if len(far) else 15
            if len(far) and (far <= bound).all() and bound:  # leave something outside
                bound -= 1
            nodes.append((point, bound))
            below += [part[far <= bound], part[far > bound]]
        parts = below
    return nodes


def descend(values: np.ndarray, nodes: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the value, shard, whether it is at home there): the home shard
    and each shard that may hold a value within ``radius``."""
    index, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    if not nodes:
        return index, node, home
    points = np.array([p for p, _ in nodes], np.uint32)
    bounds = np.array([b for _, b in nodes], np.int16)
    for _ in range(int(np.log2(len(nodes) + 1))):
        far = np.bitwise_count(values[index] ^ points[node]).astype(np.int16)
        inside = far <= bounds[node]
        go_in, go_out = far - radius <= bounds[node], far + radius > bounds[node]
        index = np.concatenate([index[go_in], index[go_out]])
        home = np.concatenate([(home & inside)[go_in], (home & ~inside)[go_out]])
        node = np.concatenate([2 * node[go_in] + 1, 2 * node[go_out] + 2])
    return index, node, home


def half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * tree)).astype(np.uint32)


def forest(a: np.ndarray, b: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that the links between values of ``a`` and of
    ``b`` connect: fewer than there are values, whatever the number of links."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = place[: len(a)], place[len(a) :]
    parent = np.arange(len(values))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    label = parent.copy()
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= most_bits
        near &= label[ia[at : at + 256]][:, None] != label[ib][None, :]  # not yet connected
        changed = False
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = find(ia[at + i]), find(ib[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(ia[at + i])
                right.append(ib[j])
                changed = True
        if changed:
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            label = parent
    return values[np.array(left, np.int64)], values[np.array(right, np.int64)]


def links(distinct: DataFrame, most_bits: int = 3, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` that connect the
    same fingerprints as all pairs at ``most_bits`` or fewer bits do."""
    total = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 32 * (1 + total // shard))).collect()], np.int64)
    shards = min(max(1, len(sample) // 8), -(-total // shard))
    trees = [grow(half(sample, t), shards, t) for t in (0, 1)]
    radius = most_bits // 2

    def route(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0), np.int64)
            for t in (0, 1):
                index, node, home = descend(half(fp, t), trees[t], radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(index), t, np.int32)), pa.array(node), pa.array(home), pa.array(fp[index])],
                    ["tree", "shard", "home", "fp"],
                )

    rows = distinct.select("fp").mapInArrow(route, "tree int, shard long, home boolean, fp long")
    rows = stage(rows, "vantage-shards")
    # one row for each shard: at most SAMPLE / 2 of them
    sizes = rows.groupBy("tree", "shard").agg(
        F.count_if("home").alias("residents"), F.count(F.lit(1)).alias("visitors")
    ).filter("residents > 0 and visitors > 1").select(
        "tree", "shard", F.ceil(F.col("residents") / block).cast("int").alias("h"), F.ceil(F.col("visitors") / block).cast("int").alias("q")
    )
    dealt = rows.join(F.broadcast(sizes), ["tree", "shard"])
    own = F.xxhash64("fp")
    as_resident = dealt.filter("home").select(
        "tree", "shard", F.pmod(own, "h").cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), F.lit(True).alias("resident"), "fp"
    )
    as_visitor = dealt.select(
        "tree", "shard", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("hb"), F.pmod(own, "q").cast("int").alias("qb"), F.lit(False).alias("resident"), "fp"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        at_home = pdf["resident"].to_numpy(bool)
        a, b = forest(fp[~at_home], fp[at_home], most_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return as_resident.union(as_visitor).groupBy("tree", "shard", "hb", "qb").applyInPandas(compare, "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, most_bits: int = 3) -> DataFrame:
    """One row for each row of ``docs``: file, row, id, fp, component_id, kept.

    Words are runs without blanks, A-Z lower-cased; null and blank texts have
    no words and fingerprint zero, which links like any other.  component_id is
    the smallest id of the rows reachable (null if none has an id).  ``kept``
    marks one row of each component: that of the smallest id, of equal ids the
    first location.  An empty table gives no rows.
    """
    return groups_of(with_location(docs.select(column(docs, doc_id), column(docs, text))), text, doc_id, k, most_bits)


def groups_of(located: DataFrame, text: str, doc_id: str, k: int, most_bits: int) -> DataFrame:
    prints = stage(fingerprints(located, text, doc_id, k), "fingerprints")
    keeper = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    distinct = stage(prints.groupBy("fp").agg(F.min(keeper).alias("keeper")), "distinct-fingerprints")
    found = connected_components(stage(links(distinct, most_bits), "fingerprint-links"))
    rooted = stage(
        distinct.join(found, distinct.fp == found.node, "left").select("fp", "keeper", F.coalesce("root", "fp").alias("root")), "roots"
    )
    best = rooted.groupBy("root").agg(F.min("keeper").alias("best"))
    of = rooted.join(best, "root").select("fp", "best")
    return prints.join(of, "fp").select(
        "file",
        "row",
        "id",
        "fp",
        F.col("best.id").alias("component_id"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, most_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each group that :func:`simhash_groups`
    finds; all columns and their order stay."""
    located = with_location(docs)
    keep = groups_of(located, text, doc_id, k, most_bits).filter("kept").select("file", "row")
    return unwrapped(located.join(keep, ["file", "row"], "left_semi"), docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
