"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dunning.llm.merkle import op12_merkle, prefix_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, slot int, path binary"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_force(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        lower = row[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        leaf = h(*map(field, row))
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf, h(*map(field, (*row[:4], lower))) if hit else leaf))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            first = i // 8 * 8
            out.append((nodes[first:i], nodes[i + 1 : first + 8]))
            i //= 8
        return out

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for *_, leaf, _ in sorted(v)]) for g, v in groups.items()}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (known, id, leaf, changed) in enumerate(sorted(groups[g])):
            way = path(trees[g], i) + path(top, at)
            fold = changed
            for left, right in way:
                fold = h(*left, fold, *right)
            proof = h(*[x for left, right in way for x in left + right])
            out.append((id if known else None, leaf, trees[g][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def run(spark, tmp_path, rows):
    """Through a table with clashing extra columns."""
    data = [(i, t, g, s, n, "x", 1, b"y") for i, s, g, n, t in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in op12_merkle(spark, str(tmp_path)).collect()), key=lambda r: tuple(map(str, r)))


def test_trees_of_all_shapes(spark, tmp_path):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(0, 700, 7)]  # 100 leaves, three levels
    rows += [(i * 10**15, "s", "fr", None, "") for i in range(-9, 8)]  # far apart, both signs
    rows += [(v, None, "xx", 0, "Å é") for v in (-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, -64, -65)]
    rows += [(5, "s", "lone", 1, None)]
    rows += [(1, "s", None, 1, "ABC"), (2, "s", "", 1, "ABC")]  # null and empty are two groups
    rows += [(7, "s", "de", 1, f"Again {i % 11}") for i in range(30)]  # one id, several and equal rows
    rows += [(8, "s", "de", 1, "after"), (6, "s", "de", 1, "before")]
    rows += [(None, "s", "de", 1, f"Unknown {i % 3}") for i in range(9)]  # first of their group
    rows += [(None, None, "nulls", None, None)]
    assert run(spark, tmp_path, rows) == brute_force(rows)


def test_more_than_one_level_of_groups(spark, tmp_path):
    rows = [(i, "s", f"l{i % 11}", 1, f"T{i}") for i in range(40)]
    assert run(spark, tmp_path, rows) == brute_force(rows)


def test_one_row_is_the_root(spark, tmp_path):
    ((_, leaf, subroot, root, proof, fold, _),) = run(spark, tmp_path, [(4, "s", "en", 1, "no capitals")])
    assert leaf == subroot == root == fold and proof == h("")


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_very_long_text(spark, tmp_path):
    rows = [(1, "s", "en", 1, "A b " * 500_000), (2, "s", "en", 1, "x")]
    assert run(spark, tmp_path, rows) == brute_force(rows)


@pytest.mark.parametrize("step", [1, 5000, 1 << 40])
def test_directory_is_a_prefix_sum(spark, step):
    keys = [(k % 2 == 0, (k - 300) * step, k % 4 + 1) for k in range(600)]
    got = {(r.g, r.key): (r.before, r.total) for r in prefix_counts(spark.createDataFrame(keys, "g boolean, key long, m long"), ["g"], "key", "m").collect()}
    for g, key, _ in keys:
        same = [(k, m) for x, k, m in keys if x == g]
        assert got[g, key] == (sum(m for k, m in same if k < key), sum(m for _, m in same))


def test_windows_of_the_directory_stay_small(spark):
    """Siblings only: no partition holds a whole group."""
    rows = spark.range(50_000).select(F.lit("a").alias("g"), (F.col("id") * 3).alias("key"), F.lit(1).cast("long").alias("m"))
    out = prefix_counts(rows, ["g"], "key", "m")
    assert out.filter("before <> key / 3 OR total <> 50000").isEmpty()
