import random
import re

import numpy as np
import pytest
import xxhash

from dunning.llm.common import stage
from dunning.llm.components import connected_components
from dunning.llm.simhash import descend, drop_near_copies, forest, grow, half, links, simhash_groups


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_roots(prints, most_bits=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 300))) for _ in range(n // 3)]
    while len(out) < n:  # near copies of near copies
        words = rng.choice(out).split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_components_equal_brute_force(spark):
    bodies = texts(150) + ["", None, " \t", "one", "one two", "ONE\x0btwo", "x " * 30_000, " ", "a b c d"]
    rows = [(None if i % 50 == 7 else i % 140, t, i) for i, t in enumerate(bodies)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    prints = [brute_fingerprint(t) for t in bodies]
    roots = brute_roots(prints)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    wanted = sorted((str(i), f, str(least.get(r))) for (i, _, _), f, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == wanted
    assert sum(r.kept for r in got) == len(set(roots))


@pytest.mark.parametrize("shard, block", [(16, 8), (64, 4096)])
def test_shards_and_blocks_do_not_change_the_links(spark, shard, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fp = [int(c) for c in centres]
    for c in centres[:20]:
        fp += [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(12)]
    fp = sorted(set(fp))
    df = stage(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fp], "fp long"), "t")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(links(df, 3, shard, block)).collect()}
    roots = brute_roots(fp)
    mine = {}
    for f, r in zip(fp, roots, strict=True):
        mine.setdefault(r, set()).add(f)
    other = {}
    for f in fp:
        other.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))


def test_a_visitor_reaches_every_shard_with_a_near_resident():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    v = np.concatenate([v, v[:500] ^ (np.uint32(1) << rng.integers(0, 32, 500).astype(np.uint32))])
    nodes = grow(v, 32, 0)
    index, shard, home = descend(v, nodes, 1)
    assert np.bincount(index[home], minlength=len(v)).tolist() == [1] * len(v)
    at = dict(zip(index[home].tolist(), shard[home].tolist(), strict=True))
    visits = set(zip(index.tolist(), shard.tolist(), strict=True))
    for i in range(500):
        assert (i, at[3000 + i]) in visits and (3000 + i, at[i]) in visits
    assert half(np.array([-1], np.int64), 1)[0] == 0xFFFFFFFF


def test_forest_connects_what_links_connect_with_fewer_edges():
    a = np.arange(64, dtype=np.uint64)
    x, y = forest(a, a, 3)
    assert len(x) == 63
    assert all(int(i ^ j).bit_count() <= 3 for i, j in zip(x, y, strict=True))


def test_keeps_one_row_of_each_group_and_empty_table(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 2), (6, "A b  c d", 3), (7, "q r s t u", 4)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, root int"))
    assert got.columns == ["doc_id", "text", "root"] and sorted(r.doc_id for r in got.collect()) == [5, 7]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
