import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.llm.common import with_location
from dunning.llm.decontaminate import (
    GAP,
    MATCH,
    MISMATCH,
    SCORE,
    align,
    benchmark_items,
    candidate_pairs,
    contaminated,
    drop_contaminated,
    op6_decontaminate,
    seed_rule,
)


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max()


def test_alignment_scores_equal_dynamic_programming():
    rng = np.random.default_rng(0)
    some = [(rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 25))) for _ in range(200)]
    pad = lambda rows: np.array([np.r_[r, np.zeros(30 - len(r), np.int64)] for r in rows])
    a, b = [x for x, _ in some], [y for _, y in some]
    best, end = align(pad(a), np.array(list(map(len, a))), pad(b), np.array(list(map(len, b))))
    assert best.tolist() == [brute_align(x, y) for x, y in some]
    for x, y, s, e in zip(a, b, best, end, strict=True):
        assert s == 0 or brute_align(x, y[:e]) == s


RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choices("aeioulnrst", k=RNG.randint(2, 7))) for _ in range(600)]


def words(n):
    return RNG.choices(VOCABULARY, k=n)


def corpus():
    items = [(i, " ".join(words(40))) for i in range(12)] + [(50, "one two Three"), (51, None), (52, " "), (None, " ".join(words(30)))]
    docs, leaks = [], set()
    for d in range(80):
        body = words(RNG.randint(5, 200))
        if d % 4 == 0:
            i, text = items[d // 4 % 12]
            own = text.upper().split() if d % 8 else text.split()
            for _ in range(RNG.choice([0, 2, 5])):  # edits
                k = RNG.randrange(len(own))
                own[k : k + 1] = RNG.choice([[], ["edited"], [own[k], "more"]])
            at = RNG.randint(0, len(body))
            body[at:at] = own
            leaks.add((d, i))
        if d % 4 == 1:  # a quotation is no leak
            body += items[d % 12][1].split()[:9]
        docs.append((d, "\n".join([" ".join(body[:9]), " ".join(body[9:])])))
    docs += [(200, "x ONE  two\nthree y"), (201, None), (202, ""), (None, items[0][1]), (203, "q " * 50_000 + items[15][1])]
    leaks |= {(200, 50), (None, 0), (203, None)}
    return docs, items, leaks


def test_finds_copies_and_edited_copies_and_nothing_else(spark):
    docs, items, leaks = corpus()
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string")
    items = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    got = contaminated(docs, items).collect()
    assert {(r.id, r.item) for r in got} == leaks and len(got) == len(leaks)
    span = {(r.id, r.item): (r.score, r.first_word, r.last_word) for r in got}
    assert span[200, 50] == (1.0, 1, 3) and span[None, 0] == (1.0, 0, 39) and span[203, None] == (1.0, 50_000, 50_029)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({i for i, _ in leaks})


def test_edited_copies_of_a_large_group_and_of_a_small_table(spark):
    item = words(40)
    edited = list(item)
    for k in (4, 9, 18, 23, 32):  # under half of the 5-grams stay
        edited[k] = "edited"
    leak = " ".join(words(20) + edited + words(20))
    rows = [(d, " ".join(words(60))) for d in range(40)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for n, more in ((1, 0), (15, 0), (15, 1)):  # a verbatim copy elsewhere does not change it
        docs = rows + [(100 + i, leak) for i in range(n)] + [(200 + i, " ".join(item)) for i in range(more)]
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
        assert {r.id for r in got} == {d for d, _ in docs[40:]}


def test_a_full_filter_only_costs_time(spark):
    docs, items, leaks = corpus()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item) for r in contaminated(docs, items, filter_bits=13).collect()} == leaks


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == 1
    assert contaminated(docs, items).count() == 1


def test_verbatim_items_of_the_benchmark(spark):
    d = "/root/testdata/sf0.01"
    squeeze = lambda t: f" {' '.join(t.lower().split())} "
    docs = {r.doc_id: squeeze(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: squeeze(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    verbatim = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r.score for r in op6_decontaminate(spark, d).collect()}
    assert {k for k, s in got.items() if s == 1} == verbatim and set(got) >= verbatim


def edited(own, kind, every):
    """``own`` with an edit at every ``every``-th word."""
    out = []
    for k, w in enumerate(own):
        hit = k % every == every - 1
        if kind == "other":
            out += ["zz"] if hit else [w]
        elif kind == "more":
            out += [w, f"y{k}"] if hit else [w]
        elif kind == "less":
            out += [] if hit else [w]
        else:
            out += RNG.choice([["zz"], [w, "zz"], []]) if hit else [w]
    return out


@pytest.mark.parametrize("threshold", [SCORE, 0.8])
def test_equals_the_alignment_of_all_pairs(spark, threshold):
    items = [(i, words(n)) for i, n in enumerate([1, 2, 3, 5, 8, 10, 11, 12, 15, 16, 21, 30, 40, 40, 59])]
    docs = []
    for _, item in items:
        for kind in ("other", "more", "less", "any"):
            for every in (1, 2, 3, 4, 5, 6, 9):
                if kind != "less" or every > 1:
                    docs.append(words(RNG.randint(0, 30)) + edited(item, kind, every) + words(RNG.randint(0, 30)))
    numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for x in [*docs, *(i for _, i in items)] for w in x))}
    pad = lambda rows: np.array([np.r_[r, np.zeros(max(map(len, rows)) - len(r))] for r in rows], np.int64)
    texts = [[numbers[w] for w in d] for d in docs]
    expected = {}
    for i, item in items:  # align() itself is held against dynamic programming above
        own = pad([[numbers[w] for w in item]] * len(texts))
        best, _ = align(own, np.full(len(texts), len(item)), pad(texts), np.array(list(map(len, texts))))
        expected |= {(d, i): s / (2 * len(item)) for d, s in enumerate(best.tolist()) if s / (2 * len(item)) >= threshold}
    rows = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = {(r.id, r.item): r.score for r in contaminated(rows, bench, threshold=threshold).collect()}
    assert got == expected and min(expected.values()) < threshold + 0.05


def test_what_a_copy_must_keep():
    assert [seed_rule(m, 0.6) for m in (1, 2, 3, 10, 11, 40)] == [(1, 1), (2, 1), (2, 1), (2, 5), (3, 1), (3, 6)]
    assert seed_rule(40, 1.0) == (3, 38)


def test_a_stock_phrase_of_many_texts_and_items_aligns_nothing(spark):
    phrase = "choose the best answer from these".split()
    long_tail = lambda d, n: [f"w{d}x{k}" for k in range(n)]
    items = spark.createDataFrame([(i, " ".join(phrase + long_tail(f"i{i}", 34))) for i in range(200)], "item_id long, text string")
    leak = " ".join(phrase + long_tail("i7", 34))  # held by a third of all documents
    docs = [(d, " ".join(long_tail(f"d{d}", 20) + phrase + long_tail(f"e{d}", 20))) for d in range(500)] + [(1000 + d, f"before {leak} after") for d in range(250)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    contents = benchmark_items(items.select(F.col("item_id").alias("item"), "text")).select("key", "words")
    assert candidate_pairs(with_location(docs.withColumnRenamed("doc_id", "id")), "text", contents).count() == 250
    assert {(r.id, r.item) for r in contaminated(docs, items).collect()} == {(1000 + d, 7) for d in range(250)}


def test_an_item_of_several_ids_and_an_id_of_several_items(spark):
    a, b = " ".join(words(20)), " ".join(words(25))
    items = spark.createDataFrame([(1, a), (2, a), (2, a.upper()), (3, a), (3, b)], "item_id long, text string")
    docs = spark.createDataFrame([(9, f"x {a} y"), (9, f"x {a} y"), (10, f"{b} {a}")], "doc_id long, text string")
    got = sorted((r.id, r.item, r.first_word) for r in contaminated(docs, items).collect())
    assert got == [(9, 1, 1), (9, 1, 1), (9, 2, 1), (9, 2, 1), (9, 3, 1), (9, 3, 1), (10, 1, 25), (10, 2, 25), (10, 3, 0)]
