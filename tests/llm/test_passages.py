import random

import numpy as np
import pytest

from dunning.llm import passages
from dunning.llm.common import gram_hashes, splitmix
from dunning.llm.passages import best_stretch, common_run, compact_windows, overlaps, passage_classes, shared_passages, sliding_least


@pytest.mark.parametrize("t", [1, 2, 3, 7, 8, 46])
def test_sliding_least(t):
    v = np.random.default_rng(t).integers(0, 99, 200).astype(np.uint64)
    assert sliding_least(v, t).tolist() == [v[i : i + t].min() for i in range(len(v) - t + 1)]


@pytest.mark.parametrize("least", [1, 3, 9])
def test_compact_windows_hold_every_stretch_once(least):
    rng = np.random.default_rng(least)
    text = np.repeat(np.arange(6), [0, 1, 30, 8, 2, 25][:6])
    tokens = splitmix(rng.integers(0, 12, len(text)).astype(np.uint64))  # with repeats
    owner, value, l, c, r = compact_windows(tokens, text, least, 1)  # noqa: E741
    held = {}
    for o, lo, at, hi, v in zip(owner, l, c, r, value, strict=True):
        assert set(text[lo : hi + 1]) == {o}
        for i in range(lo, at + 1):
            for j in range(at, hi + 1):
                if j - i + 1 >= least:
                    assert (i, j) not in held
                    held[i, j] = v
    hashed = splitmix(tokens ^ np.uint64(0xA0761D6478BD642F * 3 % (1 << 64)))
    wanted = {(i, j): hashed[i : j + 1].min() for i in range(len(text)) for j in range(i + least - 1, len(text)) if text[i] == text[j]}
    assert held == wanted


def test_every_passage_has_a_run_in_common():
    assert common_run(46, 0.8) == 21
    rng = np.random.default_rng(8)
    shortest = 999
    for _ in range(3000):
        a = rng.integers(0, 1 << 40, 120).tolist()
        b = list(a)
        for _ in range(rng.integers(1, 5)):
            at = rng.integers(0, len(b))
            b[at : at + rng.integers(0, 3)] = rng.integers(0, 1 << 40, rng.integers(0, 3)).tolist()
        x, y = (gram_hashes(np.array(t, np.uint64), 5) for t in (a, b))
        lo = rng.integers(0, 60)
        x = x[lo : lo + rng.integers(46, 70)]
        if shared_passages(x, y, 46, 0.8):
            ours = set(zip(*(y[i : len(y) - 20 + i].tolist() for i in range(21)), strict=True))
            runs = [k for k in range(len(x) - 20) if tuple(x[k : k + 21].tolist()) in ours]
            shortest = min(shortest, len(runs))
    assert 1 <= shortest < 999


def test_overlaps_need_enough_functions():
    row = lambda f, c, shift=0: [f, c, c - 30, c + 30, c + shift, c + shift - 30, c + shift + 30]
    assert overlaps([row(0, 50, 7)], 46, 2) == []
    assert overlaps([row(0, 50, 7), row(0, 55, 7)], 46, 2) == []
    assert overlaps([row(0, 50, 7), row(1, 55, 7)], 46, 2) == [(25, 80, 32, 87)]
    assert overlaps([row(0, 50), row(1, 500)], 46, 2) == []


def test_shared_passages_of_shingles():
    a = np.arange(200, dtype=np.uint64)
    b = np.concatenate([np.arange(1000, 1030), np.arange(50, 110), np.arange(2000, 2050)]).astype(np.uint64)
    assert shared_passages(a, b, 46, 0.8) == [(50, 110, 30, 90, 1.0)]
    b[60] = 77777  # one shingle differs
    (got,) = shared_passages(a, b, 46, 0.8)
    assert got[:4] == (50, 110, 30, 90) and 0.9 < got[4] < 1
    assert shared_passages(a, b[:70], 46, 0.8) == []


def test_shared_passages_inside_a_looser_chain():
    a = np.arange(56, dtype=np.uint64)
    b = a.copy()
    b[25:30] += 1000  # one edited word: 51 of 56
    (alone,) = shared_passages(a, b, 46, 0.8)
    assert alone[:4] == (0, 56, 0, 56)
    pad = lambda n, at: np.arange(at, at + n, dtype=np.uint64)
    stray = np.array([9], np.uint64)
    for back in (False, True):  # one shingle in common, 12 places after and before
        a2, b2 = np.r_[a, pad(11, 2000), stray + np.uint64(8000)], np.r_[b, pad(11, 3000), stray + np.uint64(8000)]
        if back:
            a2, b2 = a2[::-1], b2[::-1]
        (got,) = shared_passages(a2, b2, 46, 0.8)
        assert got == ((12, 68, 12, 68, alone[4]) if back else alone)


@pytest.mark.parametrize("swaps", [False, True])
def test_best_stretch_equals_all_stretches(swaps):
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(5, 60))
        x = np.cumsum(rng.choice([1, 1, 1, 1, 2, 4], n))
        y = np.cumsum(rng.choice([1, 1, 1, 1, 2, 3], n))
        if swaps:
            k = rng.integers(0, n - 1, 3)
            y[k] = y[k + 1] + rng.integers(0, 2, 3)
        widest = 0
        for i in range(n):
            for j in range(i, n):
                na, nb, m = x[j] - x[i] + 1, np.ptp(y[i : j + 1]) + 1, len(set(y[i : j + 1].tolist()))
                if na >= 8 and nb >= 8 and m / (na + nb - m) >= 0.8:
                    widest = max(widest, na)
        got = best_stretch(x, y, 8, 0.8)
        assert (x[got[1] - 1] - x[got[0]] + 1 if got else 0) == widest


RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 8))) for _ in range(3000)]


def words(n):
    return RNG.choices(VOCABULARY, k=n)


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    passages = [words(n) for n in (51, 60, 75, 120)]
    common = words(9)  # a line of many documents, no passage
    rows, classes = [], {}
    for d in range(120):
        body = words(RNG.randint(20, 300))
        if d % 3 == 0:
            at = RNG.randint(0, len(body))
            body[at:at] = common
        if d % 2 == 0 and d < 100:
            p = d // 2 % 4
            own = list(passages[p])
            if d % 10 == 0 and len(own) > 100:
                own[40] = "edited"
            at = RNG.randint(0, len(body))
            body[at:at] = own
            classes[d] = p
        rows.append((d, " ".join(body), "x"))
    copy = " ".join(words(80))
    rows += [(200, copy, "x"), (201, copy.upper(), "x"), (201, copy.replace(" ", "\n"), "x"), (202, "short text", "x"), (203, "short text", "x")]
    rows += [(204, None, "x"), (205, "", "x"), (None, " ".join(words(60) + passages[0]), "x"), (206, " ".join(words(30_000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(5)
    got = passage_classes(docs).collect()
    found = {r.id: r.class_id for r in got}
    least = {p: min(d for d, q in classes.items() if q == p) for p in range(4)}
    assert found == {d: least[p] for d, p in classes.items()} | {200: 200, 201: 200, None: least[0]}
    at = {r.id: (r.first_word, r.last_word, r.n_links) for r in got}
    for d, p in classes.items():
        text = rows[d][1].split()
        lo, hi, n = at[d]
        assert n > 0 and hi - lo + 1 >= 50
        start = next(i for i in range(len(text)) if text[i : i + 9] == passages[p][:9])
        assert abs(lo - start) <= 1 and abs(hi - (start + len(passages[p]) - 1)) <= 1
    assert at[200] == (0, 79, 0)


def test_empty_table(spark):
    assert passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_of_most_documents(spark):
    hot = words(70)
    rows = [(d, " ".join(words(RNG.randint(5, 60)) + hot + words(RNG.randint(5, 60)))) for d in range(300)]
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {(r.id, r.class_id) for r in got} == {(d, 0) for d in range(300)}


def test_texts_that_share_single_lines_keep_no_pair_apart(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for p in range(25):
        lines = [words(12) for _ in range(5)]
        for d in (2 * p, 2 * p + 1):
            rows.append((d, " ".join(words(rng.randint(5, 40)) + sum(lines, []) + words(rng.randint(5, 40)))))
            wanted[d] = 2 * p
        for line in lines:  # each line also stands in many other texts, which share nothing else
            rows += [(1000 + len(rows) + i, " ".join(words(30) + line + words(30))) for i in range(40)]
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.id: r.class_id for r in got} == wanted
    assert all(r.n_links == 1 for r in got)


@pytest.mark.parametrize("others", [0, 20, 100])
def test_edited_passages_are_found_whatever_other_texts_hold(spark, others):
    rng = random.Random(others)
    rows, wanted = [], {}
    for p in range(20):
        lines = [words(12) for _ in range(5)]
        for d in (2 * p, 2 * p + 1):
            own = sum(lines, [])
            if d % 2:
                own[rng.randint(20, 40)] = "edited"
            rows.append((d, " ".join(words(rng.randint(5, 40)) + own + words(rng.randint(5, 40)))))
            wanted[d] = 2 * p
        for line in lines:  # each line also stands in other texts, which share nothing else
            rows += [(1000 + len(rows) + i, " ".join(words(30) + line + words(30))) for i in range(others)]
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.id: r.class_id for r in got} == wanted


def test_versions_that_share_a_long_line_only(spark):
    # a line of 30 words in all texts, each pair of texts has its own words around it
    line = words(30)
    rows, wanted = [], {}
    for p in range(15):
        before, after = words(20), words(20)
        for d in (p, 100 + p):
            rows.append((d, " ".join(words(30) + before + line + after + words(30))))
            wanted[d] = p
        rows[-1] = (rows[-1][0], rows[-1][1].replace(" ".join(after[:2]), "edited " + after[1]))
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.id: r.class_id for r in got} == wanted


def test_found_classes_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    base = [words(rng.randint(50, 90)) for _ in range(6)]
    texts = []
    for _ in range(90):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 2)] = words(rng.randint(0, 2))
        lo = rng.randint(0, 20)
        texts.append(words(rng.randint(0, 30)) + own[lo:] + words(rng.randint(0, 30)))
    grams = [gram_hashes(np.array([hash(w) & (1 << 62) - 1 for w in t], np.uint64), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if shared_passages(grams[i], grams[j], 46, 0.8):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.id: r.class_id for r in got} == {d: r for d, r in enumerate(root) if root.count(r) > 1}


def test_runs_of_one_word(spark):
    # in all texts one word stands 30 times in a row; pairs go on with the same words after an edit at its end
    rows, wanted = [], {}
    for p in range(12):
        after = words(20 + p % 3 * 20)
        for d in (p, 100 + p):
            rows.append((d, " ".join(words(20) + ["so"] * 30 + [f"e{d}"] + after + words(20))))
            wanted[d] = p
    rows += [(200 + d, " ".join(words(20) + ["so"] * (48 + d) + words(20))) for d in range(6)]  # 50 words from the third on
    wanted |= {200 + d: 202 for d in range(2, 6)}
    got = passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.id: r.class_id for r in got} == wanted


def test_texts_with_a_short_line_in_common_are_not_paired(spark, monkeypatch):
    made = {}
    plain = passages.stage
    monkeypatch.setattr(passages, "stage", lambda df, name: made.setdefault(name, plain(df, name)))
    line = words(20)  # 25 words in a row are the least that texts with a passage share
    rows = [(d, " ".join(words(30) + line + words(30))) for d in range(60)]
    assert passage_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == 0
    assert made["pairs-across"].count() == 0
