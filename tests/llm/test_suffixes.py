"""Repeated byte strings against counting every string of the length."""

from collections import Counter

import numpy as np
import pytest

from dunning.llm.suffixes import gram_names, op13_repeats, repeated_windows, samples, without_repeats

SCHEMA = "doc_id long, text string, spans string, kept int, part binary"


def brute_force(texts, length):
    """(bytes, runs, rest) of each text."""
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                hit[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        runs = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((len(t), runs, bytes(b for b, x in zip(t, hit[1:], strict=False) if not x)))
    return out


def check(spark, texts, length, **options):
    """Every text, with clashing extra columns; ids repeat and are null."""
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", i, b"p") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = without_repeats(docs, length=length, **options).collect()
    want = brute_force([(t or "").encode() for t in texts], length)
    assert {r.doc.kept: (r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got} == dict(enumerate(want))
    assert len(got) == len(texts)
    assert all(r.doc.spans == "x" and r.doc.doc_id == (r.doc.kept if r.doc.kept % 5 else None) for r in got)


def mixture(seed, n=120):
    """Texts that share passages, with edits, copies and runs of one letter."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdéß "))
    say = lambda k: "".join(rng.choice(letters, k))
    passages = [say(int(k)) for k in rng.integers(20, 150, 6)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.integers(0, 5)):
            p = passages[rng.integers(6)]
            cut = int(rng.integers(len(p)))
            t += rng.choice([p, p[cut:], p[:cut], p[:cut] + "X" + p[cut:], say(int(rng.integers(1, 80))), "a" * int(rng.integers(90)), "ab" * 30])
        texts.append(t)
    return texts + texts[:5] + [None, "", "a"]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"heavy": 4, "part_bytes": 3000})])
def test_every_repeated_byte_goes(spark, seed, options):
    check(spark, mixture(seed), 48, gram=16, **options)


def test_hot_passage_in_many_contexts(spark):
    """Split buckets: a passage that every text holds, each between its own words."""
    rng = np.random.default_rng(5)
    hot = "".join(rng.choice(list("abcdefgh"), 60))
    texts = ["".join(rng.choice(list("ab"), 30)) + hot + "".join(rng.choice(list("ab"), 30)) for _ in range(150)]
    check(spark, texts, 40, gram=8, heavy=8)


def test_production_lengths(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), k)) for k in rng.integers(2, 9, 300)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = [say(60) for _ in range(5)]
    texts = []
    for i in range(80):
        p = shared[i % 5]
        texts.append(say(20) + " " + (p if i % 3 else p.replace(words[3], "edit", 1)) + " " + say(30))
    texts += ["-" * 1500, "=" * 199, "=" * 200, "x" + shared[0] + "y" + shared[0], texts[0]]
    check(spark, texts, 200, heavy=5)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text_and_only_a_text_column(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghijklmnop"), 300_000))
    texts = [long * 16, long[1000:1300] + "!" * 20, "plain " * 20]  # over one segment of samples
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.n_bytes: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in without_repeats(docs).collect()}
    assert got[4_800_000] == (b"", [(0, 4_800_000)])
    assert got[320] == (b"!" * 20, [(0, 300)])
    assert got[120] == (b"plain " * 20, [])


def test_samples_are_the_same_wherever_a_window_stands():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 101, n, dtype=np.uint8) for n in (700, 900))
    b[300:650] = a[200:550]
    found = []
    for raw, lo in ((a, 200), (b, 300)):
        row, sample, first, count, name = samples(raw, np.array([0, len(raw)]), 100, 16)
        assert count.sum() == len(raw) - 99 and (np.concatenate(([0], np.cumsum(count)[:-1])) == first).all()
        assert ((sample >= first + count - 1) & (sample + 16 <= first + 100)).all()
        of = {w: (s - w, n) for s, f, c, n in zip(sample, first, count, name, strict=True) for w in range(f, f + c)}
        found.append([of[w] for w in range(lo, lo + 251)])
    assert found[0] == found[1]


def test_names_are_of_whole_grams():
    raw = np.frombuffer(b"abcdefghijklmnopabcdefghijklmnopq", np.uint8)
    names = gram_names(raw, 16)
    assert len(names) == 18 and names[0] == names[16] and len(set(names.tolist())) == 17


def test_pointers_compare_bytes():
    spans = [b"ab" * 30, b"ab" * 29 + b"aX", b"ab" * 30]
    raw, at = np.frombuffer(b"".join(spans), np.uint8), np.array([0, 60, 120, 180])
    span, window, hit = repeated_windows(np.array([0, 0, 1]), np.array([20, 20, 20]), raw, at, 50)
    assert (hit == ((span < 2) & (window < 10))).all()


def test_query_returns_every_document(spark, tmp_path):
    texts = mixture(4, 30) + ["Z" * 250]
    spark.createDataFrame([(i, t, "s", 1, b"") for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in op13_repeats(spark, str(tmp_path)).collect())
    want = brute_force([(t or "").encode() for t in texts], 200)
    assert got == [(i, n, sum(b - a for a, b in runs), len(runs)) for i, (n, runs, _) in enumerate(want)]
