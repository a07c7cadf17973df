import re

from dunning.llm.licenses import NOTICES, PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check(spark, rows):
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *base(t)) for i, t, _ in rows), key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    return got


def test_base_phrases_and_edge_rows(spark):
    rows = [
        (1, "Released under the MIT License. Apache-License, version 2.0; CC BY-NC 4.0"),
        (2, "under the mit license " * 3000),
        (2, "under the mit license " * 3000),
        (3, "under the mit-license\nunder the\x7fMIT licenseé under the mit License"),
        (4, None),
        (None, ""),
        (5, "cc by nc cc by cc by nc"),
        (6, "ccby nc ünder the mit license"),
        (7, "under the"),
    ]
    check(spark, [(i, t, "x") for i, t in rows])
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices_whole_and_edited(spark):
    filler = "some words that come before and after " * 5
    rows = [(i, filler + text + " " + filler, "x") for i, (_, text) in enumerate(NOTICES)]
    edited = NOTICES[0][1].split()
    del edited[7]
    edited.insert(15, "kindly")
    rows += [(100, filler + " ".join(edited) + filler, "x"), (101, filler + " ".join(NOTICES[0][1].split()[:8]), "x"), (102, filler, "x")]
    got = {r.id: r for r in check(spark, rows)}
    for i, (label, _) in enumerate(NOTICES):
        assert label in got[i].labels.split(",")
    assert got[100].labels == "mit" and got[101].labels == "" and 0 < got[101].score < 0.5 and got[102].score == 0
    assert got[0].spans[0].lo == 35


def test_notices_that_repeat_keep_their_label(spark):
    notice = "all rights reserved"
    assert any(notice == text.lower() for _, text in NOTICES)
    rows = [(n, " ".join([notice] * n), "") for n in range(1, 12)] + [(20, (notice + ". ") * 500, ""), (21, "some words " + (notice + " by us ") * 9, "")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert {r.labels for r in got} == {"all-rights-reserved"} and {r.score for r in got} == {1.0}
    assert {r.id: len(r.spans) for r in got}[20] == 500
