import hashlib
import re

from dunning.llm.pii import find_pii, op1_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ok(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute(text, without=()):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m[0])] for k, p in PATTERNS.items() if k not in without}


TRICKY = [
    "a.b@c.de, x@y, x@y.z@q.r.s @a.b a@b.c%d@e.f..g %+-@a-b.c-d.e é@é.é ü😀me@x.yz",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2..3.4.5.6 99999999999999.1.2.3.4 .1.2.3.4.",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 41111111111111111111, 5 4111111111111111, 4111  1111 1111 1111 6011000990139424000",
    "+1 (555) 123-4567 +1-2 +44.20.7946.0958 ++1234567890+49123456789 +1 555 1234 567 8901 23456 +1(((((((9",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not GB82 WEST 1234 5698 7654 33",
    "my ssn is 123-45-6789, part 123-45-6789 of a list that has nothing else beside it at all, no words near",
    "",
    None,
    "0" * 20_000 + " " + "1." * 20_000 + "a" * 50_000 + "@" * 3 + "+1" * 9_000,
    "😀" * 3000 + " a@b.cd " * 1500,
]


def test_base_spans_equal_leftmost_matches(spark):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(None, "me@x.yz", "x"), (0, TRICKY[0], "x")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string, email string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "me@x.yz" if r.doc_id is None else TRICKY[r.doc_id]
        for kind, spans in brute(text).items():
            assert [(s.start, s.stop) for s in r[kind]] == spans, (r.doc_id, kind)
    by = {r.doc_id: r for r in got}
    cut = lambda i, kind: [TRICKY[i][s.start : s.stop] for s in by[i][kind]]
    assert cut(4, "iban") == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    assert [s.start for s in by[5].ssn] == [10]
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_its_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans = brute(d.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, s in spans.items() for a, b in s)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans.values()]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)


LONG = [
    "a@b" + ".c" * 100_000,
    "a" * 100_000 + "@" + "b" * 100_000 + ".c-d" * 50_000 + ".",
    "1.2.3.4." * 50_000,
    "+1" + " 2" * 100_000,
    "+1" + "(" * 100_000,
    "4111 1111 1111 1111 " * 20_000,
    "GB82 WEST " * 50_000 + "1234",
    "123-45-6789 " * 30_000,
    "@." * 100_000,
]


def test_long_runs_of_every_kind(spark):
    """Patterns iterate: no match recurses once for each part."""
    rows = list(enumerate(LONG))
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        for kind, spans in brute(text, ["email"] if "@" not in text else []).items():
            assert [(s.start, s.stop) for s in got[i][kind]] == spans, (i, kind)
        assert "@" in text or not got[i].email
