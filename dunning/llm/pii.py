"""Personal data in texts, with DataFrame functions only (operator 1).

Regular expressions propose spans, checksums and counts confirm them (Luhn for
cards, mod 97 for IBANs, ranges for addresses, digits for phones), and context
words beside a span raise its score.  Kinds that are ambiguous without context
count only from a score on.

Patterns are written so that they scan in linear time: a match may only begin
where a run of its characters begins, or where the match before ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, read_table

#: Characters on each side of a span that are searched for context words.
NEAR = 40
#: Matches that one step of the running total takes together.
STEP = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether a card number's check digit holds."""

    def weight(d: Column) -> Column:
        value = lambda i: F.substring(d, i + 1, F.lit(1)).cast("int")
        doubled = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
        return F.aggregate(
            F.sequence(F.lit(0), F.length(d) - 1),
            F.lit(0),
            lambda total, i: total + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)),
        )

    return let(F.reverse(digits_of(match)), weight) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's check digits hold; letters count from A = 10."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def rest(s: Column) -> Column:
        code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(s)),
            F.lit(0),
            lambda total, i: F.when(code(i) < 58, total * 10 + code(i) - 48).otherwise(total * 100 + code(i) - 55) % 97,
        )

    return F.length(plain).between(15, 34) & (let(turned, rest) == 1)


def parts_to_255(match: Column) -> Column:
    return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float  # without context
    context: str  # words beside a span that add CONTEXT
    least: float = 0.0  # score from which a span counts


CONTEXT = 0.4

#: Always reported, whatever their score.
BASE = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        0.6,
        "mail|contact|write|reach",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", parts_to_255, 0.5, "ip|address|host|server|login"),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        luhn,
        0.6,
        "card|visa|mastercard|amex|credit|debit|payment",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits_of(m)).between(8, 15), 0.5, "phone|tel|call|mobile|fax"),
)

#: Reported besides.
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        mod97,
        0.6,
        "iban|bank|account|transfer",
        0.5,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security", 0.5),
)


def running_total(steps: Column) -> Column:
    """Sums of the first 1, 2, ... numbers.  An array grows by copying, so it is
    made in stretches of STEP and joined."""
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    grown = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.array_append(acc["sums"], acc["total"] + x).alias("sums"))
    stretch = lambda s: lambda b: F.aggregate(F.slice(s, b * STEP + 1, F.lit(STEP)), empty, grown)
    runs = let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STEP).cast("int")), stretch(s)))

    def joined(r: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(r, F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x["total"])
        return F.flatten(F.transform(r, lambda run, i: let(before(i), lambda base: F.transform(run["sums"], lambda x: x + base))))

    return let(runs, joined)


SPAN = "struct<kind:string,start:bigint,stop:bigint,score:double>"


def spans(text: Column, kind: Kind) -> Column:
    """The kind's spans in order: kind, start, stop (code points, end
    exclusive) and score.  Leftmost, non-overlapping; a match that is not
    confirmed is dropped."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("between")
    )

    def located(s: Column) -> Column:
        found, between = s["found"], s["between"]
        steps = F.transform(
            found, lambda m, i: (F.char_length(F.get(between, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0)).cast("long")
        )
        beside = lambda i: F.concat(F.right(F.get(between, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(between, i + 1), F.lit(NEAR)))
        near = lambda i: F.when(beside(i).rlike(rf"(?i)\b(?:{kind.context})"), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        return let(
            running_total(steps),
            lambda starts: F.transform(
                found,
                lambda m, i: F.struct(
                    m.alias("match"), F.get(starts, i).alias("start"), (F.lit(kind.score) + near(i)).alias("score")
                ),
            ),
        )

    good = F.filter(let(parts, located), lambda x: kind.confirmed(x["match"]) & (x["score"] >= kind.least))
    shaped = F.transform(
        good,
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["match"])).alias("stop"), x["score"].alias("score")
        ),
    )
    return F.when(text.rlike(kind.pattern), shaped).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(found: Column, *, score: bool = False) -> Column:
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"], *([F.format_number(x["score"], 2)] if score else []))
    return F.array_join(F.transform(found, one), ",")


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", base=BASE, more=MORE) -> DataFrame:
    """One row for each row of ``docs``: doc_id and, for each kind, an array of
    its spans named after the kind.  Null is the empty text; a text without
    personal data has empty arrays; repeated rows are rows of their own; an
    empty table gives no rows.  Patterns match by iteration, so texts and
    matches may have any length."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", *[spans(F.col("text"), k).alias(k.name) for k in (*base, *more)])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    first, every = [k.name for k in BASE], [k.name for k in (*BASE, *MORE)]
    return find_pii(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in first],
        F.sha2(listed(F.concat(*first)).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(*every)).alias("spans"),
        listed(F.concat(*every), score=True).alias("scored_spans"),
    )
