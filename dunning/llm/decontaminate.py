"""Benchmark decontamination (operator 6).

1. Seeds are two or three words in order with at most one word between
   neighbours, on either side: what an alignment that reaches the threshold must
   keep, whatever was replaced, left out or put in (`seed_rule`).
2. Every seed of every document is looked up in a table of fixed size that
   holds, for the benchmark's seeds, how many of them a copy must keep.  Hits
   with too few others near them go.  What stays becomes a *passage*: the words
   around neighbouring hits, with the hits.
3. The most frequent seeds of each item are left out; the rare ones join
   passages to items, and pairs with too few of them go.
4. Pairs whose words in common cannot reach the threshold are left out.
5. Smith-Waterman aligns item and passage word by word, so edited, shortened
   and paraphrased copies get a score between 0 and 1.

Each step keeps every pair that reaches the threshold.
"""

from __future__ import annotations

from itertools import accumulate, product
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    BLANKS,
    bitmap_of,
    by_value,
    byte_classes,
    column,
    pieces,
    read_table,
    signed,
    splitmix,
    stage,
    text_bytes,
    unwrapped,
    with_location,
    word_hashes,
)

by_value(__name__)

#: Slots of the table of benchmark seeds, as a power of two (a byte each, 4 MB).
#: Fixed: a larger benchmark passes more seeds to the join, and results stay the same.
FILTER_BITS = 22
#: Alignment: a match, another word, a word more or less.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
SCORE = 0.6
#: Bytes of text whose seeds are looked up at once; the arrays take several times as much.
MOST_BYTES = 512 << 10
_TABLE = byte_classes(BLANKS)


# --- seeds --------------------------------------------------------------------


def seed_rule(words: int, threshold: float) -> tuple[int, int]:
    """(size, need): an alignment that reaches ``threshold`` of an item of
    ``words`` words holds, from ``need`` places of the item on, ``size``
    matches in a row with at most one word between neighbours on either side.

    With m matches it can pay for m - threshold * words steps of two or more
    words between neighbouring matches, and each of them spoils at most
    size - 1 of the m - size + 1 rows of matches.
    """
    for size in (3, 2, 1):
        need = min(
            m - size + 1 - (size - 1) * floor(m - threshold * words + 1e-9) for m in range(max(1, ceil(threshold * words - 1e-9)), words + 1)
        )
        if need >= 1:
            break
    return size, max(need, 1)


def seed_hashes(words: np.ndarray, size: int):
    """For each pattern of ``size`` words its length and the hash at each place."""
    mixed = [splitmix(words + np.uint64((0xD1342543DE82EF95 * (j + 1)) % (1 << 64))) for j in range(size)]
    for steps in product((1, 2), repeat=size - 1):
        at = list(accumulate(steps, initial=0))
        n = len(words) - at[-1]
        if n > 0:
            out = np.zeros(n, np.uint64)
            for x, o in zip(mixed, at, strict=True):
                out += x[o : o + n]
            yield at[-1] + 1, splitmix(out)


def benchmark_items(items: DataFrame) -> DataFrame:
    """item, key (of the words), words (hashes); items without words are left out."""

    def run(batches):
        for piece in pieces(batches, "text"):
            raw, at = text_bytes(piece.column(1))
            _, _, row, h = word_hashes(raw, at, _TABLE)
            begin = np.searchsorted(row, np.arange(len(at)))
            words = [h[begin[r] : begin[r + 1]] for r in range(len(at) - 1)]
            keep = [r for r, w in enumerate(words) if len(w)]
            within = [splitmix(w + splitmix(np.arange(len(w), dtype=np.uint64))).sum(dtype=np.uint64) for w in words]
            keys = splitmix(np.array([within[r] + np.uint64(len(words[r])) for r in keep], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(keep, pa.int64())), pa.array(signed(keys)), pa.array([signed(words[r]) for r in keep], pa.list_(pa.int64()))],
                ["item", "key", "words"],
            )

    kind = items.schema["item"].dataType.simpleString()
    return items.select("item", "text").mapInArrow(run, f"item {kind}, key long, words array<long>")


def item_seeds(contents: DataFrame, threshold: float) -> DataFrame:
    """key, size, need, place, gram for each seed of the distinct items (key, words)."""

    def run(batches):
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = np.asarray(words.values, np.int64).view(np.uint64)
                size, need = seed_rule(len(w), threshold)
                for _, g in seed_hashes(w, size):
                    n = len(g)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, need, np.int32)),
                         pa.array(np.arange(n, dtype=np.int32)), pa.array(signed(g))],
                        ["key", "size", "need", "place", "gram"],
                    )

    return contents.select("key", "words").mapInArrow(run, "key long, size int, need int, place int, gram long")


def table_of_needs(seeds: DataFrame, bits: int) -> bytes:
    """For each slot the least need of the seeds that fall into it, 0 without
    one: what reaches the driver is at most the table itself."""
    low = 12
    parts = (
        seeds.groupBy(F.shiftrightunsigned("gram", 64 - bits).alias("slot"))
        .agg(F.least(F.min("need"), F.lit(255)).alias("need"))
        .groupBy(F.shiftright("slot", low).alias("page"))
        .agg(F.collect_list(F.struct(F.col("slot").bitwiseAND((1 << low) - 1).cast("int").alias("slot"), "need")).alias("slots"))
    )
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.toLocalIterator():
        for slot, need in r.slots:
            out[(r.page << low) + slot] = need
    return out.tobytes()


def enough_near(place: np.ndarray, need: np.ndarray, reach: int) -> np.ndarray:
    """Which hits have hits at ``need`` places, their own included, within
    ``reach``; hits that go do not count for the others.  ``place`` ascends."""
    keep = np.ones(len(place), bool)
    while True:
        once = np.unique(place[keep])
        near = np.searchsorted(once, place + reach, "right") - np.searchsorted(once, place - reach, "left")
        left = keep & (near >= need)
        if left.sum() == keep.sum():
            return keep
        keep = left


def bitmap_of_grams(grams: DataFrame, bits: int) -> bytes:
    """The bitmap of the distinct grams, put together by words of 2**12 bits:
    what reaches the driver is at most the bitmap itself."""
    low = 12
    parts = (
        grams.select(F.shiftrightunsigned("gram", 64 - bits).alias("bit"))
        .distinct()
        .groupBy(F.shiftright("bit", low).alias("page"))
        .agg(F.collect_list(F.col("bit").bitwiseAND((1 << low) - 1).cast("int")).alias("bits"))
    )
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in parts.toLocalIterator():
        b = np.array(r.bits, np.int64) + (r.page << low)
        np.bitwise_or.at(out, b >> 3, (1 << (b & 7)).astype(np.uint8))
    return out.tobytes()


def passages(located: DataFrame, text: str, sizes: list[int], reach: int, needs) -> DataFrame:
    """file, row, id, first (word), words (hashes), hits (place in words and
    gram) of every stretch of a document whose seeds are in the table ``needs``
    often enough, with up to ``reach`` words before and after.  ``sizes``: of
    the benchmark's seeds, in words."""
    narrow = located.select("file", "row", F.col("doc.id").alias("id"), F.col("doc")[text].cast("string").alias("text"))
    kept = ["file", "row", "id"]
    schema = T.StructType(
        [
            *narrow.select(*kept).schema.fields,
            T.StructField("first", T.LongType()),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("hits", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("gram", T.LongType())]))),
        ]
    )
    hit_type = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))

    def run(batches):
        table = np.frombuffer(needs.value, np.uint8)
        unused = np.uint64(65 - len(table).bit_length())
        for piece in pieces(batches, "text", MOST_BYTES):
            raw, at = text_bytes(piece.column(3))
            _, _, row, h = word_hashes(raw, at, _TABLE)
            where, grams, need = [], [], []
            for size in sizes:
                for span, g in seed_hashes(h, size):
                    n = table[(g >> unused).astype(np.int64)]
                    ok = np.flatnonzero((n > 0) & (row[: len(g)] == row[span - 1 :]))
                    where.append(ok)
                    grams.append(g[ok])
                    need.append(n[ok])
            if not sum(map(len, where)):
                continue
            where, grams, need = np.concatenate(where), np.concatenate(grams), np.concatenate(need)
            order = np.argsort(where, kind="stable")
            where, grams, need = where[order], grams[order], need[order]
            keep = enough_near(where + row[where] * (reach + 1), need, reach)
            where, grams = where[keep], grams[keep]
            if not len(where):
                continue
            new = np.r_[True, (np.diff(where) > reach) | (np.diff(row[where]) > 0)]
            starts = np.flatnonzero(new)
            stops = np.r_[starts[1:], len(where)]
            begin = np.searchsorted(row, np.arange(len(at)))  # first word of each row
            out = {"take": [], "first": [], "words": [], "hits": []}
            for s, e in zip(starts, stops, strict=True):
                r = int(row[where[s]])
                lo, hi = max(int(where[s]) - reach, int(begin[r])), min(int(where[e - 1]) + reach, int(begin[r + 1]))
                out["take"].append(r)
                out["first"].append(lo - int(begin[r]))
                out["words"].append(signed(h[lo:hi]))
                out["hits"].append([{"at": int(a) - lo, "gram": int(g)} for a, g in zip(where[s:e], signed(grams[s:e]), strict=True)])
            take = pa.array(out["take"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(j).take(take) for j in range(3)), pa.array(out["first"], pa.int64()), pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["hits"], hit_type)],
                [*kept, "first", "words", "hits"],
            )

    return narrow.mapInArrow(run, schema)


def align(items: np.ndarray, sizes: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman for a batch of padded word sequences: best score and the
    text place where it ends (exclusive)."""
    pairs, width = texts.shape
    h = np.zeros((pairs, width + 1), np.float32)
    best, end = np.zeros(pairs, np.float32), np.zeros(pairs, np.int64)
    slope = np.float32(GAP) * np.arange(width + 1, dtype=np.float32)
    valid = np.arange(width)[None, :] < lengths[:, None]
    for i in range(items.shape[1]):
        equal = (texts == items[:, i : i + 1]) & valid
        step = np.zeros_like(h)
        step[:, 1:] = np.maximum(h[:, :-1] + np.where(equal, np.float32(MATCH), np.float32(MISMATCH)), h[:, 1:] + np.float32(GAP))
        np.maximum(step, 0, out=step)
        # a gap along the text: the best of earlier places, less for each word between
        new = np.maximum.accumulate(step - slope, axis=1) + slope
        h = np.where((i < sizes)[:, None], new, h)
        row = np.where(valid & (i < sizes)[:, None], new[:, 1:], 0)
        top = row.argmax(axis=1)
        value = row[np.arange(pairs), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def scored(pairs: DataFrame, threshold: float, batch: int = 128) -> DataFrame:
    """Adds score, start and stop to rows with ``item_words`` and ``words``;
    keeps those that reach ``threshold``."""
    others = [c for c in pairs.columns if c not in ("item_words", "words", "first")]
    schema = (
        pairs.select(*others).withColumn("score", F.lit(0.0)).withColumn("first_word", F.lit(0).cast("long")).withColumn("last_word", F.lit(0).cast("long")).schema
    )

    def padded(rows):
        out = np.zeros((len(rows), max(map(len, rows))), np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                piece = big.slice(at, 4096)
                col = lambda name: piece.column(piece.schema.get_field_index(name))  # noqa: E731, B023
                items = [np.asarray(x.values, np.int64) for x in col("item_words")]
                texts = [np.asarray(x.values, np.int64) for x in col("words")]
                first = np.asarray(col("first"), np.int64)
                score, lo, hi = np.zeros(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
                order = np.lexsort([[len(x) for x in items], [len(x) for x in texts]])
                # an item's word scores at most one match: what lacks too many of them needs no alignment
                able = np.array([np.isin(a, b).sum() >= threshold * len(a) - 1e-6 for a, b in zip(items, texts, strict=True)], bool)
                order = order[able[order]]
                i = 0
                while i < len(order):
                    width = len(texts[order[min(i + batch, len(order)) - 1]])
                    some = order[i : i + max(1, min(batch, (1 << 20) // max(1, width)))]
                    i += len(some)
                    a, b = [items[j] for j in some], [texts[j] for j in some]
                    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
                    best, end = align(padded(a), na, padded(b), nb)
                    score[some] = best / (MATCH * na)
                    hi[some] = end
                    good = np.flatnonzero(score[some] >= threshold)
                    if len(good):  # where it begins: the same, read backwards from its end
                        back = [b[g][: end[g]][::-1] for g in good]
                        _, length = align(padded([a[g][::-1] for g in good]), na[good], padded(back), np.array([len(x) for x in back]))
                        lo[some[good]] = end[good] - length
                keep = np.flatnonzero(score >= threshold)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [*(col(c).take(take) for c in others), pa.array(score[keep]), pa.array(first[keep] + lo[keep]), pa.array(first[keep] + hi[keep] - 1)],
                    [*others, "score", "first_word", "last_word"],
                )

    return pairs.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    threshold: float = SCORE, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """file, row, id, item, score, first_word, last_word: the best alignment of
    each row of ``docs`` with each benchmark item that reaches ``threshold`` of
    a whole verbatim copy; none is missed.

    Words are runs without blanks, A-Z lower-cased.  Null or blank texts and
    items match nothing, empty tables give no rows.  Rows of ``docs`` are told
    apart by location, so repeated rows and null ids are rows of their own; a
    repeated item is reported once for each distinct id.  Of equal scores the
    first span counts.
    """
    located = with_location(docs.select(column(docs, doc_id).alias("id"), column(docs, text)))
    return _contaminated(located, text, items, item_id, item_text, threshold, filter_bits)


def candidate_pairs(located: DataFrame, text: str, contents: DataFrame, threshold: float = SCORE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """file, row, id, key, item_words, first, words: the part of each passage
    that may hold a copy of the item, for every pair that its seeds leave open."""
    spark: SparkSession = located.sparkSession
    seeds = stage(item_seeds(contents, threshold), "item-seeds")
    longest = contents.agg(F.max(F.size("words"))).first()[0] or 0
    sizes = sorted(r.size for r in seeds.select("size").distinct().collect())  # 1 to 3
    # more than an alignment can cover: all of the item and the words that it can pay for
    reach = 2 + ceil((1 + MATCH * (1 - threshold)) * longest)
    needs = spark.sparkContext.broadcast(table_of_needs(seeds, filter_bits))
    found = stage(passages(located, text, sizes, reach, needs), "passages")

    hits = found.select("file", "row", "first", F.explode("hits").alias("hit")).select("file", "row", "first", "hit.at", "hit.gram")
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("hits"))
    # of need places that a copy keeps, half may be among the most frequent ones, which are left out
    places = seeds.join(counts, "gram").groupBy("key", "place").agg(F.sum("hits").alias("hits"))
    order = Window.partitionBy("key").orderBy(F.desc("hits"), "place")
    frequent = places.withColumn("nth", F.row_number().over(order)).filter("hits > 1")
    frequent = frequent.join(seeds.groupBy("key").agg(F.first("need").alias("need")), "key").filter("nth <= floor(need / 2)").select("key", "place")
    rare = stage(seeds.join(frequent, ["key", "place"], "left_anti"), "rare-seeds")
    pairs = (
        hits.join(rare, "gram")
        .groupBy("file", "row", "first", "key")
        .agg(
            F.min(F.col("at") - F.col("place")).alias("low"), F.max(F.col("at") - F.col("place")).alias("high"),
            F.count_distinct("place").alias("places"), F.first("need").alias("need"),
        )
        .filter("places >= need - floor(need / 2)")
    )
    size = F.size("item_words")
    slack = F.ceil(size * (MATCH * (1 - threshold))).cast("int") + 1
    lo = F.greatest(F.lit(0), F.col("low") - slack)
    return (
        pairs.join(found.select("file", "row", "first", "id", "words"), ["file", "row", "first"])
        .join(contents.select("key", F.col("words").alias("item_words")), "key")
        .select(
            "file", "row", "id", "key", "item_words",
            (F.col("first") + lo).alias("first"),
            F.slice("words", lo + 1, F.greatest(F.lit(1), F.col("high") + size + slack - lo)).alias("words"),
        )
    )


def _contaminated(located, text, items, item_id, item_text, threshold, filter_bits) -> DataFrame:
    items = items.select(column(items, item_id).alias("item"), column(items, item_text).cast("string").alias("text"))
    items = stage(benchmark_items(items), "items")
    contents = stage(items.groupBy("key").agg(F.first("words").alias("words")), "item-texts")
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best")
    found = scored(candidate_pairs(located, text, contents, threshold, filter_bits), threshold).groupBy("file", "row", "id", "key").agg(best)
    return found.join(items.select("item", "key").distinct(), "key").select("file", "row", "id", "item", "best.*").groupBy("file", "row", "id", "item").agg(
        F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best")
    ).select("file", "row", "id", "item", "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns and
    their order stay."""
    located = with_location(docs)
    narrow = located.select(F.struct(F.col("doc")[doc_id].alias("id"), F.col("doc")[text].alias("text")).alias("doc"), "file", "row")
    settings = {"item_id": "item_id", "item_text": "text", "threshold": SCORE, "filter_bits": FILTER_BITS} | options
    bad = _contaminated(narrow, "text", items, **settings).select("file", "row").distinct()
    return unwrapped(located.join(bad, ["file", "row"], "left_anti"), docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "first_word", "last_word"
    )
