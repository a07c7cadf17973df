"""CSV files with line breaks inside quoted cells, read in byte ranges.

Spark reads a ``multiLine`` file in one task, since a range cannot know whether
it starts inside quotes.  The number of quotes before it tells: a doubled quote
counts twice, so the parity is right.  Three passes over lines, which Spark
splits into ranges by itself:

1. quotes of each range, added up where the range is read;
2. an exclusive prefix over the ranges of a file (one row for each range): is
   its start inside quotes?
3. each range joins its lines to records, from that state on.  What a range
   does not own whole, the end of a record that began before it or the
   beginning of one that ends behind it, is put together by file, in order.

Whole records go to Spark's own CSV parser.  No record is held beyond its own
size, and a task reads one range, however large the file.

Files of one folder may have different headers; columns are matched by name.
Blank lines are no records.  A record's line may end in a line feed or in
carriage return and line feed; inside quotes both stay as they are.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dunning.operators.keys import SMALL
from dunning.session import materialize

#: Where a piece of a record stands in its range.
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3
PARSE = {"escape": '"', "mode": "PERMISSIVE"}


def file_lines(spark: SparkSession, path) -> DataFrame:
    """``file``, ``start`` (of the byte range) and ``line``, in the order of
    each range."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = text.metadataColumn("_metadata")
    return text.select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.col("value").alias("line"))


def odd_ranges(lines: DataFrame) -> DataFrame:
    """``file`` and ``start`` of the ranges that start inside quotes."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"')))
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("before", F.sum("quotes").over(before)).where("before % 2 = 1").select("file", "start")


def pieces_of_records(lines: DataFrame, odd: DataFrame) -> DataFrame:
    """``file``, ``start``, ``place`` in the range, ``kind`` and ``text``."""
    marked = lines.join(F.broadcast(odd.withColumn("odd", F.lit(1))), ["file", "start"], "left")
    whole, head, middle, tail = WHOLE, HEAD, MIDDLE, TAIL

    def task(batches):  # travels by value
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = None  # (file, start) of the open range
        held, inside, place, first = [], False, 0, True

        def batch(texts, kind, n):
            nonlocal place
            rows = len(texts)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]] * rows, pa.string()),
                    pa.array([at[1]] * rows, pa.int64()),
                    pa.array(np.arange(place, place + rows)),
                    pa.array(np.full(rows, kind, np.int8)),
                    texts.cast(pa.string()),
                ],
                ["file", "start", "place", "kind", "text"],
            )
            place += n
            return out

        def close():  # the range ends: what is open goes on in the next one
            nonlocal held
            if held:
                kind = middle if first and began_inside else tail if inside else whole
                if not inside and first and began_inside:
                    kind = head
                yield batch(pa.array(["\n".join(held)]), kind, 1)
                held = []

        began_inside = False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            files, starts = b.column("file"), b.column("start").to_numpy()
            codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                key = (files[lo].as_py(), int(starts[lo]))
                if key != at:
                    yield from close()
                    at, place, first = key, 0, True
                    inside = began_inside = b.column("odd")[lo].as_py() == 1
                part = b.column("line").slice(lo, hi - lo)
                parity = np.asarray(pc.count_substring(part, '"').to_numpy(zero_copy_only=False), np.int64) % 2
                after = (np.cumsum(parity) + inside) % 2  # inside quotes behind each line
                ends = np.flatnonzero(after == 0)  # lines that end a record
                if not len(ends):
                    held += part.to_pylist()
                    inside = True
                    continue
                # the record that was open
                done = int(ends[0]) + 1
                if held or inside:
                    text = pa.array(["\n".join(held + part.slice(0, done).to_pylist())])
                    yield batch(text, head if first and began_inside else whole, 1)
                    held, first = [], False
                    ends = ends[1:]
                else:
                    done = 0
                first = False
                if len(ends):
                    offsets = np.concatenate(([done], ends + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), part.cast(pa.string()))
                    yield batch(pc.binary_join(lists, "\n"), whole, len(ends))
                    done = int(ends[-1]) + 1
                held = part.slice(done).to_pylist()
                inside = bool(len(held))
        if at is not None:
            yield from close()

    return marked.select("file", "start", "line", "odd").mapInArrow(task, "file string, start long, place long, kind byte, text string")


def whole_records(pieces: DataFrame) -> DataFrame:
    """``file``, ``start``, ``place`` and ``text`` of every record; one that
    spans ranges has the place where it begins."""
    parts = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = parts.groupBy("file", "record").agg(
        F.min(F.struct("start", "place")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "place", "text")
    rows = whole.union(joined.select("file", "at.start", "at.place", "text"))
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return rows.withColumn("text", text).where(F.trim("text") != "")


def numbered(records: DataFrame) -> DataFrame:
    """``records`` with ``row``, the number of a record in its file (the header
    is 0): counts of the ranges, and the order within a range of one task."""
    written = materialize(records)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_range = Window.partitionBy("file", "start").orderBy("place")  # one range: at most its bytes
    return written.join(offsets, ["file", "start"]).withColumn("row", F.col("offset") + F.row_number().over(in_range) - 1).select("file", "row", "text")


def first_records(records: DataFrame) -> DataFrame:
    """``file``, ``first`` (start and place) and ``header``, the text, of the
    first record of each file: smallest numbers by hash, so that no task sorts
    records, and then the record that lies there."""
    starts = materialize(records.groupBy("file").agg(F.min("start").alias("start")))
    places = records.join(small(starts), ["file", "start"]).groupBy("file", "start").agg(F.min("place").alias("place"))
    return records.join(small(materialize(places)), ["file", "start", "place"]).select("file", F.struct("start", "place").alias("first"), F.col("text").alias("header"))


def small(facts: DataFrame) -> DataFrame:
    """``facts``, to be sent to every task if there are few."""
    return F.broadcast(facts) if facts.limit(SMALL + 1).count() <= SMALL else facts


def read_csv_ranges(spark: SparkSession, path, positions: bool = False) -> DataFrame:
    """All columns of the CSV files of ``path`` as text.  With ``positions``,
    ``_file`` and ``_row`` of each row come along."""
    lines = file_lines(spark, path)
    odd = materialize(odd_ranges(lines))
    if odd.limit(SMALL + 1).count() > SMALL:  # more than a task should hold: let Spark read whole files
        if positions:
            raise ValueError("too many ranges start inside quotes to number their rows")
        return spark.read.options(**PARSE, header="true", multiLine="true").csv(path)
    records = materialize(whole_records(pieces_of_records(lines, odd)))
    firsts = materialize(first_records(records))
    headers = {h: safe_header(h) for (h,) in firsts.select("header").distinct().collect()}  # the different ones, normally one
    if not headers:
        return spark.createDataFrame([], "")
    names = list(dict.fromkeys(c for own in headers.values() for c in own))
    rows = numbered(records) if positions else records
    rows = rows.join(small(firsts), "file")
    rows = rows.where("row > 0") if positions else rows.where("start <> first.start OR place <> first.place")
    out = None
    for header, own in headers.items():
        cells = F.from_csv("text", ", ".join(f"`{c.replace('`', '``')}` STRING" for c in own), PARSE)
        mine = rows.where(F.col("header") == header).select("file", *(["row"] if positions else []), cells.alias("cells"))
        at = [F.col("file").alias("_file"), F.col("row").alias("_row")] if positions else []
        part = mine.select(*at, *[F.col("cells")[c].alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in names])
        out = part if out is None else out.unionByName(part)
    return out


def safe_header(text: str) -> list[str]:
    """Column names of a header: blank ones and repeated ones get their
    position, as Spark's reader names them."""
    cells = next(csv.reader([text]))
    return [f"_c{i}" if not c else f"{c}{i}" if cells.count(c) > 1 else c for i, c in enumerate(cells)]
