"""Repeated byte strings by bucket-pointer refinement.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere
else is found and removed, without a table of all suffixes.

1. *Initial buckets.*  The bucket of a q-gram is named after the buckets of its
   halves (8 bytes exactly, then 16, 32, 64), so equal q-grams get equal names
   in every task.  Of the q-grams inside a window of ``LENGTH`` bytes the one
   with the smallest name, leftmost if tied, is the window's *sample*; equal
   windows have equal samples at equal places.  So windows need only be
   compared inside a sample's bucket, and only about one position in 69 is
   shuffled.  A bucket with one sample is done.
2. *Refinement by whole spans.*  A sample and all windows that it stands for are
   one span of at most 336 bytes.  Buckets are sorted by the spans' digests:
   equal spans repeat in all their windows.  What is alone in its span but not
   in its bucket goes on, with one copy of every other span of the bucket.
3. *Refinement by pointers.*  Such buckets meet in tasks.  Positions get the
   ranks of their first 8 bytes, and ranks are refined by sorting on pairs of
   the rank here and the rank at a later offset; each new rank serves the next
   round (16, 32, 64, 128, 200 bytes).  Exact: bytes are compared, not hashes.
4. *Large buckets* (more than ``HEAVY`` spans) are split first: windows by
   their distance to the sample in steps of 32, 8, 2 and 1, each step a bucket
   named after the bytes that its windows have in common, until a bucket is
   small or its windows are the same string.  The steps run from 2 again, with
   shuffles, so no bucket is ever gathered whole, however frequent a passage.

Sorted runs are cut by the full key, location included, so one name's rows can
lie in many partitions.  A row at a partition's border counts as perhaps equal
to what lies beyond; it is compared again later, so results stay exact.

Texts are copied once to part files of a bounded size in the shared folder;
later passes shuffle positions and read the parts, never whole texts.  File
names travel in written tables only, so a repeated task leaves files that
nothing reads.

Defined results: null counts as empty; texts shorter than ``LENGTH`` keep all
bytes; repeated rows are rows of their own and remove each other's text; ids
are not used, so null or repeated ids do no harm; an empty table gives no rows;
other columns travel unchanged in ``doc``, whatever their names.  The rest of a
text may end inside a UTF-8 character, hence bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, column, new_folder, pieces, read_table, signed, splitmix, stage, text_bytes
from .files import file_system, open_read

by_value(__name__)

LENGTH = 200
#: Bytes of a sampled q-gram, 8 times a power of two.
GRAM = 64
#: Text bytes of a part file (one row at least); a task that reads one needs
#: about 16 times that.  Text bytes that are sampled at once (80 times that).
PART, PIECE = 8 << 20, 1 << 20
#: Spans of a bucket that are refined in one task.
HEAVY = 1024
#: Windows of a step when a heavy bucket is split.
STEPS = (32, 8, 2, 1)
#: Window starts that are sampled at once; their places take the low bits of a key.
SEGMENT, PLACE = 1 << 22, 23


# --- samples -----------------------------------------------------------------


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one number (zeros after the end)."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    out = np.empty(len(raw), np.uint64)
    for s in range(8):
        here = out[s::8]
        here[:] = padded[s : s + 8 * len(here)].view("<u8")
    return out


def gram_names(raw: np.ndarray, gram: int) -> np.ndarray:
    """The bucket name of the ``gram`` bytes at each position that has them."""
    names, size = eight_bytes(raw), 8
    names = names[: max(len(raw) - 7, 0)]
    while size < gram:
        if len(names) <= size:
            return np.zeros(0, np.uint64)
        left, right = names[:-size], names[size:]
        names = left * np.uint64(0x9E3779B97F4A7C15)
        names ^= names >> np.uint64(29)
        names += right
        names *= np.uint64(0xBF58476D1CE4E5B9)
        names ^= names >> np.uint64(32)
        size *= 2
    return names


def smallest_ahead(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def samples(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Samples of all windows of each text: (row, position of the sample in its
    text, first window, number of windows, bucket name), in order."""
    out = []
    lo = 0
    while lo < len(at) - 1:
        # texts up to a segment, or one long text in segments
        hi = max(int(np.searchsorted(at, at[lo] + SEGMENT, "right")) - 1, lo + 1)
        for first in range(int(at[lo]), int(at[hi]), SEGMENT):
            last = min(first + SEGMENT, int(at[hi]))
            piece = raw[first : min(last + length - 1, int(at[hi]))]
            names = gram_names(piece, gram)
            # starts of windows: texts in [lo, hi) that have any
            begins = np.maximum(at[lo:hi], first)
            numbers = np.maximum(np.minimum(at[lo + 1 : hi + 1] - length + 1, last) - begins, 0)
            total = int(numbers.sum())
            if not total:
                continue
            row = np.repeat(np.arange(lo, hi), numbers)
            start = np.arange(total) + np.repeat(begins - first - np.concatenate(([0], np.cumsum(numbers)[:-1])), numbers)
            low = np.uint64((1 << PLACE) - 1)
            keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
            place = (smallest_ahead(keys, length - gram + 1)[start] & low).astype(np.int64)
            new = np.ones(total, bool)
            new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            i = np.flatnonzero(new)
            r = row[i]
            out.append((r, place[i] + first - at[r], start[i] + first - at[r], np.diff(np.append(i, total)), splitmix(names[place[i]])))
        lo = hi
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def part_path(folder: str, part: int) -> str:
    return f"{folder}/{part:016x}.arrow"


class Part:
    """A part file's rows, texts and samples."""

    def __init__(self, folder: str, part: int):
        with open_read(part_path(folder, part)) as f:
            (self.batch,) = pa.ipc.open_file(f).read_all().combine_chunks().to_batches()
        self.raw, self.at = text_bytes(self.batch.column("text"))
        steps, s = text_bytes(self.batch.column("steps"))
        counts, _ = text_bytes(self.batch.column("counts"))
        n = np.diff(s)
        self.row = np.repeat(np.arange(len(n)), n)
        self.count = counts.astype(np.int64)

        def within(x):  # running total in each text
            total = np.cumsum(x.astype(np.int64))
            before = np.concatenate(([0], total))[s[:-1]]
            return total - np.repeat(before, n)

        self.first = within(counts) - self.count
        self.sample = within(steps)


def other_columns(docs: DataFrame, text: str) -> Column:
    """All columns but the text, as one struct, so that names cannot clash."""
    return F.struct(*[column(docs, c) for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")])


def sampled(docs: DataFrame, text: str, length: int, gram: int, part_bytes: int) -> tuple[DataFrame, str]:
    """Write the part files; ``name``, ``part`` and ``ordinal`` of each sample,
    and a row without name and ordinal for each part."""
    folder = new_folder(docs.sparkSession, "parts")

    def write(rows: list[pa.RecordBatch]) -> int:
        table = pa.Table.from_batches(rows).combine_chunks()
        part = uuid.uuid4().int >> 65
        system, path = file_system(part_path(folder, part))
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return part

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, size = [], [], 0

        def close():
            part, name = write(rows), signed(np.concatenate(names))
            rows.clear()
            names.clear()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part]), pa.array([None], pa.int32())], ["name", "part", "ordinal"])
            for i in range(0, len(name), 100_000):
                some = name[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), part)), pa.array(np.arange(i, i + len(some), dtype=np.int32))], ["name", "part", "ordinal"]
                )

        for piece in pieces(batches, "text", PIECE):
            raw, at = text_bytes(piece.column("text"))
            row, sample, first, count, name = samples(raw, at, length, gram)
            number = np.bincount(row, minlength=piece.num_rows)
            new = np.ones(len(row), bool)
            new[1:] = row[1:] != row[:-1]
            step = np.where(new, sample, np.diff(sample, prepend=0)).astype(np.uint8)
            ends = np.concatenate(([0], np.cumsum(number)))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (step, count.astype(np.uint8))]
            rows.append(pa.RecordBatch.from_arrays([*piece.columns, *packed], [*piece.schema.names, "steps", "counts"]))
            names.append(name)
            size += len(raw)
            if size >= part_bytes:
                yield from close()
                size = 0
        if rows:
            yield from close()

    docs = docs.select(other_columns(docs, text).alias("doc"), column(docs, text).cast("string").alias("text"))
    return stage(docs.mapInArrow(task, "name long, part long, ordinal int"), "samples"), folder


# --- runs of sorted rows -------------------------------------------------------


def neighbours(batches: Iterator[pa.RecordBatch]):
    """Each batch with the rows before and after it (one-row batches or None)."""
    before = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held, before, batch.slice(0, 1)
            before = held.slice(held.num_rows - 1, 1)
        held = batch
    if held is not None:
        yield held, before, None


def equal_to_next(name: str, batch: pa.RecordBatch, before, after) -> np.ndarray:
    """For the gaps before, between and after the rows: 1 if both sides are
    equal, 0 if not, -1 at the border of the partition."""
    x = batch.column(name)
    out = np.full(len(x) + 1, -1, np.int8)
    out[1:-1] = pa.compute.equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    if before is not None:
        out[0] = before.column(name)[0] == x[0]
    if after is not None:
        out[-1] = after.column(name)[0] == x[len(x) - 1]
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The samples that are not alone in their bucket."""

    def task(batches):
        for batch, before, after in neighbours(batches):
            same = equal_to_next("name", batch, before, after)
            yield batch.filter(pa.array((same[:-1] != 0) | (same[1:] != 0)))

    return in_order(rows.filter("name IS NOT NULL"), "name", "part", "ordinal").mapInArrow(task, rows.schema)


#: What becomes of a span: repeated; repeated and the copy to compare with; to be compared.
REPEATED, COPY, OPEN = 0, 1, 2


def sorted_out(spans: DataFrame) -> DataFrame:
    """Spans (``name``, ``digest``, ``part``, ``ordinal``, ``a``, ``b``) by
    what becomes of them; those alone in their bucket go."""

    def task(batches):
        for batch, before, after in neighbours(batches):
            bucket, span = (equal_to_next(c, batch, before, after) for c in ("name", "digest"))
            span[bucket == 0] = 0
            repeated = (span[:-1] == 1) | (span[1:] == 1)
            # the last of a run that another span follows, or the first of the bucket's last run
            follows = (bucket[1:] != 0) & (span[1:] != 1)
            leads = (bucket[:-1] != 0) & (span[:-1] != 1)
            ends = (bucket[1:] == 0) | (span[1:] == 1)
            copy = follows | (leads & ends)
            kind = np.where(repeated, np.where(copy, COPY, REPEATED), OPEN).astype(np.int8)
            keep = repeated | copy
            columns = [batch.column(c) for c in ("name", "part", "ordinal", "a", "b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kind)], ["name", "part", "ordinal", "a", "b", "kind"]).filter(pa.array(keep))

    ordered = in_order(spans, "name", "digest", "part", "ordinal", "a")
    return stage(ordered.mapInArrow(task, "name long, part long, ordinal int, a int, b int, kind byte"), "kinds")


# --- looking up texts ----------------------------------------------------------


def by_part(batches: Iterator[pa.RecordBatch], folder: str):
    """(part, rows) for rows sorted by part; at most 50,000 rows at a time."""
    part = opened = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if part != ids[lo]:
                part, opened = ids[lo], None  # one open part at a time
                opened = Part(folder, int(part))
            for i in range(int(lo), int(hi), 50_000):
                yield opened, batch.slice(i, min(50_000, int(hi) - i))


def to_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows), "part").sortWithinPartitions("part", "ordinal")


def window_ranges(part: Part, batch: pa.RecordBatch):
    """Arrays of a batch's spans: ordinal, first and last window (of the
    sample's), start byte in the part and the first window's distance to the sample."""
    o = batch.column("ordinal").to_numpy()
    a = batch.column("a").to_numpy().astype(np.int64)
    b = batch.column("b").to_numpy().astype(np.int64)
    b = np.where(b < 0, part.count[o] - 1, b)
    start = part.at[part.row[o]] + part.first[o] + a
    ahead = part.sample[o] - part.first[o] - a
    return o, a, b, start, ahead


def digests(rows: DataFrame, folder: str, length: int, step: int = 0) -> DataFrame:
    """``digest`` of each span with its distance to the sample (``b`` -1: all of
    the sample's windows).  With ``step``, windows are dealt to cells of that
    many distances, in buckets named after what a cell's windows share."""

    def task(batches):
        for part, batch in by_part(batches, folder):
            name = batch.column("name").to_numpy()
            o, a, b, start, ahead = window_ranges(part, batch)
            if step:  # distances fall from ahead to ahead - (b - a)
                top, low = ahead // step, (ahead - (b - a)) // step
                n = top - low + 1
                i = np.repeat(np.arange(len(o)), n)
                cell = top[i] - (np.arange(len(i)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n))
                hi = np.minimum(ahead[i], cell * step + step - 1)
                lo = np.maximum(ahead[i] - (b[i] - a[i]), cell * step)
                shared = start[i] + ahead[i] - cell * step  # where the nearest window would start
                o, name = o[i], name[i]
                a, b, start, ahead = a[i] + ahead[i] - hi, a[i] + ahead[i] - lo, start[i] + ahead[i] - hi, hi
            raw = memoryview(part.raw)
            out = [
                hashlib.blake2b(raw[s : s + m], digest_size=16, salt=d.to_bytes(2, "little")).digest()
                for s, m, d in zip(start.tolist(), (b - a + length).tolist(), ahead.tolist(), strict=True)
            ]
            if step:
                core = length - step + 1
                name = np.array(
                    [
                        int.from_bytes(hashlib.blake2b(raw[s : s + core], digest_size=8, key=k.tobytes(), salt=c.to_bytes(2, "little")).digest(), "little", signed=True)
                        for s, k, c in zip(shared.tolist(), name, cell.tolist(), strict=True)
                    ],
                    np.int64,
                )
            same_part = np.full(len(o), batch.column("part")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(out, pa.binary()), pa.array(same_part), pa.array(o), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                ["name", "digest", "part", "ordinal", "a", "b"],
            )

    return to_parts(rows).mapInArrow(task, "name long, digest binary, part long, ordinal int, a int, b int")


def span_texts(rows: DataFrame, folder: str, length: int) -> DataFrame:
    def task(batches):
        for part, batch in by_part(batches, folder):
            o, a, b, start, ahead = window_ranges(part, batch)
            raw = part.raw.tobytes()
            texts = [raw[s : s + m] for s, m in zip(start.tolist(), (b - a + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("name"),
                    batch.column("part"),
                    batch.column("ordinal"),
                    pa.array(a.astype(np.int32)),
                    pa.array((batch.column("kind").to_numpy() == OPEN)),
                    pa.array(ahead.astype(np.int32)),
                    pa.array(texts, pa.binary()),
                ],
                ["name", "part", "ordinal", "a", "open", "ahead", "span"],
            )

    return to_parts(rows).mapInArrow(task, "name long, part long, ordinal int, a int, open boolean, ahead int, span binary")


# --- pointers --------------------------------------------------------------------


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of ranks below 2**32, by sorting."""
    if len(keys) == 2:
        return np.unique(keys[0].astype(np.uint64) << np.uint64(32) | keys[1].astype(np.uint64), return_inverse=True)[1]
    return ranks(ranks(*keys[:-1]), keys[-1])


def repeated_windows(group: np.ndarray, ahead: np.ndarray, raw: np.ndarray, at: np.ndarray, length: int):
    """Windows of spans (bytes at[i] to at[i + 1] of ``raw``) that another span
    of the group repeats at the same distance to the sample: (span, window) of
    every window and whether it is repeated."""
    here, size = np.unique(eight_bytes(raw), return_inverse=True)[1], 8
    while 2 * size <= length:  # positions near the end compare what lies beyond, but no window begins there
        later = np.zeros(len(here), here.dtype)
        later[:-size] = here[size:]
        here, size = ranks(here, later), 2 * size
    n = np.diff(at) - length + 1
    span = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(span)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    place = at[span] + window
    bucket = ranks(group[span], ahead[span] - window)
    final = ranks(bucket, here[place], here[place + length - size])
    return span, window, np.bincount(final)[final] > 1


def refined(spans: DataFrame, length: int) -> DataFrame:
    """``part``, ``ordinal``, ``a``, ``b``: windows a to b of a sample repeat."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        group = np.unique(rows.column("name").to_numpy(), return_inverse=True)[1]
        raw, at = text_bytes(rows.column("span").combine_chunks())
        span, window, repeated = repeated_windows(group, rows.column("ahead").to_numpy().astype(np.int64), raw, at, length)
        repeated &= rows.column("open").to_numpy()[span]
        new = np.ones(len(span), bool)
        new[1:] = span[1:] != span[:-1]
        begins = np.flatnonzero(repeated & (new | ~np.concatenate(([False], repeated[:-1]))))
        ends = np.flatnonzero(repeated & (np.append(new[1:], True) | ~np.append(repeated[1:], False)))
        i, a = span[begins], rows.column("a").to_numpy()[span[begins]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows.column("part").to_numpy()[i]),
                pa.array(rows.column("ordinal").to_numpy()[i]),
                pa.array((a + window[begins]).astype(np.int32)),
                pa.array((a + window[ends]).astype(np.int32)),
            ],
            ["part", "ordinal", "a", "b"],
        )

    def task(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                names = batch.column("name").to_numpy()
                cuts = np.flatnonzero(np.diff(names)) + 1
                if held and held[-1].column("name")[held[-1].num_rows - 1].as_py() != names[0]:
                    cuts = np.concatenate(([0], cuts))
                late = cuts[cuts + rows >= HEAVY]
                if not len(late):
                    held.append(batch)
                    rows += batch.num_rows
                    break
                if late[0]:
                    held.append(batch.slice(0, int(late[0])))
                yield solve(pa.Table.from_batches(held))
                held, rows = [], 0
                batch = batch.slice(int(late[0]))
        if held:
            yield solve(pa.Table.from_batches(held))

    return spans.repartition(partitions(spans), "name").sortWithinPartitions("name").mapInArrow(task, "part long, ordinal int, a int, b int")


def with_heavy(rows: DataFrame, most: int) -> DataFrame | None:
    """``rows`` with ``heavy``: whether their bucket has more than ``most``; or
    None if no bucket has.  A bucket's rows meet its size in salted shares."""
    salts = 16
    sizes = stage(rows.groupBy("name").count().filter(F.col("count") > most).select("name"), "heavy")
    if sizes.isEmpty():
        return None
    sizes = sizes.select("name", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("found"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("part", "ordinal", "a"), F.lit(salts)).cast("int"))
    return stage(salted.join(sizes, ["name", "salt"], "left").select(*rows.columns, F.col("found").isNotNull().alias("heavy")), "by-size")


def repeated_ranges(names: DataFrame, folder: str, length: int, heavy: int) -> DataFrame:
    """``part``, ``ordinal``, ``a``, ``b`` of all repeated windows (b -1: all)."""
    rows = shared_buckets(names).withColumns({"a": F.lit(0), "b": F.lit(-1)})
    kinds = sorted_out(digests(rows, folder, length))
    columns = ["part", "ordinal", "a", "b"]
    found = kinds.filter(F.col("kind") != OPEN).select(columns)
    for step in [*STEPS, None]:
        rest = kinds.filter(F.col("kind") != REPEATED)
        marked = with_heavy(rest, heavy) if step else None
        light = rest if marked is None else marked.filter("NOT heavy")
        found = found.union(stage(refined(span_texts(light, folder, length), length), "repeated"))
        if marked is None:
            break
        kinds = sorted_out(digests(marked.filter("heavy"), folder, length, step))
        # a copy to compare with has been counted: only what was open is news, but copies count again without harm
        found = found.union(kinds.filter(F.col("kind") != OPEN).select(columns))
    return found


# --- results -----------------------------------------------------------------


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, part_bytes: int = PART) -> DataFrame:
    """For each row of ``docs``: ``doc`` (struct of its other columns), ``n_bytes``,
    ``spans`` (maximal removed runs as byte ``start`` and ``end``) and ``kept``
    (the remaining bytes)."""
    if not 8 <= gram < length <= gram + 254 or gram & (gram - 1):
        raise ValueError("gram must be a power of two from 8, below length, and at most 254 below it")
    names, folder = sampled(docs, text, length, gram, part_bytes)
    found = repeated_ranges(names, folder, length, heavy)
    # every part comes, if only with its empty row
    rows = found.union(names.filter("name IS NULL").select("part", F.lit(None).cast("int").alias("ordinal"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    schema = T.StructType().add("doc", docs.select(other_columns(docs, text).alias("doc")).schema[0].dataType).add("n_bytes", "long")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")

    def finish(part: Part, gaps: np.ndarray) -> Iterator[pa.RecordBatch]:
        np.cumsum(gaps, out=gaps)
        covered = gaps[:-1] > 0
        edge = np.zeros(len(covered) + 1, bool)  # runs end with their text
        edge[part.at] = True
        change = np.diff(covered.astype(np.int8), prepend=0, append=0)
        begins = np.flatnonzero((change == 1) | (edge & np.append(covered, False) & np.append(False, covered)))
        ends = np.flatnonzero((change == -1) | (edge & np.append(False, covered) & np.append(covered, False)))
        row = np.searchsorted(part.at, begins, "right") - 1
        kept = ~covered
        left = part.raw[kept].tobytes()
        gaps[0] = 0
        np.cumsum(kept, out=gaps[1:])
        kept_at = gaps[part.at]
        run_at = np.searchsorted(row, np.arange(len(part.at)))
        run = pa.StructArray.from_arrays([pa.array(begins - part.at[row]), pa.array(ends - part.at[row])], ["start", "end"])
        for i in range(0, part.batch.num_rows, 1000):
            j = min(i + 1000, part.batch.num_rows)
            texts = pa.array([left[a:b] for a, b in zip(kept_at[i:j], kept_at[i + 1 : j + 1], strict=True)], pa.binary())
            spans = pa.ListArray.from_arrays(pa.array((run_at[i : j + 1] - run_at[i]).astype(np.int32)), run.slice(int(run_at[i]), int(run_at[j] - run_at[i])))
            yield pa.RecordBatch.from_arrays(
                [part.batch.column("doc").slice(i, j - i), pa.array(np.diff(part.at[i : j + 1])), spans, texts], ["doc", "n_bytes", "spans", "kept"]
            )

    def task(batches):
        part, gaps = None, None
        for opened, batch in by_part(batches, folder):
            if opened is not part:
                if part is not None:
                    yield from finish(part, gaps)
                part, gaps = opened, np.zeros(len(opened.raw) + 1, np.int32)  # a text has less than 2 GB
            batch = batch.filter(batch.column("ordinal").is_valid())
            if batch.num_rows:
                _, a, b, start, _ = window_ranges(part, batch)
                np.add.at(gaps, start, 1)
                np.add.at(gaps, start + (b - a) + length, -1)
        if part is not None:
            yield from finish(part, gaps)

    return to_parts(rows).mapInArrow(task, schema)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("doc")["doc_id"].alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
