"""Helpers shared by the operators: shared working folder, row locations,
Arrow chunking and a vectorised word splitter.

Nothing here depends on the other subpackages of the library.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` inside the tasks, so that workers
    need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process master (``local`` or ``local[...]``) may run without
    the setting; it then works below ``/tmp/checkpoints``.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files.
    This cuts the lineage: a lost executor only costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks over which files or byte ranges are dealt at most.
MOST_TASKS = 10_000


def tasks_for(units: DataFrame) -> int:
    """Into how many tasks to deal rows that stand for files or byte ranges:
    given as a number, Spark does not fold them together because the rows that
    name them are small."""
    return max(1, min(units.count(), MOST_TASKS))


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names cannot clash with ours."""
    return F.struct(*[column(df, c) for c in df.columns])


def with_location(docs: DataFrame) -> DataFrame:
    """``doc`` (struct of all columns), ``file`` and ``row``: where each row
    lies.  A location is unique for each row, also for repeated rows and null
    ids, and stays the same when a task runs again.

    ``docs`` is a Parquet table as read, perhaps filtered or projected; any
    other frame is written to the shared folder first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(whole_row(docs).alias("doc"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    except AnalysisException:
        return with_location(stage(docs, "located"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("doc")[c].alias(c) for c in columns])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


# --- Arrow batches ----------------------------------------------------------


def pieces(batches, column: str, most_bytes: int = 4 << 20, most_rows: int = 2000):
    """Slices of the batches with about ``most_bytes`` of text in ``column``
    (one row at least), so that a task's arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), at + most_rows, n)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row's text starts
    (length rows + 1); null is empty."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


# --- words and word n-grams as 64-bit hashes ---------------------------------

#: Bytes that separate words: space and \t to \r.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that mixes all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte 0 if it separates words, else its lower case plus one."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[ord("A") + np.arange(26)] = ord("a") + np.arange(26) + 1
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


def word_hashes(raw: np.ndarray, at: np.ndarray, table: np.ndarray, most_bytes: int = 1 << 20):
    """Words of each row as (start byte, end byte, row, hash).

    A polynomial hash of each word's lower-cased bytes from prefix sums modulo
    2**64, then mixed.  Works through about ``most_bytes`` at a time, cut where
    no word is, so memory follows the number of words, not 8 bytes for each
    byte of text.
    """
    starts, ends, hashes = [], [], []
    values = splitmix(np.arange(257, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    is_start = np.zeros(len(raw) + 1, bool)
    is_start[at] = True
    size = 0
    power = inverse = np.zeros(0, np.uint64)
    lo = 0
    while lo < len(raw):
        hi = min(lo + most_bytes, len(raw))
        if hi < len(raw):  # to a place between words, forward if need be
            while hi < len(raw) and table[raw[hi]] and not is_start[hi]:
                step = raw[hi : hi + 4096]
                stop = np.flatnonzero((table[step] == 0) | is_start[hi : hi + len(step)])
                hi += int(stop[0]) if len(stop) else len(step)
        c = table[raw[lo:hi]]
        n = len(c)
        word = c > 0
        first = word.copy()
        first[1:] &= ~word[:-1] | is_start[lo + 1 : hi]
        last = word.copy()
        last[:-1] &= ~word[1:] | is_start[lo + 1 : hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            if size < n + 1:
                size = n + 1
                power = np.full(size, _BASE, np.uint64)
                inverse = np.full(size, _BASE_INVERSE, np.uint64)
                power[0] = inverse[0] = 1
                power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values[c] * power[:n], dtype=np.uint64, out=total[1:])
            hashes.append(splitmix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.searchsorted(at, s, "right") - 1, np.concatenate(hashes)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (length words - n + 1)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += splitmix(words[j : j + m] + np.uint64((0xD1342543DE82EF95 * (j + 1)) % (1 << 64)))
    return splitmix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x


# --- a fixed-size filter ------------------------------------------------------


def bitmap_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the bit of each key set."""
    out = np.zeros((1 << bits) >> 3, np.uint8)
    k = keys.view(np.uint64) >> np.uint64(64 - bits)
    np.bitwise_or.at(out, (k >> np.uint64(3)).astype(np.int64), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap) * 8).bit_length() - 1
    k = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 > 0
