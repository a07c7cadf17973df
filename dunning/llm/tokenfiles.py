"""Token-id files with Elias-Fano document boundaries (operator 4).

A shard file holds the ids of consecutive documents (by id) as one array of
16- or 32-bit integers, the document boundaries and document ids as Elias-Fano
codes, and nothing as a 64-bit table:

    magic "EFTOK1\\0\\0", id width (1 byte), rows without id (8 bytes), ids of
    documents (Elias-Fano, relative to the smallest), boundaries (Elias-Fano,
    one more than documents), then the array.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import encoded, worker_state
from .common import by_value, column, new_folder, pieces, read_table, stage, tasks_for
from .eliasfano import EliasFano
from .files import open_read, write_new

by_value(__name__)

MAGIC = b"EFTOK1\0\0"
_HEAD = "<8sBQq"  # magic, width, rows without id, smallest id
#: Ids of a shard file at most, but for a single longer document.
SHARD_IDS = 4 << 20
#: Documents whose boundaries are read at once.
READ_DOCS = 256
END = 0
MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("n_ids", pa.int64()), ("size", pa.int64())])


# --- encoding -----------------------------------------------------------------


class BytePairCodec:
    """Chunks for a byte-level BPE tokenizer whose splitting pattern never
    joins a non-blank with the blank after it: a text may be cut there.

    With ``special_as_text`` what looks like a special token is encoded like
    other text; without, it gets its own id, as by the library's default."""

    def __init__(self, data: str, special_as_text: bool = True):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = special_as_text
        #: added tokens that hold or take blanks: a text that has one is not cut
        self.uncut = [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()
            if t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content]
        ]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.ask = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        #: tokens that begin with a space, as byte-level vocabularies write it
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        # a space after white space: cut with care (the space first, which the search skips to)
        self.careful = re.compile(r" (?<=\s )").search
        self.split = re.compile(r"\s*\S+|\s+").findall
        self.one_word = re.compile(r" \S+").fullmatch

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.uncut and any(t in text for t in self.uncut):
            return [text]
        if text[-1] == " " or self.careful(text):
            return self.split(text)
        parts = text.split(" ")
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out if parts[0] else out[1:]

    def ids_of(self, some: list[str]) -> list[bytes]:
        """Ids of chunks, as bytes.  Those that are one space and then none are encoded
        as one text and parted again where a token begins with the space, which
        spares the library an object for each."""
        plain = [c for c in some if self.one_word(c)]
        got: dict[str, bytes] = {}
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            (whole,) = self.ask(["".join(part)], add_special_tokens=False)
            ids = np.array(whole.ids)
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(at) == len(part) + 1 and at[0] == 0:
                at = (at * np.dtype(self.dtype).itemsize).tolist()
                raw = ids.astype(self.dtype).tobytes()
                got.update((c, raw[x:y]) for c, x, y in zip(part, at, at[1:], strict=False))
        rest = [c for c in some if c not in got]
        got.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(rest, self.ask(rest, add_special_tokens=False), strict=True))
        return [got[c] for c in some]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids = encoded([self.chunks(t) for t in texts], self.known, self.ids_of)
        return [np.frombuffer(b, self.dtype) for b in ids]


# --- the file format ----------------------------------------------------------


def dump_shard(doc_ids: list, docs: list[np.ndarray], dtype) -> bytes:
    """Documents in ascending id order, those without id last."""
    ids = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(ids[0]) if len(ids) else 0
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.uint64)
    offsets = (ids.view(np.uint64) - np.int64(least).view(np.uint64)) if len(ids) else np.zeros(0, np.uint64)
    return b"".join(
        [
            struct.pack(_HEAD, MAGIC, np.dtype(dtype).itemsize, len(doc_ids) - len(ids), least),
            EliasFano.of(offsets).dumps(),
            EliasFano.of(ends).dumps(),
            *[np.ascontiguousarray(d, dtype).tobytes() for d in docs],
        ]
    )


class Shard:
    """A shard's documents, found through select."""

    def __init__(self, data: bytes):
        magic, width, self.without, self.least = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._ids, at = EliasFano.loads(data, struct.calcsize(_HEAD))
        self.bounds, at = EliasFano.loads(data, at)
        self.tokens = np.frombuffer(data, {2: "<u2", 4: "<u4"}[width], offset=at)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def doc_ids(self) -> list:
        known = (self._ids.all() + np.int64(self.least).view(np.uint64)).view(np.int64) if len(self._ids) else np.zeros(0, np.int64)
        return known.tolist() + [None] * self.without

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds[i] : self.bounds[i + 1]]


# --- Spark jobs ---------------------------------------------------------------


def write_token_files(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", shard_ids: int = SHARD_IDS, end: int = END,
    special_as_text: bool = True,
) -> DataFrame:
    """Encode each text, append the id ``end`` and write shard files in
    ascending order of doc_id (an integer column).  Returns the manifest: part,
    shard, file, docs, n_ids, start (ids of all shards before).

    ``tokenizer`` is a tokenizers file that the driver can read.  Without
    ``special_as_text`` a literal special token in a text gets its own id, as
    the file and the library have it.  Null is the
    empty text: only the end id.  Rows without id come last, repeated ids stay
    rows of their own, in the order of their ids.  An empty table writes no file.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    folder = new_folder(spark, "token-files")
    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).cast("string").alias("text"))

    # by range of id before encoding: texts are shuffled once, and the pass that samples the bounds only scans
    narrow = narrow.withColumn("no_id", F.col("doc_id").isNull())
    ordered = narrow.repartitionByRange("no_id", "doc_id", F.xxhash64("text")).sortWithinPartitions("no_id", "doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def save(batches):
        key = "bytepair_" + hashlib.sha256(shared.value.encode()).hexdigest()[:16] + ("_text" if special_as_text else "")
        codec = worker_state(key, lambda: BytePairCodec(shared.value, special_as_text))
        last = np.array([end], codec.dtype)
        ids, docs_, total, shard = [], [], 0, 0

        def flush():
            data = dump_shard(ids, docs_, codec.dtype)
            row = {"part": part, "shard": shard, "file": write_new(folder, ".eftok", data), "docs": len(ids), "n_ids": total, "size": len(data)}
            return pa.RecordBatch.from_pylist([row], MANIFEST)

        for piece in pieces(batches, "text"):
            part = piece.column(2)[0].as_py()
            for d, x in zip(piece.column(0).to_pylist(), codec.encode(piece.column(1).fill_null("").to_pylist()), strict=True):
                if ids and total + len(x) + 1 > shard_ids:
                    yield flush()
                    ids, docs_, total, shard = [], [], 0, shard + 1
                ids.append(d)
                docs_.append(np.concatenate([x, last]))
                total += len(x) + 1
        if ids:
            yield flush()

    shards = stage(ordered.mapInArrow(save, "part int, shard int, file string, docs long, n_ids long, size long"), "token-manifest")
    # a running total over shards: first within each part, then over the parts (one row for each)
    parts = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(parts):
        before.append((p, total))
        total += parts[p]
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = spark.createDataFrame(before, "part int, base long")
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.coalesce(within, F.lit(0))).drop("base")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    of every document, read from the files of a manifest."""

    def read(batches):
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for file, start in zip(cols["file"], cols["start"], strict=True):
                with open_read(file) as f:
                    shard = Shard(f.read())
                ids = shard.doc_ids()
                for i in range(0, len(shard), READ_DOCS):  # boundaries through select, a stretch at a time
                    bounds = shard.bounds.some(i, min(i + READ_DOCS, len(shard)) + 1).astype(np.int64)
                    crc = [zlib.crc32(shard.tokens[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i : i + READ_DOCS], pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("file", "start")
    files = files.repartition(tasks_for(files))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents"), path, special_as_text=False))
