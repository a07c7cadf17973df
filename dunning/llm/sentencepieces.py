"""SentencePiece encoding and decoding with the tokenizers library (operator 5).

The model's protobuf is parsed here; from it come the normaliser, the metaspace
marker, the vocabulary (unigram scores, or byte-pair merges ordered by score)
and byte fallback.  Every distinct chunk is compared with the sentencepiece
library, and every text with its own decoding.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encoded, worker_state
from .common import by_value, column, pieces, read_table

by_value(__name__)

SPACE = "▁"
#: Piece types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that a worker keeps: beside a tokenizer and the library's model, in a process that other stages use too.
KEPT_PIECES = 200_000
#: Bytes of text encoded at once.  What that takes stays with the process between the chunks it keeps, so it is little.
MOST_BYTES = 256 << 10


# --- the model file -----------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(data: bytes):
    """(field number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]]  # text, score, type
    model: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_blanks: bool = True
    unknown_surface: str = " ⁇ "


def parse(data: bytes) -> Spec:
    spec = Spec([])
    for field, value in message(data):
        if field == 1:
            piece = dict(message(value))
            spec.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(message(value))
            spec.model = trainer.get(3, UNIGRAM)
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.unknown = trainer.get(40, 0)
            spec.unknown_surface = trainer.get(44, spec.unknown_surface.encode()).decode()
        elif field == 3:
            normaliser = dict(message(value))
            spec.charsmap = normaliser.get(2, b"")
            spec.dummy_prefix = bool(normaliser.get(3, 1))
            spec.trim_blanks = bool(normaliser.get(4, 1))
    if spec.model not in (UNIGRAM, BPE):
        raise ValueError(f"model type {spec.model}: only unigram and BPE models are read")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """All ways to make a piece from two others, best score first: the order in
    which SentencePiece joins neighbours."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    out = []
    for piece, s in score.items():
        out += [(-s, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
    rank = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    out.sort(key=lambda m: (m[0], rank[m[1]], rank[m[2]]))
    return [(a, b) for _, a, b in out]


def backend(spec: Spec, whole: bool = True):
    """A tokenizer of the tokenizers library; ``whole``: with the normaliser
    and decoder, else for chunks that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if spec.model == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocabulary, merges(spec), unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    out = Tokenizer(model)
    if whole:
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.trim_blanks:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(SPACE)] if spec.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        out.decoder = decoders.Sequence(
            [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])]
        )
    return out


# --- encoding and decoding ----------------------------------------------------


class Codec:
    """Encodes and decodes texts.  Chunks (a run of space markers and what
    follows up to the next one) are independent where no piece has a marker
    after another character; otherwise a text is one chunk."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.spec = spec = parse(data)
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p, _, kind in spec.pieces if kind in (NORMAL, USER))
        self.model = backend(spec, whole=False)
        self.oracle = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.surface = [self._surface(i, p, kind) for i, (p, _, kind) in enumerate(spec.pieces)]

    def _surface(self, i: int, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.spec.unknown_surface if i == self.spec.unknown else piece.replace(SPACE, " ")).encode()

    @cached_property
    def full(self):
        """With the normaliser and the decoder: a second copy of the model, for models whose normaliser does more than mark blanks."""
        return backend(self.spec)

    def normalised(self, text: str) -> str:
        if self.spec.charsmap or self.spec.trim_blanks:
            return self.full.normalizer.normalize_str(text)
        return (SPACE if self.spec.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def chunks(self, text: str) -> list[str]:
        text = self.normalised(text)
        if not text:
            return []
        if not self.chunked:
            return [text]
        parts = text.split(SPACE)
        out = [parts[0]] if parts[0] else []
        if SPACE * 2 not in text and parts[-1]:
            return out + [SPACE + p for p in parts[1:]]
        run = SPACE
        for p in parts[1:]:
            if p:
                out.append(run + p)
                run = SPACE
            else:
                run += SPACE
        if run != SPACE:
            out.append(run[:-1])
        return out

    def encode_chunks(self, some: list[str]) -> list[list[int]]:
        got = [e.ids for e in self.model.encode_batch(some, add_special_tokens=False)]
        if self.by_chunk:
            # the library puts the first marker itself
            for c, a, b in zip(some, got, self.oracle.encode([c[1:].replace(SPACE, " ") for c in some], num_threads=1), strict=True):
                if a != b and c != SPACE:
                    self.wrong.add(c)
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        docs = [self.chunks(t) for t in texts]
        out = [np.frombuffer(b, np.uint32) for b in encoded(docs, self.known, self.encode_chunks, "I", KEPT_PIECES)]
        if self.by_chunk:
            self.parity = [not self.wrong or self.wrong.isdisjoint(d) for d in docs]
        else:  # chunks are not what the library normalises by itself: whole texts
            self.parity = [x.tolist() == y for x, y in zip(out, self.oracle.encode(texts, num_threads=1), strict=True)]
        return out

    @property
    def by_chunk(self) -> bool:
        """Can the library be asked for a chunk by itself?"""
        return self.spec.dummy_prefix and not self.spec.trim_blanks and not self.spec.charsmap

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


def codec_of(data: bytes, threads: int) -> Codec:
    """The worker's codec for a model, made once for each process."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # batches run on several threads
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        return Codec(data)

    return worker_state("sentencepiece_" + hashlib.sha256(data).hexdigest()[:16], make)


def sentencepiece_ids(
    docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", threads: int = 2, with_ids: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids (array) and
    decoded (text; both if ``with_ids``), ids_crc32, decoded_sha256,
    round_trip, parity.

    ``model`` is a SentencePiece model file that the driver can read (a few MB,
    sent to the tasks).  Null is the empty text; it has no ids.  ids_crc32 is
    over the ids as little-endian unsigned 32-bit integers.  round_trip: the
    decoded text is the normalised one.  parity: each of the text's chunks has
    the ids that the sentencepiece library gives; where a model's normaliser
    does not work by chunk, the whole text has.  Repeated rows and null ids are
    rows of their own; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    narrow = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).cast("string").alias("text"))
    schema = narrow.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_tokens"),
        *([F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")] if with_ids else []),
        F.lit(0).cast("long").alias("ids_crc32"),
        F.lit("").alias("decoded_sha256"),
        F.lit(True).alias("round_trip"),
        F.lit(True).alias("parity"),
    ).schema

    def run(batches):
        codec = codec_of(shared.value, threads)
        for piece in pieces(batches, "text", MOST_BYTES):
            texts = piece.column(1).fill_null("").to_pylist()
            ids = codec.encode(texts)
            parity = codec.parity
            back = [codec.decode(x.tolist()) for x in ids]
            plain = [codec.normalised(t).replace(SPACE, " ")[codec.spec.dummy_prefix :] for t in texts]
            out = {
                "doc_id": piece.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())) if with_ids else None,
                "decoded": pa.array(back) if with_ids else None,
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                "round_trip": pa.array([a == b for a, b in zip(back, plain, strict=True)]),
                "parity": pa.array(parity),
            }
            out = {k: v for k, v in out.items() if v is not None}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return narrow.mapInArrow(run, schema)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return sentencepiece_ids(read_table(spark, sf_dir, "documents"), public_model())
