"""Token ids of texts by chunks that a tokenizer treats independently.

Most chunks (roughly, words) occur again and again, so a worker keeps the ids
of those it has met and asks the tokenizers library only for the others.
"""

from __future__ import annotations

import sys
import types
from array import array

from .common import by_value

by_value(__name__)

#: Chunks that a worker process keeps, and their longest length.
KEPT, KEPT_CHARS = 600_000, 64


def worker_state(key: str, make):
    """A value that lives as long as the worker process, over all its tasks."""
    state = sys.modules.setdefault("dunning_worker_state", types.ModuleType("dunning_worker_state"))
    if not hasattr(state, key):
        setattr(state, key, make())
    return getattr(state, key)


def encoded(docs: list[list[str]], known: dict[str, bytes], encode, code: str | None = None, kept: int = KEPT) -> list[bytes]:
    """The ids of each list of chunks as bytes.  ``encode`` maps a list of
    chunks to lists of ids, which become arrays of type ``code``, or without
    ``code`` to the bytes themselves.  ``known`` keeps ``kept`` chunks."""
    missing = list(set().union(*docs).difference(known))
    for i in range(0, len(missing), 20_000):
        some = missing[i : i + 20_000]
        got = encode(some)
        known.update(zip(some, (array(code, ids).tobytes() for ids in got) if code else got, strict=True))
    out = [b"".join(map(known.__getitem__, d)) for d in docs]
    over = len(known) - kept
    for c in missing[::-1]:  # the worker keeps what came first, which is most of what is frequent
        if over > 0 or len(c) > KEPT_CHARS:
            del known[c]
            over -= 1
    return out
