"""Near-duplicate passages by compact windows (operator 7).

Texts are compared by their shingles of five words.  A passage has a shingle
similarity of SIMILAR or more over LEAST_WORDS words, so two texts that share
one have some words of it in a row: an edit costs eight shingles at least, and
without a run of 25 words there are too many edits (``common_run``).

The tokens of the windows are as long as half that run, 13 words.  Under a hash
function a *compact window* (l, c, r) stands for all stretches [i, j] with
l <= i <= c <= j <= r: their minimum is the token at c.  A Cartesian tree over
the hashes gives the windows; only those that hold a stretch of the least
length are kept, about 2 n / (least + 1) of n tokens.  A run of 25 words has one
stretch of 13 tokens, so texts that share it have a window with the same minimum
there: one function finds every pair.

Windows with the same minimum are brought together, and where they overlap in a
stretch of the least length the shingles themselves are compared.  A value that
a third of all texts share is never gathered: windows are sorted by range over
(value, text, place), so that a long run covers several partitions, and each row
is linked to the run's first and to the row before.  That connects most of what
has a passage in common.  Where texts of one value are in different classes
then, all pairs of them across classes that share 25 words in a row are compared
too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLANKS,
    by_value,
    byte_classes,
    column,
    gram_hashes,
    in_bitmap,
    pieces,
    read_table,
    signed,
    splitmix,
    stage,
    text_bytes,
    with_location,
    word_hashes,
)
from .components import connected_components
from .decontaminate import bitmap_of_grams

by_value(__name__)

WORDS = 5
LEAST_WORDS = 50
SIMILAR = 0.8
#: Pairs of a text that share one copy of its words when they are verified.
SPREAD = 256
#: Bits of the bitmap of texts that take part in a candidate, as a power of two (2 MB).
FILTER_BITS = 24
#: Value of tokens that are a window's minimum only where it has no other.
LAST = np.uint64((1 << 64) - 1)
#: Shingles beside a run of one word that may be the next ones in common: a chain's gap and its lean.
GAP, LEAN = 12, 8
_TABLE = byte_classes(BLANKS)


# --- compact windows ----------------------------------------------------------


def common_run(least: int, similar: float) -> int:
    """Shingles in a row that two texts with a passage of ``least`` shingles
    share: of m shingles in common ``similar`` allows m (1 - similar) / similar
    others, and each break between runs costs both texts WORDS - 1."""
    at_least = int(np.ceil(2 * similar / (1 + similar) * least - 1e-9))
    breaks = lambda m: int(m * (1 - similar) / similar / (2 * (WORDS - 1)) + 1e-9)
    return min(-(-m // (breaks(m) + 1)) for m in range(at_least, 20 * at_least + 200))


def sliding_least(v: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each t consecutive values."""
    width = 1
    while 2 * width <= t:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (t - width)], v[t - width :]) if t > width else v


def hashed_least(tokens: np.ndarray, least: int, function: int, last: np.ndarray | None = None):
    """Value of each token, and of each ``least`` consecutive ones the place of
    the smallest: in the low ``bits`` of what sorts like the values.  Tokens
    marked in ``last`` have the value LAST."""
    n = len(tokens)
    value = splitmix(tokens ^ np.uint64(0xA0761D6478BD642F * (2 * function + 1) % (1 << 64)))
    if last is not None:
        value[last] = LAST
    bits = np.uint64(max(1, (n - 1).bit_length()))
    # places in the low bits: ties go to the first
    keyed = (value >> bits << bits) | np.arange(n, dtype=np.uint64)
    return value, sliding_least(keyed, least), bits


def compact_windows(tokens: np.ndarray, text: np.ndarray, least: int, function: int, last: np.ndarray | None = None):
    """(text, value, l, c, r) of the compact windows of ``least`` or more
    tokens; ``text`` numbers the text of each token, places count within the
    whole array."""
    n = len(tokens)
    if n < least:
        return (np.zeros(0, np.int64),) * 5
    value, lowest, bits = hashed_least(tokens, least, function, last)
    lowest = lowest[text[: n - least + 1] == text[least - 1 :]]
    if not len(lowest):
        return (np.zeros(0, np.int64),) * 5
    lowest = lowest[np.r_[True, lowest[1:] != lowest[:-1]]]
    c = (lowest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = text[c]
    # A neighbour that bounds such a window is the centre of one too, so the tree needs only the centres.
    first, last = np.searchsorted(text, owner, "left"), np.searchsorted(text, owner, "right") - 1
    left, right = first.tolist(), last.tolist()
    stack: list[int] = []
    keys, owners, places = lowest.tolist(), owner.tolist(), c.tolist()
    for i, (k, o) in enumerate(zip(keys, owners, strict=True)):
        while stack and (owners[stack[-1]] != o or keys[stack[-1]] > k):
            j = stack.pop()
            if owners[j] == o:
                right[j] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return owner, value[c], np.array(left), c, np.array(right)


def text_keys(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text's words: the same for equal word sequences."""
    n = np.diff(begin)
    within = np.arange(len(words), dtype=np.uint64) - np.repeat(begin[:-1], n).astype(np.uint64)
    mixed = splitmix(words ^ splitmix(within + np.uint64(0x9E3779B97F4A7C15)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    return splitmix(total[begin[1:]] - total[begin[:-1]] + n.astype(np.uint64))


def _words(piece, at_column: int):
    raw, at = text_bytes(piece.column(at_column))
    _, _, row, h = word_hashes(raw, at, _TABLE)
    return row, h, np.searchsorted(row, np.arange(len(at)))


def runs_of_one_word(h: np.ndarray, row: np.ndarray, begin: np.ndarray, run: int, least: int):
    """(text, value, place) for runs of ``run`` or more times one word.  Very
    many texts may have one, and it has no place that tells them apart.  Where
    two of them share a passage, either both repeat the word over the least
    length, or a shingle beside the run is shared too: the value is that of the
    word, or of the word and each such shingle."""
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    first, n = first[n >= run], n[n >= run]
    grams = gram_hashes(h, WORDS)
    side = np.arange(1, GAP + LEAN + 1)
    beside = np.concatenate([first[:, None] - side, (first + n - WORDS)[:, None] + side], axis=1).reshape(-1)
    of = np.repeat(np.arange(len(first)), 2 * len(side))
    ok = (beside >= begin[row[first[of]]]) & (beside + WORDS <= begin[row[first[of]] + 1])
    beside, of = beside[ok], of[ok]
    whole = np.flatnonzero(n >= least + WORDS - 1)
    word = splitmix(h[first] + np.uint64(1))
    value = np.concatenate([word[whole], splitmix(word[of] ^ grams[beside])])
    owner = row[first[np.concatenate([whole, of])]]
    return owner, value, np.concatenate([first[whole], beside]) - begin[owner]


def _windows(h: np.ndarray, row: np.ndarray, begin: np.ndarray, gram: int, least: int, passage: int):
    """(text, value, l, c, r) of the windows of texts, places within the text;
    the last number says how many are compact windows: runs of one word follow."""
    tokens = gram_hashes(h, gram)
    inside = row[: len(tokens)] == row[gram - 1 :][: len(tokens)]
    tokens, owner = tokens[inside], row[: len(inside)][inside]
    start = np.searchsorted(owner, np.arange(len(begin)))
    same = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    flat = (same[gram - 1 :] == same[: len(same) - gram + 1])[: len(inside)][inside]
    of, value, l, c, r = compact_windows(tokens, owner, least, 0, flat)  # noqa: E741
    some = value != LAST
    base = start[of[some]]
    l, c, r = (x[some] - base for x in (l, c, r))  # noqa: E741
    more = runs_of_one_word(h, row, begin, gram + least - 1, passage)
    plain = len(c)
    of, value, c = (np.concatenate([x, y]) for x, y in zip((of[some], value[some], c), more, strict=True))
    return of, value, np.concatenate([l, more[2] - least]), c, np.concatenate([r, more[2] + least]), plain


def windows_of(located: DataFrame, text: str, gram: int, least: int, passage: int) -> DataFrame:
    """A row for each text (c -1: file, row, id, key, n_words) and for each
    compact window of ``least`` tokens of ``gram`` words (key, value, c, l, r;
    places within the text).  Runs of one word have windows of their own;
    ``passage``: shingles of the shortest passage."""
    narrow = located.select("file", "row", F.col("doc.id").alias("id"), F.col("doc")[text].cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"file string, row long, id {kind}, n_words int, key long, value long, c int, l int, r int"

    def run(batches):
        names = ["file", "row", "id", "n_words", "key", "value", "c", "l", "r"]
        for piece in pieces(batches, "text"):
            row, h, begin = _words(piece, 3)
            key = text_keys(h, begin)
            m, rows = len(key), [piece.column(j) for j in range(3)]
            no = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array(np.diff(begin).astype(np.int32)), pa.array(signed(key)), no(m, pa.int64()), pa.array(np.full(m, -1, np.int32)), no(m, pa.int32()), no(m, pa.int32())],
                names,
            )
            of, value, l, c, r, _ = _windows(h, row, begin, gram, least, passage)
            n = len(of)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [*(no(n, x.type) for x in rows), no(n, pa.int32()), pa.array(signed(key[of])), pa.array(signed(value)),
                     *(pa.array(x.astype(np.int32)) for x in (c, l, r))],
                    names,
                )

    return narrow.mapInArrow(run, schema)


def stretch_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """Hash of each ``least`` consecutive shingles; these hold their order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(tokens), dtype=np.uint64)])
    return splitmix(total[least:] - total[:-least])


# --- texts with windows of the same value ---------------------------------------

PAIR = "value long, a long, b long, function int, ac int, al int, ar int, bc int, bl int, br int"


def meetings(windows: DataFrame) -> DataFrame:
    """Pairs of windows of different texts with the same value: each with the
    first of its run and with the one before.  The pairs of a value connect all
    texts that have it.  A run is cut where partitions end; the first rows of
    its parts are linked afterwards."""
    ordered = windows.repartitionByRange("value", "key", "c").sortWithinPartitions("value", "key", "c")
    ordered = ordered.select("value", "key", F.lit(0).alias("function"), "c", "l", "r", F.spark_partition_id().alias("part"))
    names = ["value", "a", "b", "function", "ac", "al", "ar", "bc", "bl", "br"]

    def scan(batches):
        carried = None  # the run's first row and the last row so far
        heads = []
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(6)[0].as_py()
            x = np.stack([np.asarray(batch.column(j), np.int64) for j in range(6)])  # value, key, function, c, l, r
            if carried is None:
                heads.append(x[:, 0])
                before = 0
            else:
                x = np.concatenate([carried, x], axis=1)
                before = 2
            new = np.r_[True, x[0, 1:] != x[0, :-1]]
            if before:
                new[1] = False  # both carried rows are of one run
            at = np.arange(x.shape[1])
            again = np.r_[False, (x[:, 1:] == x[:, :-1]).all(axis=0)]  # the same window of a copy
            first = np.maximum.accumulate(np.where(new, at, 0))
            previous = np.r_[0, at[:-1]]
            for other in (first, previous):
                ok = (at >= before) & ~new & ~again & (x[1, other] != x[1])
                if other is previous:
                    ok &= previous != first
                a, b = x[:, other[ok]], x[:, ok]
                low = a[1] < b[1]
                a, b = np.where(low, a, b), np.where(low, b, a)
                if ok.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[0]), pa.array(a[1]), pa.array(b[1]), *(pa.array(y.astype(np.int32)) for y in (a[2], a[3], a[4], a[5], b[3], b[4], b[5]))], names
                    )
            carried = np.stack([x[:, first[-1]], x[:, -1]], axis=1)
        if carried is not None:
            heads.append(carried[:, 0])
            for which, h in zip((-1, -2), heads, strict=True):  # first and last run of the partition
                y = [h[0], h[1], part, which, h[2], h[3], h[4], h[5], 0, 0]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 3 else pa.int32()) for i, v in enumerate(y)], names)

    found = stage(ordered.mapInArrow(scan, PAIR), "meetings")
    # two rows for each partition, whatever the number of windows
    ends = sorted((r.b, r.function, r) for r in found.filter("function < 0").collect())
    ends.sort(key=lambda e: (e[0], -e[1]))
    joints = []
    for (_, w1, x), (_, w2, y) in zip(ends, ends[1:], strict=False):
        if w1 == -2 and w2 == -1 and x.value == y.value and x.a != y.a:
            lo, hi = (x, y) if x.a < y.a else (y, x)
            joints.append((x.value, lo.a, hi.a, 1, lo.al, lo.ar, lo.bc, hi.al, hi.ar, hi.bc))
    pairs = found.filter("function >= 0")
    if joints:
        pairs = pairs.union(windows.sparkSession.createDataFrame(joints, PAIR))
    return pairs


# --- interval joins and verification --------------------------------------------


def overlaps(meets: list[tuple[int, ...]], least: int, enough: int) -> list[tuple[int, int, int, int]]:
    """Stretches (a from, a to, b from, b to) that windows of ``enough``
    functions have in common in both texts.  ``meets`` has rows of function,
    ac, al, ar, bc, bl, br.

    Along its diagonal a meeting covers one interval of both texts.  Taken by
    start within neighbouring diagonals, an interval shares ``least`` places
    with an earlier one if that reaches far enough, so the farthest of each
    function is all that must be known.
    """
    spans = []
    for f, ac, al, ar, bc, bl, br in meets:
        left, right = min(ac - al, bc - bl), min(ar - ac, br - bc)
        if left + right + 1 >= least:
            spans.append((bc - ac, ac - left, ac + right, f))
    spans.sort()
    out: list[list[int]] = []
    i = 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][0] - spans[j - 1][0] <= 16:
            j += 1
        reach: dict[int, int] = {}
        begun = len(out)
        for lean, start, stop, f in sorted(spans[i:j], key=lambda x: x[1]):
            others = sorted(r for g, r in reach.items() if g != f and r >= start + least - 1)
            if len(others) + 1 >= enough:
                to = min(stop, others[1 - enough]) if enough > 1 else stop
                last = out[-1] if len(out) > begun else None
                if last and start <= last[1] + 1:
                    out[-1] = [last[0], max(last[1], to), min(last[2], start + lean), max(last[3], to + lean)]
                else:
                    out.append([start, to, start + lean, to + lean])
            reach[f] = max(reach.get(f, -1), stop)
        i = j
    return [tuple(x) for x in out]


def best_stretch(pa_: np.ndarray, pb: np.ndarray, least: int, similar: float) -> tuple[int, int, float] | None:
    """(from, to, similarity) of the longest stretch of matches that covers
    ``least`` places of both sides and reaches ``similar``; None without one."""
    n = len(pa_)
    if n < 2 * similar / (1 + similar) * least or len(np.unique(pb)) < 2 * similar / (1 + similar) * least - 1e-9:
        return None
    if (np.diff(pb) > 0).all():
        # x to y reaches it if level[y] >= level[x] - (1 - similar): the last such y for each x
        level = (1 + similar) * np.arange(n) - similar * (pa_ + pb)
        ahead = np.maximum.accumulate(level[::-1])  # from the last to each place, ascending
        y = n - 1 - np.searchsorted(ahead, level - (1 - similar) - 1e-9, "left")
        na, nb = pa_[y] - pa_ + 1, pb[y] - pb + 1
        x = int(np.where((na >= least) & (nb >= least), na, 0).argmax())
        if na[x] < least or nb[x] < least:
            return None
        m = int(y[x]) - x + 1
        return x, int(y[x]) + 1, float(m / (na[x] + nb[x] - m))
    best, wide = None, 0
    order = np.lexsort([np.arange(n), pb])
    earlier = np.full(n, -1)  # the match before with the same place in b
    same = pb[order][1:] == pb[order][:-1]
    earlier[order[1:][same]] = order[:-1][same]
    for x in range(n):
        if pa_[-1] - pa_[x] + 1 < max(least, wide + 1):
            break
        some = pb[x:]
        na = pa_[x:] - pa_[x] + 1
        nb = np.maximum.accumulate(some) - np.minimum.accumulate(some) + 1
        m = np.cumsum(earlier[x:] < x)
        score = m / (na + nb - m)
        ok = np.flatnonzero((na >= least) & (nb >= least) & (score >= similar))
        if len(ok) and na[ok[-1]] > wide:
            wide, best = int(na[ok[-1]]), (x, x + int(ok[-1]) + 1, float(score[ok[-1]]))
    return best


def shared_passages(a: np.ndarray, b: np.ndarray, least: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """(a from, a to, b from, b to, similarity) of the passages of two shingle
    sequences: stretches of ``least`` shingles with a Jaccard similarity of
    ``similar`` or more along one diagonal, give or take a few words; of a chain
    of matches the longest such stretch, then those beside it.  Ends are
    exclusive."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    place = np.flatnonzero(hi > lo)
    if len(place) < similar * least / 2:
        return []
    out: list[tuple[int, int, int, int, float]] = []
    match = order[lo[place]]
    # a shingle that occurs again goes to the occurrence nearest the diagonal before
    for k in np.flatnonzero(hi[place] - lo[place] > 1).tolist():
        p = place[k]
        shift = match[k - 1] - place[k - 1] if k else 0
        some = order[lo[p] : hi[p]]
        match[k] = some[np.abs(some - p - shift).argmin()]
    breaks = (np.diff(place) > GAP) | (np.abs(np.diff(match - place)) > LEAN)
    todo = np.split(np.arange(len(place)), np.flatnonzero(breaks) + 1)[::-1]
    while todo:  # the longest stretch of each chain, then what is left of it on both sides
        part = todo.pop()
        pa_, pb = place[part], match[part]
        best = best_stretch(pa_, pb, least, similar)
        if best:
            x, y, score = best
            out.append((int(pa_[x]), int(pa_[y - 1]) + 1, int(pb[x:y].min()), int(pb[x:y].max()) + 1, score))
            todo += [part[y:], part[:x]]
    if not out:  # word for word, also where repeated shingles were matched elsewhere
        ours, theirs = stretch_hashes(a, least), stretch_hashes(b, least)
        _, i, j = np.intersect1d(ours, theirs, return_indices=True)
        if len(i):
            i, j = min(zip(i.tolist(), j.tolist(), strict=True))
            n = least
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            out.append((i, i + n, j, j + n, 1.0))
    return out


def merged(spans: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Stretches of two texts joined where they lie within ``gap`` places of one
    another in both."""
    out: list[tuple[int, int, int, int]] = []
    for a, a_to, b, b_to in sorted(spans):
        for k in range(len(out) - 1, -1, -1):
            x = out[k]
            if a <= x[1] + gap and b <= x[3] + gap and x[2] <= b_to + gap:
                out[k] = (x[0], max(x[1], a_to), min(x[2], b), max(x[3], b_to))
                break
        else:
            out.append((a, a_to, b, b_to))
    return out


INTERVAL = "a long, b long, a_from int, a_to int, b_from int, b_to int"


def compared_pairs(met: DataFrame, least: int, gap: int) -> DataFrame:
    """Pairs of texts and where their windows overlap (tokens, ends inclusive);
    those that overlap nowhere have one row with nulls."""
    pairs = met.groupBy("a", "b").agg(F.collect_set(F.struct("function", "ac", "al", "ar", "bc", "bl", "br")).alias("meets"))

    def join_intervals(batches):
        for batch in batches:
            a, b, out = [], [], []
            col = batch.column(2)
            ends = np.asarray(col.offsets).tolist()
            flat = list(zip(*(col.values.field(j).to_pylist() for j in range(7)), strict=True))
            for x, y, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:], strict=False):
                for o in merged(overlaps(flat[i:j], least, 1), gap) or [(None,) * 4]:
                    a.append(x)
                    b.append(y)
                    out.append(o)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(c, pa.int32()) for c in cols)], ["a", "b", "a_from", "a_to", "b_from", "b_to"]
            )

    return pairs.mapInArrow(join_intervals, INTERVAL)


# --- pairs across classes ---------------------------------------------------------


def bits_for(n: int) -> int:
    """Bits of a bitmap of ``n`` keys, as a power of two: 16 MB at most."""
    return min(27, max(20, (256 * n).bit_length()))


def bitmap_broadcast(keys: DataFrame):
    """The bitmap of the staged ``keys`` (column ``gram``), for the tasks."""
    return keys.sparkSession.sparkContext.broadcast(bitmap_of_grams(keys, bits_for(keys.count())))


def values_apart(met: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values (``gram``) of three windows or more that some pair of ``apart``
    has in common, and the texts that have them: all texts of a value are in its
    rows of ``met``.  What bitmaps let through besides is harmless."""
    pairs = bitmap_broadcast(apart.select(F.xxhash64("a", "b").alias("gram")))

    def mark(batches):
        bits = np.frombuffer(pairs.value, np.uint8)
        for batch in batches:
            hit = in_bitmap(bits, np.asarray(batch.column(2), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], ["value", "joint", "hit"])

    marks = met.select("value", F.col("function").alias("joint"), F.xxhash64("a", "b")).mapInArrow(mark, "value long, joint int, hit boolean")
    # two windows make one row and have been compared; a joint may stand for more
    values = marks.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max("joint").alias("joint"), F.max("hit").alias("hit"))
    values = stage(values.filter("hit and (n > 1 or joint > 0)").select(F.col("value").alias("gram")), "values-apart")
    wanted = bitmap_broadcast(values)

    def texts(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            hit = in_bitmap(bits, np.asarray(batch.column(0), np.int64))
            a, b = (np.asarray(batch.column(k), np.int64)[hit] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], ["gram"])

    return values, stage(met.select("value", "a", "b").mapInArrow(texts, "gram long").distinct(), "texts-apart")


COMMON = "run long, key long, edge long, at int"


def common_runs(located: DataFrame, text: str, gram: int, least: int, passage: int, keys: DataFrame, values: DataFrame) -> DataFrame:
    """A row for each stretch of ``least`` tokens in the windows with a value of
    ``values`` of the texts ``keys``: the hash of its words, the word before it
    (the text's key where it begins) and its place.  A run of one word has its
    window's value and the text's key."""
    some_keys, some_values = bitmap_broadcast(keys), bitmap_broadcast(values)
    n_words = gram + least - 1

    def stretches(batches):
        key_bits, value_bits = np.frombuffer(some_keys.value, np.uint8), np.frombuffer(some_values.value, np.uint8)
        for piece in pieces(batches, "text"):
            row, h, begin = _words(piece, 0)
            key = text_keys(h, begin)
            take = in_bitmap(key_bits, key)
            h, key = h[take[row]], key[take]
            begin = np.concatenate([[0], np.cumsum(np.diff(begin)[take])])
            if not len(h):
                continue
            row = np.repeat(np.arange(len(key)), np.diff(begin))
            of, value, l, c, r, plain = _windows(h, row, begin, gram, least, passage)  # noqa: E741
            hit = in_bitmap(value_bits, value)
            alone = hit[plain:]
            one, one_value, one_at = of[plain:][alone], value[plain:][alone], c[plain:][alone]
            of, l, c, r = (x[:plain][hit[:plain]] for x in (of, l, c, r))  # noqa: E741
            first, last = np.maximum(l, c - least + 1), np.minimum(c, r - least + 1)
            n = last - first + 1
            of, at = np.repeat(of, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
            place = begin[of] + at
            run = gram_hashes(h, n_words)[place] if len(of) else np.zeros(0, np.uint64)
            edge = np.where(at > 0, h[place - 1], key[of])
            cols = [(run, one_value), (key[of], key[one]), (edge, key[one]), (at.astype(np.int32), one_at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(x))) for x in cols], ["run", "key", "edge", "at"])

    return located.select(F.col("doc")[text].cast("string").alias("text")).mapInArrow(stretches, COMMON)


def pairs_across(
    located: DataFrame, text: str, met: DataFrame, compared: DataFrame, found: DataFrame, gram: int, least: int, passage: int
) -> DataFrame | None:
    """Pairs of texts in different classes of ``found`` that share as many words
    in a row as ``least`` tokens have, with the stretches from the first to the
    last such run (tokens, ends inclusive); None if no value has texts of
    different classes.  A pair meets where a run begins that it shares: there
    the words before differ, so texts that go on alike to the left are not
    paired at every place."""
    root = lambda k: found.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    apart = compared.select("a", "b").distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = stage(apart.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "pairs-apart")
    if apart.isEmpty():
        return None
    values, keys = values_apart(met, apart)
    rows = common_runs(located, text, gram, least, passage, keys, values)
    rows = rows.groupBy("key", "run", "edge").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).join(root("key"), "key", "left")
    rows = stage(rows.select("run", "key", "edge", "lo", "hi", F.coalesce("key_root", "key").alias("root")), "common-runs")
    differ = lambda c: F.min(c) != F.max(c)
    groups = rows.groupBy("run").agg((differ("root") & differ("edge")).alias("ok")).filter("ok").select("run")
    rows = stage(rows.join(groups, "run"), "runs-apart")
    side = lambda k: rows.select("run", *(F.col(c).alias(f"{k}_{c}") for c in ("key", "edge", "lo", "hi", "root")))
    pairs = side("a").join(side("b"), "run").filter("a_key < b_key and a_root != b_root and a_edge != b_edge")
    pairs = pairs.groupBy(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    last = least - 1
    return pairs.agg(F.min("a_lo").alias("a_from"), (F.max("a_hi") + last).alias("a_to"), F.min("b_lo").alias("b_from"), (F.max("b_hi") + last).alias("b_to"))


def repeated_passages(located: DataFrame, text: str, least_words: int = LEAST_WORDS, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (file, row, id, key, n_words; equal word sequences have one
    key), links between different texts: a, b (keys), a_from, a_to, b_from, b_to
    (words, end exclusive), similarity; and the classes they make (node, root).
    The links connect all texts that share a passage."""
    least = least_words - WORDS + 1
    run = common_run(least, similar) + WORDS - 1
    gram = max(WORDS, (run + 1) // 2)
    everything = stage(windows_of(located, text, gram, run - gram + 1, least), "windows")
    texts = everything.filter("c < 0").select("file", "row", "id", "key", "n_words")
    met = meetings(everything.filter("c >= 0").select("key", "value", "c", "l", "r"))
    # a passage of at most twice the least length and a gap lies within that of the run it holds
    around = 2 * least + 4 * WORDS
    compared = stage(compared_pairs(met, run - gram + 1, 2 * around), "compared-pairs")
    links = passage_links(located, text, compared.filter("a_from is not null"), least, similar, around + gram)
    found = connected_components(links.select("a", "b"))
    across = pairs_across(located, text, met, compared, found, gram, run - gram + 1, least)
    if across is not None and not (across := stage(across, "pairs-across")).isEmpty():
        more = passage_links(located, text, across, least, similar, around + gram)
        if not more.isEmpty():
            links = links.union(more)
            found = connected_components(links.select("a", "b"))
    return texts, links, found


def passage_links(located: DataFrame, text: str, candidates: DataFrame, least: int, similar: float, around: int) -> DataFrame:
    """The passages of candidate pairs (a, b, a_from, a_to, b_from, b_to), with
    ``around`` words looked at on both sides."""
    spark = located.sparkSession
    wanted = candidates.select(F.col("a").alias("gram")).union(candidates.select("b"))
    bitmap = spark.sparkContext.broadcast(bitmap_of_grams(wanted, FILTER_BITS))

    def words(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for piece in pieces(batches, "text"):
            _, h, begin = _words(piece, 0)
            key = text_keys(h, begin)
            take = np.flatnonzero(in_bitmap(bits, key))
            short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)  # a shingle of five has 160 bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key[take])), pa.array([short[begin[i] : begin[i + 1]] for i in take], pa.list_(pa.int32()))], ["key", "words"]
            )

    contents = located.select(F.col("doc")[text].cast("string").alias("text")).mapInArrow(words, "key long, words array<int>")
    # copies have the same words: any one of them will do
    contents = stage(contents.groupBy("key").agg(F.first("words").alias("words")), "passage-texts")

    # The words of b come along with each pair, those of a once for each SPREAD of its pairs:
    # a text with very many partners is sent to several tasks, and held by one row at a time.
    lo = F.greatest(F.lit(0), F.col("b_from") - around)
    shares = candidates.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("shares"))
    pairs = (
        candidates.join(shares, "a")
        .join(contents.withColumnRenamed("key", "b"), "b")
        .select(
            "a", F.pmod(F.xxhash64("b", "b_from"), "shares").cast("int").alias("share"), F.lit(1).alias("kind"), "a_from", "a_to", "b", lo.alias("b_at"),
            F.slice("words", lo + 1, F.col("b_to") - lo + around + WORDS).alias("words"),
        )
    )
    none = F.lit(None).cast("int")
    heads = contents.join(shares, contents.key == shares.a).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), none.alias("a_from"), none.alias("a_to"),
        F.lit(None).cast("long").alias("b"), none.alias("b_at"), "words",
    )
    met = heads.union(pairs).repartition("a", "share").sortWithinPartitions("a", "share", "kind")

    def verify(batches):
        own = np.zeros(0, np.uint64)
        for batch in batches:
            cols = [batch.column(j).to_pylist() for j in range(7)]
            words, rows = batch.column(7), []
            ends = np.asarray(words.offsets).tolist()
            flat = np.asarray(words.values, np.int32).view(np.uint32)
            for k, (a, _, kind, a_from, a_to, b, b_at) in enumerate(zip(*cols, strict=True)):
                grams = gram_hashes(flat[ends[k] : ends[k + 1]].astype(np.uint64), WORDS)
                if kind == 0:
                    own = grams
                    continue
                a_at = max(0, a_from - around)
                for p in shared_passages(own[a_at : a_to + around + 1], grams, least, similar):
                    rows.append((a, b, p[0] + a_at, p[1] + a_at + WORDS - 1, p[2] + b_at, p[3] + b_at + WORDS - 1, p[4]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "a_from", "a_to", "b_from", "b_to", "similarity"]
            )

    links = met.mapInArrow(verify, "a long, b long, a_from int, a_to int, b_from int, b_to int, similarity double").distinct()
    return stage(links, "passage-links")


def passage_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, similar: float = SIMILAR) -> DataFrame:
    """One row for each row of ``docs`` that shares a passage of
    ``least_words`` words with another: id, class_id (smallest id reachable
    over shared passages), n_copies (rows with the same words), n_links (passages
    verified with other texts: enough to connect the class), first_word and last_word (of all shared
    passages), n_words.

    Words are runs without blanks, A-Z lower-cased.  Null, blank and shorter
    texts share nothing.  Rows are told apart by location; copies of one text
    are not compared with one another, they share all of it.  class_id is null
    if no row of the class has an id.  An empty table gives no rows.
    """
    located = with_location(docs.select(column(docs, doc_id).alias("id"), column(docs, text)))
    texts, links, found = repeated_passages(located, text, least_words, similar)
    sides = links.select(F.col("a").alias("key"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).union(links.select("b", "b_from", "b_to"))
    by_key = sides.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("least_id"), F.max("n_words").alias("n_words"))
    found = found.withColumnRenamed("node", "key")
    classed = (
        copies.join(by_key, "key", "left")
        .filter(f"n_links is not null or (n_copies > 1 and n_words >= {least_words})")
        .join(found, "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    classed = stage(classed, "passage-classes")
    least = classed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    of = classed.join(least, "root").select(
        "key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_copies") > 1, F.lit(0)).otherwise(F.col("lo")).cast("long").alias("first_word"),
        (F.when(F.col("n_copies") > 1, F.col("n_words")).otherwise(F.col("hi")) - 1).cast("long").alias("last_word"),
    )
    return texts.join(of, "key").select("id", "class_id", "n_copies", "n_links", "first_word", "last_word", F.col("n_words").cast("long").alias("n_words"))


def op7_passages(spark, sf_dir: str) -> DataFrame:
    return passage_classes(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
