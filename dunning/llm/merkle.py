"""Merkle manifest of a table: one hash tree for each group of rows, one root.

Rows become leaves; the leaves of a group (language) ascend by id, every eight
consecutive nodes become their parent's hash, and the groups' subroots are the
leaves of a last tree of the same shape.

Leaf coordinates come from bitmaps, not from sorting:

1. Ids are bits of 64-bit words.  Map tasks build words of what they see, the
   shuffle merges them with ``bit_or``; empty words are not stored.  Ids that
   repeat are kept beside their word (at most 64 of them).
2. A directory holds the population counts before each word: prefix sums among
   at most 4096 siblings, on as many levels as the ids need.  No window spans a
   group.
3. A row's rank query asks its word: what the directory has before the word
   plus the bits below the row's own.

Then nodes are keyed by (group, slot // 8), gathered to an array of at most
eight slots and hashed, level by level; each level is written to the shared
folder.  Proofs go down the same arrays: a node's path is its siblings in
front of its parent's path.

All of it is DataFrame functions; the largest group that any task holds has
4096 rows of a directory or eight nodes, whatever the groups' sizes.

Defined results: null ids come first in their group, then ids as signed
integers; rows of one id ascend by leaf hash; equal rows take consecutive
slots (which of them has which cannot be told apart).  A null group is a group
of its own, before all others.  Null fields hash as ``-``, an empty text as
``0:``.  A lone leaf is its group's subroot and a lone subroot the root.  An
empty table gives no rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read_table, stage

#: Nodes that become one.
ARITY = 8
#: Directory fan-out: children of a node as a power of two.
FAN = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded_field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded_field(f) for f in fields]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _node_hash(kids: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(kids, hex_text), ""), 256))


# --- ranks from bitmaps ------------------------------------------------------


def prefix_counts(rows: DataFrame, group: list[str], key: str, n: str) -> DataFrame:
    """``rows`` (distinct by ``group`` and the long ``key``) with ``before``,
    the sum of ``n`` over smaller keys of the group, and ``total``, over all.

    Keys are grouped by their upper bits, 4096 children to a node, until each
    group is one node; windows run among siblings only.
    """
    levels = [rows]
    while True:
        above = levels[-1].withColumn("above", F.shiftright(key, FAN))
        up = stage(above.groupBy(*group, F.col("above").alias(key)).agg(F.sum(n).alias(n)), "directory")
        # done when every group is one node; signed keys end at -1 and 0, which two windows of one level hold
        wide = up.groupBy(*group).agg(F.max(key).alias("hi"), F.min(key).alias("lo")).filter("hi > 0 OR lo < -1").limit(1).count()
        levels.append(up)
        if not wide:
            break
    top = Window.partitionBy(*group)
    out = levels[-1].select(
        *group,
        F.col(key).alias("above"),
        F.coalesce(F.sum(n).over(top.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("upper"),
        F.sum(n).over(top).cast("long").alias("total"),
    )
    for rows in levels[-2::-1]:
        siblings = Window.partitionBy(*group, "above").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        own = rows.withColumn("above", F.shiftright(key, FAN)).withColumn("within", F.coalesce(F.sum(n).over(siblings), F.lit(0)))
        joined = own.join(out, [*group, "above"])
        out = joined.select(*rows.columns, (F.col("upper") + F.col("within")).cast("long").alias("before"), "total")
        if rows is not levels[0]:
            out = out.select(*group, F.col(key).alias("above"), F.col("before").alias("upper"), "total")
    return out


def with_slots(leaves: DataFrame) -> DataFrame:
    """Leaves (``k``, ``known``, ``id``, ``leaf``, ...) with ``slot``, their
    place in group ``k``, and ``n``, the group's number of leaves."""
    others = [c for c in leaves.columns if c not in ("k", "known", "id", "leaf")]
    # equal rows once, with their number: repeats are added up before the shuffle
    once = stage(leaves.groupBy("k", "known", "id", "leaf", *others).agg(F.count(F.lit(1)).alias("copies")), "leaves")
    # k and known in one group key, unknown ids first: one directory holds both
    word, bit = F.shiftright("id", 6), F.col("id").bitwiseAND(63)
    ids = once.groupBy("k", "known", "id").agg(F.sum("copies").alias("m"))
    one = F.lit(1).cast("long")
    words = ids.groupBy("k", "known", word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, bit.cast("int"))).alias("bits"),
        F.sum("m").alias("m"),
        F.collect_list(F.when(F.col("m") > 1, F.struct(bit.alias("bit"), (F.col("m") - 1).alias("more")))).alias("repeats"),
    )
    words = stage(words, "words")
    ranked = prefix_counts(words, ["k", "known"], "word", "m")
    unknown = ranked.filter("NOT known").select("k", F.col("total").alias("unknown"))  # a row for each group with null ids
    known = ranked.filter("known").select("k", F.col("total").alias("named")).distinct()
    sizes = known.join(unknown, "k", "full").select("k", F.coalesce("unknown", F.lit(0)).alias("unknown"), F.coalesce("named", F.lit(0)).alias("named"))
    # the sizes are added to the words, a small table, so that no row is ever joined on its group
    ranked = stage(
        ranked.join(sizes, "k").select(
            "k", "known", "word", "bits", "repeats", (F.col("before") + F.when(F.col("known"), F.col("unknown")).otherwise(0)).alias("before"), (F.col("unknown") + F.col("named")).alias("n")
        ),
        "ranks",
    )
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit.cast("int")))))
    more = F.aggregate(F.filter("repeats", lambda r: r["bit"] < bit), F.lit(0).cast("long"), lambda s, r: s + r["more"])
    here = F.exists("repeats", lambda r: r["bit"] == bit)
    rows = once.withColumn("word", word).join(ranked, ["k", "known", "word"])
    rows = rows.select("k", "id", "known", "leaf", *others, "copies", "n", (F.col("before") + below + more).cast("long").alias("slot"), here.alias("repeated"))
    # ids with several rows: the same directory again, over the first 64 bits of the leaf hashes
    rows = stage(rows, "ranked")
    lone, several = rows.filter("NOT repeated"), rows.filter("repeated")
    head = F.conv(F.hex(F.substring("leaf", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    of = ["k", "known", "id"]
    several = several.withColumn("head", head)
    heads = stage(several.groupBy(*of, "head").agg(F.sum("copies").alias("m")), "heads")
    if not heads.isEmpty():
        at = prefix_counts(heads, of, "head", "m").select(*of, "head", F.col("before").alias("first"))
        ties = Window.partitionBy(*of, "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.col("first") + F.coalesce(F.sum("copies").over(ties), F.lit(0))
        several = several.join(at, [*of, "head"]).withColumn("slot", F.col("slot") + offset)
        several = several.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1)))
        lone = lone.unionByName(several.select(lone.columns))
    return lone.drop("copies", "repeated")


# --- levels ------------------------------------------------------------------


def reduce_levels(nodes: DataFrame, carried: Column | None = None) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: ``k``, ``slot``, ``n`` and ``digest``, with slots 0 to n - 1
    in each group.  Returns the arrays of each level (``k``, ``parent``,
    ``kids`` of at most eight in slot order, ``carried`` beside the digests on
    the first level) and each group's last node (``k``, ``digest``)."""
    levels, last = [], [nodes.filter("n = 1").select("k", "digest")]
    while True:
        kid = F.struct((F.col("slot") % ARITY).alias("at"), "digest", *([carried.alias("carried")] if carried is not None and not levels else []))
        # n tells nothing new about the group, it only has to come along
        group = nodes.filter("n > 1").groupBy("k", F.expr(f"slot div {ARITY}").alias("parent"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        arrays = group.agg(F.array_sort(F.collect_list(kid), lambda a, b: (a["at"] - b["at"]).cast("int")).alias("kids"))
        arrays = stage(arrays.withColumn("digest", _node_hash(F.transform("kids", lambda x: x["digest"]))), "level")
        if arrays.isEmpty():
            break
        levels.append(arrays)
        nodes = arrays.select("k", F.col("parent").alias("slot"), "n", "digest")
        last.append(nodes.filter("n = 1").select("k", "digest"))
    return levels, reduce(DataFrame.unionAll, last)


def spread_paths(levels: list[DataFrame], ends: DataFrame, carried: bool = False) -> DataFrame:
    """From each group's last node (``k``, ``path``, ``subroot``) down to all
    nodes of the first level: ``k``, ``slot``, ``digest``, ``path``.  A path is
    an array, lowest level first, of the hashes ``left`` and ``right`` of the
    node among its siblings."""
    down = None
    for j in range(len(levels) - 1, -1, -1):
        arrays = levels[j]
        tops = ends.join(arrays.filter("n = 1").select("k"), "k").select("k", F.lit(0).cast("long").alias("parent"), "path", "subroot")
        above = tops if down is None else tops.unionByName(down.select("k", F.col("slot").alias("parent"), "path", "subroot"))
        if down is not None:
            above = stage(above, "paths")
        kids = arrays.withColumn("hashes", F.transform("kids", lambda x: x["digest"])).join(above, ["k", "parent"])
        one = kids.select("k", "parent", "hashes", "path", "subroot", F.explode("kids").alias("kid"))
        at = F.col("kid")["at"].cast("int")
        beside = F.struct(F.slice("hashes", F.lit(1), at).alias("left"), F.slice("hashes", at + 2, F.lit(ARITY)).alias("right"))
        down = one.select(
            "k",
            (F.col("parent") * ARITY + at).alias("slot"),
            F.col("kid")["digest"].alias("digest"),
            F.concat(F.array(beside), "path").alias("path"),
            "subroot",
            *([F.col("kid")["carried"].alias("carried")] if carried and j == 0 else []),
        )
    return down


def merkle_manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields=FIELDS, keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``group``, ``slot`` (place in
    its group's tree), ``leaf``, ``path`` (siblings on the way up, lowest level
    first, as arrays ``left`` and ``right``), ``subroot``, ``root`` (digests as
    binary) and what ``keep`` names.  ``id`` is an integer column.
    """
    of = {f: column(docs, f) for f in fields}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), column(docs, group).cast("string")), F.lit("")).alias("k"),
        column(docs, id).isNotNull().alias("known"),
        F.coalesce(column(docs, id).cast("long"), F.lit(0).cast("long")).alias("id"),
        leaf_hash(list(of.values())).alias("leaf"),
        *[c.alias(f"keep_{name}") for name, c in (keep or {}).items()],
    )
    rows = with_slots(leaves)
    kept = [f"keep_{name}" for name in keep or {}]
    rows = stage(rows.withColumnRenamed("leaf", "digest"), "slots")
    levels, ends = reduce_levels(rows, F.struct("known", "id", *kept))
    ends = stage(ends, "subroots")
    # the subroots' own tree: as many leaves as the table has groups
    order = Window.orderBy("k")
    tree = ends.select(F.lit("").alias("k"), (F.row_number().over(order) - 1).cast("long").alias("slot"), "digest", F.col("k").alias("of"))
    tree = stage(tree.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))), "subroots")
    upper, root = reduce_levels(tree, F.col("of"))
    found = root.first()
    top = F.lit(bytes(found["digest"]) if found else None).cast("binary")
    nothing = F.expr("cast(array() as array<struct<left:array<binary>,right:array<binary>>>)")
    if upper:
        paths = spread_paths(upper, root.select("k", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot")), carried=True)
        ends = paths.select(F.col("carried").alias("k"), "path", F.col("digest").alias("subroot"))
    else:
        ends = ends.select("k", nothing.alias("path"), F.col("digest").alias("subroot"))
    ends = stage(ends, "paths")
    lone = rows.filter("n = 1").join(ends, "k").select("k", "slot", "digest", "path", "subroot", F.struct("known", "id", *kept).alias("carried"))
    out = spread_paths(levels, ends, carried=True).unionByName(lone) if levels else lone
    return out.select(
        F.when(F.col("carried")["known"], F.col("carried")["id"]).alias(id),
        F.when(F.col("k") != "", F.expr("substring(k, 2)")).alias(group),
        "slot",
        F.col("digest").alias("leaf"),
        "path",
        "subroot",
        top.alias("root"),
        *[F.col("carried")[c].alias(c.removeprefix("keep_")) for c in kept],
    )


def proof_hash(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    each = F.transform(path, lambda e: F.concat(F.array_join(F.transform(e["left"], hex_text), ""), F.array_join(F.transform(e["right"], hex_text), "")))
    return F.sha2(F.array_join(each, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf and its siblings give."""

    def up(hash: Column, e: Column) -> Column:
        return F.sha2(F.concat(F.array_join(F.transform(e["left"], hex_text), ""), hash, F.array_join(F.transform(e["right"], hex_text), "")), 256)

    return F.aggregate(path, hex_text(leaf), up)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; every third one is tampered with, and must
    no longer fold to the root if that changed its text."""
    docs = read_table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = {f: column(docs, f) for f in FIELDS}
    changed = leaf_hash([F.translate(c, upper, lower) if f == "text" else c for f, c in of.items()])
    hit = F.crc32(of["doc_id"].cast("string").cast("binary")) % 3 == 0
    held = merkle_manifest(docs, keep={"changed": F.when(hit, changed)})
    now = folded(F.coalesce("changed", "leaf"), F.col("path"))
    return held.select(
        "doc_id",
        hex_text(F.col("leaf")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        proof_hash(F.col("path")).alias("proof_sha256"),
        now.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
