"""Merkle manifest of a table: a root per group and over all groups, and a proof per row.

Every group is a tree over its rows in a given order; a node is the SHA-256 of up to eight
nodes below. Nodes are numbered in their group, and each aligned block of ``8 ** levels``
nodes keeps a level as one hex string: fixed-width substrings of it are hashed into the
next level, and the substrings on both sides of a node in its run are its siblings. The
roots of the blocks are the nodes of the next tier, and so on until each group has one
node. These, in the order of their groups, are the nodes of one more tree.

Numbers come from a sort by ranges: rows are counted per group and range, and what comes
before a range is added to the place inside it. So no task sees a whole group; a block has
a fixed size, and equal rows are spread by a number that only tells them apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm.storage import stored, table

FAN = 8
HEX = 64
LEVELS = 4
MAX_LEVELS = 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STEP = "struct<before:string,after:string>"


def hashed(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of a row: its fields one after another, ``-`` for null, else bytes, ``:``, value."""
    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))

    return hashed(F.concat(*map(written, fields)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, start, lambda node, step: hashed(
        F.concat(step["before"], node, step["after"])))


def proof_text(path: Column) -> Column:
    """All siblings, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


# --- numbers ------------------------------------------------------------------
def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``number``, the place of a row in its group from 0, and ``size`` of the group.

    ``rows`` must be a stored table: its rows get numbers that tell equal ones apart.
    """
    ordered = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    told = rows.withColumn("apart", F.monotonically_increasing_id())
    ranged = stored(
        told.repartitionByRange(*ordered, F.col("apart")).sortWithinPartitions(*ordered, "apart")
        .drop("apart").withColumn("place", F.monotonically_increasing_id())
        .withColumn("range", F.spark_partition_id()), "merkle-sorted")
    # A row per range and group; the window of a group has a row per range.
    parts = ranged.groupBy("range", F.col(group).alias("of")).agg(
        F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("of")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("range").alias("in_range"), "of", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("size"))
    return ranged.join(
        parts, (F.col("range") == F.col("in_range")) & F.col(group).eqNullSafe(F.col("of"))
    ).withColumn("number", F.col("before") + F.col("place") - F.col("first")).drop(
        "range", "place", "in_range", "of", "first", "before")


# --- blocks -------------------------------------------------------------------
def _height(size: Column) -> Column:
    """The levels above the leaves of a tree of so many."""
    return sum((F.when(size > FAN ** k, 1).otherwise(0) for k in range(MAX_LEVELS)), F.lit(0))


def _above(level: Column) -> Column:
    """The next level of a block, as one string, from the runs of this one."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (FAN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: hashed(
        F.substring(level, r * FAN * HEX + 1, F.lit(FAN * HEX)))), "").cast("binary")


def _siblings(level: Column, node: Column) -> Column:
    """The substrings of a level on both sides of a node in its run."""
    start = F.floor(node / FAN).cast("int") * FAN
    return F.struct(
        F.substring(level, start * HEX + 1, (node - start) * HEX).cast("string").alias("before"),
        F.substring(level, (node + 1) * HEX + 1, (start + FAN - 1 - node) * HEX)
        .cast("string").alias("after"))


def blocks(nodes: DataFrame, group: str, carried: Sequence[str], done: int, levels: int
           ) -> DataFrame:
    """A row per aligned block: its members in order, its levels, and its root.

    ``nodes`` has ``group``, ``number``, ``size`` of the whole tree, ``node`` and what the
    members carry. ``done`` levels lie below. Levels are strings of ASCII kept as binary,
    of which substrings are cut without walking over what is before.
    """
    width = FAN ** levels
    made = nodes.groupBy(
        group, F.floor(F.col("number") / width).cast("long").alias("block")).agg(
        F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("number", "node", *carried))).alias("members"))
    rest = F.least(F.lit(levels), F.greatest(F.lit(0), _height(F.col("size")) - done))
    made = made.withColumn("rest", rest).withColumn(
        "level0", F.array_join(F.col("members.node"), "").cast("binary"))
    for k in range(levels):
        made = made.withColumn(f"level{k + 1}", F.when(
            F.col("rest") > k, _above(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    return made.withColumn("root", F.col(f"level{levels}").cast("string")).drop(f"level{levels}")


def _members(made: DataFrame, group: str, carried: Sequence[str], levels: int) -> DataFrame:
    """The members of the blocks with the siblings inside the block and above it, ``path``.

    Siblings are cut inside the row of the block, so that no member's row holds the levels.
    """
    def placed(member: Column, at: Column) -> Column:
        steps = [F.when(F.col("rest") > k, _siblings(
            F.col(f"level{k}"), F.floor(at / FAN ** k).cast("int"))) for k in range(levels)]
        inside = F.filter(F.array(*steps).cast(f"array<{STEP}>"), lambda s: s.isNotNull())
        return F.struct(
            member["number"].alias("number"), member["node"].alias("node"),
            *[member[c].alias(c) for c in carried], F.concat(inside, F.col("upper")).alias("path"))

    return made.select(group, "above", F.inline(F.transform("members", placed)))


@dataclass
class Tree:
    """The tiers of blocks of all groups, and the root of each."""

    group: str
    carried: Sequence[str]
    levels: int
    tiers: list[DataFrame]
    roots: DataFrame

    def paths(self, above: DataFrame) -> DataFrame:
        """Every row with ``path``, its siblings up to the root of its group and beyond.

        ``above`` has for each group ``of``, ``upper``, the siblings over its root, and
        ``above``, which comes with every row. It is joined with the few blocks of the last
        tier, and each tier with the one over it, so rows are not shuffled.
        """
        found = self.tiers[-1].join(above, F.col(self.group).eqNullSafe(F.col("of"))).drop("of")
        for below, made in zip(reversed(self.tiers[:-1]), reversed(self.tiers[1:]), strict=True):
            upper = _members(found, self.group, (), self.levels).select(
                F.col(self.group).alias("of"), F.col("number").alias("of_block"),
                F.col("path").alias("upper"), "above")
            found = below.join(upper, (F.col("block") == F.col("of_block"))
                               & F.col(self.group).eqNullSafe(F.col("of"))).drop("of", "of_block")
        return _members(found, self.group, self.carried, self.levels)


def grow(rows: DataFrame, group: str, order: Sequence[str], node: str,
         carried: Sequence[str] = (), levels: int = LEVELS) -> Tree:
    """The tree of every group over ``node``; ``rows`` must be a stored table."""
    frame = rows.select(group, *dict.fromkeys([*order, *carried]), F.col(node).alias("node"))
    nodes = numbered(frame, group, order)
    tiers: list[DataFrame] = []
    while True:
        made = stored(blocks(nodes, group, carried if not tiers else (), levels * len(tiers),
                             levels), "merkle-blocks")
        tiers.append(made)
        # One number: whether a group still has several blocks.
        if not made.filter(F.col("block") > 0).take(1):
            break
        nodes = made.select(group, F.col("block").alias("number"), "size",
                            F.col("root").alias("node"))
    return Tree(group, carried, levels, tiers, tiers[-1].select(group, "root"))


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: Sequence[str],
             tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``group``, ``order``, ``leaf``, ``subroot``, ``root`` and ``path`` of every row.

    ``fields`` make the leaf; ``order`` ranks the rows of a group, null first and equal
    ones by leaf. Rows equal in all of it have the same leaf and each its own place. With
    ``tampered``, other contents by field, ``tampered`` is the leaf that these would have.
    ``path`` holds the siblings before and after a row, level by level up to ``root``. A
    null group is one of its own, before the others. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    change = tampered or {}
    leaves = stored(docs.select(
        F.col(group).alias("of_group"),
        *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)],
        leaf([F.col(c) for c in fields]).alias("leaf"),
        leaf([change.get(c, F.col(c)) for c in fields]).alias("tampered")), "merkle-leaves")
    keys = [f"by_{i}" for i in range(len(order))]
    lower = grow(leaves, "of_group", [*keys, "leaf"], "leaf", [*keys, "tampered"], levels)
    roots = stored(lower.roots.select(F.lit(0).alias("all"), "of_group", "root"), "merkle-roots")
    upper = grow(roots, "all", ["of_group"], "root", ["of_group"], levels)
    none = F.array().cast(f"array<{STEP}>")
    top = upper.roots.select(F.col("all").alias("of"), none.alias("upper"), F.col("root").alias("above"))
    over = upper.paths(top).select(
        F.col("of_group").alias("of"), F.col("path").alias("upper"),
        F.struct(F.col("node").alias("subroot"), F.col("above").alias("root")).alias("above"))
    found = lower.paths(over)
    return found.select(
        F.col("of_group").alias(group), *[F.col(k).alias(c) for k, c in zip(keys, order, strict=True)],
        F.col("node").alias("leaf"), "tampered", "above.subroot", "above.root", "path")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(touched, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    proven = manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", ["doc_id"],
                      {"text": changed})
    ended = proven.withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return ended.select(
        "doc_id", "leaf", "subroot", "root", hashed(proof_text(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
