"""Jaccard join of documents by their n-grams: a blocked sparse matrix product.

The incidence matrix has a row for each distinct set of shingles and a column for each
shingle. The product of the matrix with its transpose counts shared shingles; it is
computed block by block (a block is the part of the columns that one task of the join
holds), and a pair is discarded as soon as its sizes show that it cannot link:

* Equal sets are one row; their documents are linked without any product.
* Two sets link only if the larger is at most 1.25 times the smaller, and only if they
  share one of the first ``n - ceil(0.8 n) + 1`` shingles in a fixed common order. Only
  these columns enter the product. The order puts shingles that many documents share
  last; which ones is counted over all documents. Any order gives the same links.
* With the places of a shared shingle in both sets, the rest bounds the overlap.
* A sketch, larger for larger sets, bounds from below how many shingles only one of them has.
* Pairs that remain get their exact overlap from the whole sets: first one for each set, then
  those whose sets these links have not connected.

Columns of a few sets give all their pairs. In a column of many sets that would be too
many, and as only components are asked for, links inside a component that is already
connected are not computed there: every set is first compared with a few drawn from its
columns; the sets that are then not in the largest component of a column are compared
with all sets of the column in other components. So no link between components is lost,
and a large group of near copies costs little more than its size.

Shingles are 64-bit hashes and sets have 128-bit names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm import words as W
from postpulse.llm.components import connected_components
from postpulse.llm.storage import discard, fresh, stored, table

WIDTH = 5
PERCENT = 80
# Shingles put last in the common order: at most so many, the most frequent ones.
MAX_FREQUENT = 1 << 17
# A task reports a shingle that it saw in so many of FLUSH_TEXTS documents; of the sums,
# those over one in RARE documents count as frequent.
LOCAL_COUNT = 4
FLUSH_TEXTS = 4096
RARE = 2048
# Words of 64 bits in the sketch of a set, as long as that is two bits for a shingle.
SKETCH = 32
# Columns of up to so many sets give all their pairs at once.
FEW = 64
# Comparisons of a set with others drawn from other columns.
DRAWS = 16


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of all texts of a batch, sorted within each, and their offsets."""
    found = W.find_words(batch.column("text"), W.SPACES)
    shingles, offsets = W.shingle_hashes(found, W.word_hashes(found, W.SPACES), width)
    parts = [np.unique(shingles[offsets[t]:offsets[t + 1]]) for t in range(batch.num_rows)]
    sizes = np.array([len(part) for part in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, W.U64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def _names(flat: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of every set; None for an empty one."""
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        running = np.concatenate(([W.U64(0)], np.cumsum(W.mix(flat ^ W.U64(salt)), dtype=W.U64)))
        sums.append(running[offsets[1:]] - running[offsets[:-1]])
    sizes = np.diff(offsets)
    return [
        struct.pack(">QQ", int(a), int(b) ^ int(n)) if n else None
        for a, b, n in zip(*sums, sizes)
    ]


def _sketches(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For every set, which of its buckets hold an odd number of its shingles.

    A set has ``64 * SKETCH`` buckets, doubled until there are two for each shingle; halves
    of a sketch that are laid on each other give the sketch of half as many buckets. Two
    sketches of one size differ in at most as many buckets as shingles are in one set only.
    """
    sizes = np.diff(offsets)
    words = np.full(len(sizes), SKETCH, np.int64)
    while (small := 32 * words < sizes).any():
        words[small] *= 2
    starts = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = W.mix(flat) & (64 * words[owner] - 1).astype(W.U64)
    packed = np.zeros(starts[-1], W.U64)
    np.bitwise_xor.at(packed, starts[owner] + (bucket >> W.U64(6)).astype(np.int64),
                      W.U64(1) << (bucket & W.U64(63)))
    return _list(packed, starts)


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def frequent_shingles(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The shingles that the most documents share, the most frequent last.

    Tasks report what repeats among the documents they hold; the sums over all tasks
    are cut to ``MAX_FREQUENT`` rows, a megabyte, wherever they come from. They only
    decide the order of columns, never whether a link is found.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())],
                names=["shingle", "n"])

        for batch in batches:
            for chunk in W.chunks(batch):
                held.append(_sets(chunk, width)[0])
                texts += chunk.num_rows
                if texts >= FLUSH_TEXTS or sum(map(len, held)) > 4 << 20:
                    yield flush()
                    held, texts = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "shingle long, n long")
    ranked = counted.groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = ranked.filter(F.col("n") >= max(8, docs.count() // RARE))
    top = ranked.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).collect()
    return np.array([row["shingle"] for row in reversed(top)], np.int64).view(W.U64)


def _prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)


def incidence(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
              ) -> DataFrame:
    """Of every document: ``key``, ``text_hash``, ``n`` (set size), ``node`` (name of the
    set), ``sketch``, and ``columns``, the first shingles in the common order."""
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(frequent_shingles(docs, width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        by_value = np.argsort(late)
        sorted_late = late[by_value]
        for batch in batches:
            for chunk in W.chunks(batch):
                flat, offsets = _sets(chunk, width)
                sizes = np.diff(offsets)
                # Rank among frequent shingles; 0 for all others, which come first.
                rank = np.zeros(len(flat), np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(sorted_late, flat), len(late) - 1)
                    rank = np.where(sorted_late[at] == flat, by_value[at] + 1, 0)
                lengths = _prefix_lengths(sizes, percent)
                parts = []
                for t in range(chunk.num_rows):
                    own = slice(offsets[t], offsets[t + 1])
                    # Stable, so that equal ranks stay in the order of the hashes.
                    order = np.argsort(rank[own], kind="stable")[:lengths[t]]
                    parts.append(flat[own][order])
                kept = np.concatenate(parts) if parts else np.zeros(0, W.U64)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(key), chunk.column("text_hash"), pa.array(sizes, pa.int64()),
                     pa.array(_names(flat, offsets), pa.binary()), _sketches(flat, offsets),
                     _list(kept, np.concatenate(([0], np.cumsum(lengths))))],
                    names=[key, "text_hash", "n", "node", "sketch", "columns"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        rows, f"{key} {kind}, text_hash long, n long, node binary, sketch array<long>, "
              "columns array<long>")


# Bits of the tables of fixed size that filter before a shuffle: 16 MB for shingles and
# 4 MB for keys. When they fill up, more is shuffled and the result stays the same.
SHARED_BITS = 27
KEY_BITS = 25


def _place(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def _marks(places: DataFrame, bits: int) -> np.ndarray:
    """A table with the bit of every ``place`` set, built in blocks of 4 KB."""
    blocks = places.groupBy(F.shiftright("place", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    return _filled(blocks, bits)


def _filled(blocks: DataFrame, bits: int) -> np.ndarray:
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect():
        marks[row["block"] * 4096:row["block"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return marks


def _marked(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _only_marked(frame: DataFrame, place: Column, marks: np.ndarray) -> DataFrame:
    """The rows whose place is marked, without a shuffle."""
    sent = frame.sparkSession.sparkContext.broadcast(marks)
    names = frame.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _marked(sent.value, batch.column(len(names)).to_numpy())
            yield batch.filter(pa.array(hit)).select(list(range(len(names))))

    return frame.select("*", place.alias(*fresh(names, "__place"))).mapInArrow(rows, frame.schema)


def _own_place(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64("node", key), 64 - KEY_BITS)


def _shared_marks(single: DataFrame) -> np.ndarray:
    """The table of fixed size of the shingles that are columns of several sets.

    A task reports the columns that it holds by 44 bits each, in 4 bytes beside the number
    of a block, and those of several of its sets twice; what a block has twice is marked.
    """
    block_bits = SHARED_BITS - 15

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, codes = [], []

        def flush() -> pa.RecordBatch:
            found = np.concatenate(shingles).view(W.U64) >> W.U64(32 - block_bits)
            code = np.concatenate(codes)
            order = np.argsort(found)
            found, code = found[order], code[order]
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            several = np.minimum.reduceat(code, first) < np.maximum.reduceat(code, first)
            found = np.sort(np.concatenate((found[first], found[first][several])))
            block = (found >> W.U64(32)).astype(np.int32)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            ends = np.concatenate((starts, [len(found)])).astype(np.int32) * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(block[starts]), pa.Array.from_buffers(pa.binary(), len(starts), [
                    None, pa.py_buffer(ends), pa.py_buffer(found.astype("<u4"))])],
                names=["block", "held"])

        for batch in batches:
            lists = batch.column("columns")
            shingles.append(lists.flatten().to_numpy())
            codes.append(np.repeat(batch.column("code").to_numpy(), np.diff(lists.offsets.to_numpy())))
            if sum(map(len, shingles)) > 4 << 20:
                yield flush()
                shingles, codes = [], []
        if sum(map(len, shingles)):
            yield flush()

    def twice(rows: pa.Table) -> pa.Table:
        values = np.sort(np.frombuffer(b"".join(rows.column("held").to_pylist()), "<u4"))
        place = values[1:][values[1:] == values[:-1]] >> np.uint32(17)
        bits = np.zeros(4096, np.uint8)
        np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        return pa.table({"block": rows.column("block").slice(0, 1),
                         "bits": pa.array([bits.tobytes()], pa.binary())})

    blocks = single.select(F.xxhash64("node").alias("code"), "columns").mapInArrow(
        held, "block int, held binary").groupBy("block").applyInArrow(twice, "block int, bits binary")
    return _filled(blocks, SHARED_BITS)


def _shared_cells(single: DataFrame) -> DataFrame:
    """``shingle``, ``node``, ``n`` and ``at`` of the cells whose column has several ``sets``.
    Copies of a set count once.

    The table of fixed size spares most other cells from the shuffle.
    """
    sent = single.sparkSession.sparkContext.broadcast(_shared_marks(single))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            lists = batch.column("columns")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = _marked(marks, (flat.view(W.U64) >> W.U64(64 - SHARED_BITS)).astype(np.int64))
            index = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[hit]), batch.column("node").take(index),
                 batch.column("n").take(index), pa.array(at[hit])],
                names=["shingle", "node", "n", "at"])

    cells = single.select("n", "node", "columns").mapInArrow(
        rows, "shingle long, node binary, n long, at long")
    # One shuffle, by column, serves both counts.
    cells = cells.repartition("shingle").groupBy("shingle", "node").agg(
        F.min("n").alias("n"), F.min("at").alias("at"))
    return cells.withColumn("sets", F.count("*").over(Window.partitionBy("shingle"))).filter("sets > 1")


def whole_sets(docs: DataFrame, owners: DataFrame, key: str, width: int) -> DataFrame:
    """``node`` and its whole ``shingles`` of the documents whose key is in ``owners``.

    A table of fixed size tells which documents to hash again; a few others pass it. A
    task returns a set once, so several rows of a node are possible.
    """
    places = owners.select(_place(F.col(key), KEY_BITS).alias("place"))
    sent = docs.sparkSession.sparkContext.broadcast(_marks(places, KEY_BITS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = sent.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(_marked(marks, batch.column("place").to_numpy())))
            for chunk in W.chunks(batch):
                flat, offsets = _sets(chunk, width)
                names = _names(flat, offsets)
                new = []
                for t, name in enumerate(names):
                    if name is not None and name not in seen:
                        new.append(t)
                        seen.add(name)
                nodes = pa.array([names[t] for t in new], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [nodes, _list(flat, offsets).take(pa.array(new, pa.int32()))],
                    names=["node", "shingles"])

    return docs.select("text", _place(F.col(key), KEY_BITS).alias("place")).mapInArrow(
        rows, "node binary, shingles array<long>")


def _sizes_allow(percent: int) -> Column:
    n, m = F.col("x.n"), F.col("y.n")
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _places_allow(percent: int) -> Column:
    """Whether what follows a shared shingle in both sets still allows a link.

    True for the first shared shingle in the common order of every pair that links.
    """
    n, m = F.col("x.n"), F.col("y.n")
    rest = F.least(n - F.col("x.at"), m - F.col("y.at"))
    return (100 + percent) * rest >= percent * (n + m)


def _halved(sketch: Column) -> Column:
    half = F.shiftright(F.size(sketch), 1)
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half),
                      lambda low, high: low.bitwiseXOR(high))


def _similar_sketches(percent: int) -> Column:
    """Whether the sketches allow a link: linked sets of n and m shingles differ in at
    most ``(n + m) (100 - percent) / (100 + percent)``."""
    u, v = F.col("u"), F.col("v")
    # Sizes of sets that may link are so near that few halvings make sketches equally long.
    for _ in range((100 // percent).bit_length()):
        u, v = (F.when(F.size(x) > F.size(y), _halved(x)).otherwise(x) for x, y in ((u, v), (v, u)))
    apart = F.aggregate(
        F.zip_with(u, v, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0),
        lambda total, count: total + count)
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose whole sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    counted = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"),
                          F.size(F.array_intersect("x", "y")).alias("shared"))
    return counted.filter(100 * F.col("shared") >= percent * (
        F.col("n") + F.col("m") - F.col("shared"))).select("a", "b")


def _few_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """All pairs of columns with few sets."""
    few = cells.filter(F.col("sets") <= FEW).select(
        "shingle", F.struct("node", "n", "at").alias("x"))
    return few.join(few.withColumnRenamed("x", "y"), "shingle").filter(
        (F.col("x.node") < F.col("y.node")) & _places_allow(percent))


def _open_cells(cells: DataFrame, components: DataFrame) -> DataFrame:
    """The cells of columns with sets of several components, and their component."""
    held = cells.join(components.select("node", "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    mixed = held.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter("low <> high").select("shingle")
    return held.join(mixed, "shingle", "left_semi")


_CELL = ("node", "n", "at", "component")


def _drawn_pairs(cells: DataFrame, salt: int) -> DataFrame:
    """Every set in columns of many with at most ``DRAWS`` others, one drawn in each of its
    columns."""
    held = cells.filter(F.col("sets") > FEW)
    draw = F.xxhash64("node", "shingle", F.lit(salt)).alias("draw")
    leaders = held.groupBy("shingle").agg(F.min(F.struct(draw, "node", "n", "at")).alias("y"))
    paired = held.join(leaders, "shingle").filter(F.col("node") != F.col("y.node"))
    # Ranks count distinct others; a set has no more rows here than columns.
    order = Window.partitionBy("node").orderBy(F.xxhash64("y.node"), "y.node")
    return paired.withColumn("rank", F.dense_rank().over(order)).filter(
        F.col("rank") <= DRAWS).select(
            F.struct("node", "n", "at").alias("x"), F.struct("y.node", "y.n", "y.at").alias("y"))


def _all_pairs_outside(held: DataFrame, percent: int) -> DataFrame:
    """Sets outside the largest component of a column with all of other components."""
    sizes = held.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("shingle").agg(
        F.max(F.struct("size", "component")).alias("m")).select(
            "shingle", F.col("m.component").alias("main"))
    outside = held.join(main, "shingle").filter(F.col("component") != F.col("main")).select(
        "shingle", F.struct(*_CELL).alias("x"), "main")
    paired = outside.join(held.select("shingle", F.struct(*_CELL).alias("y")), "shingle")
    return paired.filter(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
        & _places_allow(percent))


def links(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
          ) -> tuple[DataFrame, DataFrame]:
    """The rows of the matrix, and the components of the sets that link to another.

    Result: the columns of ``incidence``; ``node`` and ``component``. Sets that link to
    none are not in the second.
    """
    matrix = stored(incidence(docs, key, width, percent), "incidence")
    # One document of each set; a few of its copies pass the marks as well.
    named = matrix.filter(F.col("node").isNotNull())
    firsts = stored(named.groupBy("node").agg(F.min(key).alias(key)), "firsts")
    own = _marks(firsts.select(_own_place(key).alias("place")), KEY_BITS)
    single = _only_marked(named.select(key, "node", "n", "columns"), _own_place(key), own)
    cells = stored(_shared_cells(single), "cells")

    def found(paired: DataFrame) -> DataFrame:
        """Links among candidates that connect all that the linked ones connect."""
        pairs = paired.filter(_sizes_allow(percent)).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
        ).distinct()
        met = stored(pairs, "met")
        nodes = met.select(F.col("a").alias("node")).union(met.select("b"))
        wanted = _marks(nodes.select(_place(F.col("node"), KEY_BITS).alias("place")), KEY_BITS)
        sketches = _only_marked(named.select(key, "node", "n", "sketch"), _own_place(key), own)
        sketches = _only_marked(sketches.select("node", "n", "sketch"),
                                _place(F.col("node"), KEY_BITS), wanted)
        pairs = met
        for side, sketch, size in (("a", "u", "n"), ("b", "v", "m")):
            pairs = pairs.join(sketches.select(
                F.col("node").alias(side), F.col("sketch").alias(sketch),
                F.col("n").alias(size)), side)
        pairs = stored(pairs.filter(_similar_sketches(percent)).select("a", "b").distinct(), "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        owners = firsts.join(nodes, "node", "left_semi")
        sets = stored(whole_sets(docs, owners, key, width), "sets")
        # Near copies meet many times: a pair for each set comes first.
        one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        linked = stored(_linked(one, sets, percent), "links")
        joined = connected_components(linked)
        rest = pairs
        for side in ("a", "b"):
            rest = rest.join(joined.select(F.col("node").alias(side), F.col("component").alias(
                f"of_{side}")), side, "left")
        rest = stored(rest.join(one, ["a", "b"], "left_anti").filter(
            F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "rest")
        nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
        more = stored(_linked(rest, sets.join(nodes, "node", "left_semi"), percent), "links")
        both = stored(linked.union(more), "links")
        discard(met, pairs, sets, linked, joined, rest, more)
        return both

    first = _few_pairs(cells, percent).select("x", "y").union(
        _drawn_pairs(cells, 0)).union(_drawn_pairs(cells, 1))
    linked = found(first)
    components = connected_components(linked)
    discard(linked)
    held = stored(_open_cells(cells.filter(F.col("sets") > FEW), components), "open-cells")
    if not held.isEmpty():
        # What is connected already counts as links to the component's smallest node.
        linked, before = found(_all_pairs_outside(held, percent)), components
        components = connected_components(linked.union(before.select("node", "component")))
        discard(linked, before)
    discard(held, cells, firsts)
    return matrix, components


def _components(docs: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """``jaccard_components`` with ``component``, the component's own name, which no other
    component has, whatever the keys are. It is null for documents without words."""
    matrix, components = links(docs, key, width, percent)
    named = matrix.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias("low"))
    grouped = named.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    by_node = grouped.join(lowest, "component").select("node", "component", "component_id")
    by_node = stored(by_node, "by-node")
    return matrix.join(by_node, "node", "left").select(
        key, F.col("n").alias("n_shingles"), "text_hash",
        F.coalesce("component_id", F.when(F.col("node").isNull(), F.col(key))).alias("component_id"),
        F.col("component").alias("__component"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every document.

    Words are what lies between ASCII spaces, A-Z lower-cased; a document's set are its
    distinct runs of ``width`` words, or all its words if they are fewer. Documents
    link when the sets' Jaccard similarity is at least ``percent`` hundredths.
    ``component_id`` is the smallest key reachable by links.

    Null and empty texts, and texts of spaces, have an empty set, link with nothing and
    are their own component. Repeated rows are documents of their own with equal sets;
    a null key never names a component of documents with keys. Other columns are ignored.
    """
    return _components(docs, key, width, percent).drop("__component")


def representatives(docs: DataFrame, key: str = "doc_id", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: the one that names it.

    Components are told apart by their own name: those whose documents have no key or
    the key of others keep one document as well. Of repeated rows one stays. Documents
    without words are components of their own.
    """
    found = _components(docs, key, width, percent)
    own_key, own_hash, row_hash, row = fresh(
        docs.columns, "__key", "__text_hash", "__row_hash", "__row")
    wordless = F.col("n_shingles") == 0
    chosen = found.groupBy(
        "__component", F.when(wordless, F.col(key)).alias("__own"),
        F.when(wordless, F.col("text_hash")).alias("__empty"),
    ).agg(F.min(F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"),
                         "text_hash")).alias("__first")).select(
        F.col("__first.key").alias(own_key), F.col("__first.text_hash").alias(own_hash))
    rows = docs.withColumn(row_hash, F.xxhash64("text"))
    kept = rows.join(chosen.distinct(), rows[key].eqNullSafe(F.col(own_key))
                     & (F.col(row_hash) == F.col(own_hash)), "left_semi")
    order = Window.partitionBy(key, row_hash).orderBy(F.lit(1))
    return kept.withColumn(row, F.row_number().over(order)).filter(
        F.col(row) == 1).select(*[F.col(f"`{name}`") for name in docs.columns])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash")
