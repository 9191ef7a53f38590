"""Benchmark decontamination by greedy string tiling.

Texts are words (ASCII letters and digits and everything outside ASCII, A-Z lowered).
A tile is a run of at least ``least`` words that a document and a benchmark item share;
tiles never overlap in either. Longest first, running Karp-Rabin hashes find them, so
passages are also found when their parts come in another order or with other words in
between. A document is contaminated by an item when tiles cover at least ``coverage``
of the item's words.

1. Every run of ``least`` words of the benchmark marks a bit in a table of fixed size
   (4 MB). Tasks pass their documents once and keep only stretches of words whose runs
   are all marked: nothing else can be in a tile. Clean text is not shuffled at all.
2. Seeds, the runs of these stretches, are joined with those of the items by their
   words. Pairs whose seeds cannot cover enough of the item are dropped.
3. The remaining pairs get their stretches and the item's words and are tiled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import words as W
from postpulse.llm.storage import stored, table

LEAST = 5
COVERAGE = 0.6
MARK_BITS = 25
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


# --- running Karp-Rabin greedy string tiling ----------------------------------
def _run_hashes(ids: list[int], length: int, free: list[bool]) -> Iterator[tuple[int, int]]:
    """(start, hash) of all runs of ``length`` words that are free, hashed in one pass."""
    high = pow(_BASE, length, _MODULUS)
    value = unbroken = 0
    for i, word in enumerate(ids):
        if not free[i]:
            value = unbroken = 0
            continue
        value = (value * _BASE + word) % _MODULUS
        unbroken += 1
        if unbroken > length:
            value = (value - ids[i - length] * high) % _MODULUS
        if unbroken >= length:
            yield i - length + 1, value


def _matches(item: list[int], doc: list[int], length: int, free_item: list[bool],
             free_doc: list[bool]) -> list[tuple[int, int, int]]:
    """(words, start in item, start in doc) of matches of at least ``length`` words."""
    starts = defaultdict(list)
    for at, value in _run_hashes(doc, length, free_doc):
        starts[value].append(at)
    found = []
    for i, value in _run_hashes(item, length, free_item):
        for j in starts.get(value, ()):
            # Not the first words of the match: it was found from the word before.
            if i and j and free_item[i - 1] and free_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue
            n = 0
            while (i + n < len(item) and j + n < len(doc) and free_item[i + n]
                   and free_doc[j + n] and item[i + n] == doc[j + n]):
                n += 1
            if n >= length:
                found.append((n, i, j))
    return found


def greedy_tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words), longest first; ties from the left.

    Negative numbers in ``doc`` are gaps and match nothing. The search length falls
    from long to ``least``; matches of a length round are marked longest first, and a
    match that lost words to a longer one is looked for again in a later round.
    """
    free_item = [True] * len(item)
    free_doc = [word >= 0 for word in doc]
    tiles, length = [], max(least, len(item) // 2)
    while True:
        again = False
        found = _matches(item, doc, length, free_item, free_doc)
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            whole = all(free_item[i:i + n]) and all(free_doc[j:j + n])
            if not whole:
                again = True
                continue
            free_item[i:i + n] = [False] * n
            free_doc[j:j + n] = [False] * n
            tiles.append((i, j, n))
        if not found or not again:
            if length == least:
                return tiles
            length = max(least, length // 2)


# --- stretches of documents ---------------------------------------------------
def _items(benchmark: DataFrame, item: str, least: int) -> DataFrame:
    """The words of every item that has at least ``least``."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return benchmark.select(F.col(item), found.alias("words")).filter(
        F.size("words") >= least).distinct()


def _runs(words: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of the words of texts, and the word each starts at."""
    found = W.find_words(words, W.NOT_ALPHANUMERIC)
    hashes = W.sequence_hashes(W.word_hashes(found, W.NOT_ALPHANUMERIC), least)
    owner = found.owner()
    inside = owner[:len(hashes)] == owner[least - 1:] if len(hashes) else np.zeros(0, bool)
    return hashes, inside, found


def marks_of(benchmark: DataFrame, least: int) -> np.ndarray:
    """A bit for the hash of every run of words of the benchmark: always 4 MB."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                hashes, inside, _ = _runs(chunk.column("text"), least)
                places = np.unique(hashes[inside] >> W.U64(64 - MARK_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    blocks = benchmark.select("text").mapInArrow(rows, "place long").groupBy(
        F.shiftright("place", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    marks = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    for row in blocks.collect():  # at most 1,024 blocks of 4 KB
        marks[row["block"] * 4096:row["block"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return marks


def stretches(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """``doc`` (a row's own name), ``start`` and ``words`` of every stretch of a document
    in which all runs of ``least`` words may occur in the benchmark."""
    marks_sent = docs.sparkSession.sparkContext.broadcast(marks_of(benchmark, least))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_sent.value
        for batch in batches:
            for chunk in W.chunks(batch):
                hashes, inside, found = _runs(chunk.column("text"), least)
                place = (hashes >> W.U64(64 - MARK_BITS)).astype(np.int64)
                hit = inside & ((marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(hit)
                owner = found.owner()
                # Runs that follow each other in one text belong to one stretch.
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
                firsts = at[new]
                lasts = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
                words = [
                    [found.text(i).translate(_FOLD) for i in range(a, b + least)]
                    for a, b in zip(firsts, lasts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc").take(pa.array(owner[firsts])),
                     pa.array(firsts - found.first[owner[firsts]], pa.int64()),
                     pa.array(words, pa.list_(pa.string()))],
                    names=["doc", "start", "words"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(
        rows, f"doc {kind}, start long, words array<string>")


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _seeds(frame: DataFrame, keep: list[str], least: int, first: str | None = None) -> DataFrame:
    """The runs of ``least`` words with their place."""
    spots = F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("words") - (least - 1)),
        lambda i: F.array_join(F.slice("words", i, least), " "))).alias("at", "seed")
    return frame.select(*keep, spots)


def _tile_pairs(least: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for words, parts in zip(frame["words"], frame["parts"]):
                number: dict[str, int] = {}
                item = [number.setdefault(word, len(number) + 1) for word in words]
                doc: list[int] = []
                places: list[int] = []
                for part in parts:
                    doc += [number.get(word, 0) for word in part["words"]] + [-1]
                    places += range(part["start"], part["start"] + len(part["words"]) + 1)
                tiles = greedy_tiles(item, doc, least)
                out.append((sum(n for _, _, n in tiles), len(tiles), len(item),
                            sorted((places[j], n) for _, j, n in tiles)))
            yield pd.DataFrame({
                "doc": list(frame["doc"]), "item": list(frame["item"]),
                "tiled_words": [o[0] for o in out], "n_tiles": [o[1] for o in out],
                "item_words": [o[2] for o in out],
                "spans": [[{"start": a, "length": n} for a, n in o[3]] for o in out]})
    return rows


def _contaminated(docs: DataFrame, benchmark: DataFrame, item: str, least: int, coverage: float
                  ) -> DataFrame:
    """Pairs of ``doc`` and ``item`` that pass, with their figures."""
    spark = docs.sparkSession
    items = _items(benchmark, item, least).select(F.col(item).alias("item"), "words")
    found = stored(stretches(docs, benchmark, least), "stretches")
    item_seeds = _seeds(items.withColumn("n", F.size("words")), ["item", "n", "words"], least)
    seeds = _seeds(found, ["doc"], least).select("doc", "seed").distinct()
    matched = seeds.join(item_seeds.select("item", "n", "words", "at", "seed"), "seed")
    # A seed covers words at to at + least - 1 of the item; how many words all of them
    # cover bounds what tiles can cover. Sets of places are as small as the item.
    covered = matched.groupBy("doc", "item", F.xxhash64("words").alias("version")).agg(
        F.first("n").alias("n"), F.collect_set("at").alias("ats"))
    bound = F.size(F.array_distinct(F.flatten(F.transform(
        "ats", lambda a: F.sequence(a, a + (least - 1))))))
    pairs = stored(
        covered.filter(bound >= coverage * F.col("n")).select("doc", "item", "version"), "pairs")
    wanted = pairs.select("doc").distinct()
    parts = found.join(wanted, "doc", "left_semi").groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("start", "words"))).alias("parts"))
    full = pairs.join(parts, "doc").join(
        items.withColumn("version", F.xxhash64("words")), ["item", "version"])
    schema = (f"doc {docs.schema['doc'].dataType.simpleString()}, "
              f"item {items.schema['item'].dataType.simpleString()}, tiled_words long, "
              "n_tiles long, item_words long, spans array<struct<start: long, length: long>>")
    tiled = full.select("doc", "item", "words", "parts").mapInPandas(_tile_pairs(least), schema)
    return tiled.filter(F.col("tiled_words") >= coverage * F.col("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                 item: str = "item_id", least: int = LEAST, coverage: float = COVERAGE
                 ) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    Result: ``key``, ``item``, ``tiled_words``, ``n_tiles``, ``item_words``,
    ``coverage`` and ``spans`` (tiles in words of the document).

    Items of fewer than ``least`` words, null and empty texts are in no pair. Rows with
    equal keys and texts count once; rows with equal keys and different texts are
    compared one by one, and so are null keys. Other columns are ignored.
    """
    named = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64("text").alias("text")).alias("doc"), "text")
    found = _contaminated(named, benchmark, item, least, coverage)
    return found.select(
        F.col("doc.key").alias(key), F.col("item").alias(item), "tiled_words", "n_tiles",
        "item_words", (F.col("tiled_words") / F.col("item_words")).alias("coverage"), "spans",
    ).distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                    item: str = "item_id", least: int = LEAST, coverage: float = COVERAGE
                    ) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    named = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64("text").alias("text")).alias("doc"), "text")
    bad = _contaminated(named, benchmark, item, least, coverage).select(
        F.col("doc.key").alias("__key"), F.col("doc.text").alias("__text")).distinct()
    bad = stored(bad, "contaminated")
    return docs.join(
        bad, docs[key].eqNullSafe(bad["__key"]) & (F.xxhash64(docs["text"]) == bad["__text"]),
        "left_anti")


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
