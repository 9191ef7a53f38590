"""Spelling variants: words one edit apart, each led to its most frequent near word.

Letters are hashed to a few symbols. Two words one edit apart have reduced words at most
one edit apart, so the full one-edit neighbourhood of each distinct reduced word, itself
included, is joined with the reduced vocabulary, and the words of both sides are compared
as they are written. A neighbourhood has each of its words once, and a pair of reduced
words meets from the side of the smaller name only, so every pair of words is compared
once.

Reduced words are named by 64-bit sums of their symbols times powers of an odd number.
The name of each neighbour is that of the word with one term changed and the terms behind
it multiplied or divided by that number, so long words cost no more per neighbour than
short ones. Equal names of different words only cause a comparison more.

Words, not their occurrences, are joined: occurrences are counted first, and summed before
they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.storage import stored, table

# The letters of words, and the rule of the lost letters.
LETTERS = r"[A-Za-z\u00C0-\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOSSES = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5

SYMBOLS = 8
SLICE_LETTERS = 1 << 16

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = U64(pow(_BASE, -1, 1 << 64))
_VALUES = ((np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) ^ U64(0xA0761D6478BD642F)) | U64(1)


# --- words --------------------------------------------------------------------
def runs(text: Column) -> Column:
    """Maximal runs of letters, with A-Z lowered; null has none."""
    found = F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))
    # Lowering whole words is fast but changes letters outside ASCII.
    return F.transform(found, lambda run: F.when(
        F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, UPPER, UPPER.lower())))


def with_losses(key: Column, run: Column, losses: int = LOSSES) -> Column:
    """The run, or without one letter where ``losses`` divides the checksum of key and run.

    A null key counts as empty.
    """
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run)
    sum_ = F.crc32(name.cast("binary"))
    place = (sum_ % F.length(run)).cast("int")
    return F.when(sum_ % losses == 0, F.concat(
        F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
               ) -> DataFrame:
    """Words (column ``word``) of that length and number: ``word``, ``n``."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(
        F.count("*").alias("n")).filter(F.col("n") >= min_count)


# --- reduced words -------------------------------------------------------------
def _by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of words of one length, in slices of a bounded size."""
    lengths = np.array([len(word) for word in found])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        most = max(1, SLICE_LETTERS // max(1, int(length)))
        for start in range(0, len(places), most):
            some = places[start:start + most]
            joined = "".join(found[i] for i in some).encode("utf-32-le", "surrogatepass")
            yield some, np.frombuffer(joined, np.uint32).reshape(len(some), length)


def symbols_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of every letter."""
    return ((letters * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(symbols)


def _powers(count: int) -> np.ndarray:
    result = np.ones(count, U64)
    result[1:] = np.multiply.accumulate(np.full(count - 1, _BASE, U64))
    return result


def reduced_names(found: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The name of the reduced word of every word."""
    names = np.zeros(len(found), U64)
    for places, letters in _by_length(found):
        terms = _VALUES[symbols_of(letters, symbols)] * _powers(letters.shape[1] + 1)[:-1]
        names[places] = terms.sum(1, dtype=U64)
    return names


def neighbourhoods(found: list[str], symbols: int = SYMBOLS
                   ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of reduced words, and of all that are at most one edit from each.

    Of equal results of an edit one is made: a symbol goes from the end of its run, and
    comes in where it does not stand before.
    """
    for _, letters in _by_length(found):
        code = symbols_of(letters, symbols)
        count, length = code.shape
        powers = _powers(length + 1)
        value = _VALUES[code]
        terms = value * powers[:-1]
        before = np.zeros((count, length + 1), U64)
        np.cumsum(terms, axis=1, out=before[:, 1:])
        name = before[:, -1]
        yield name, name
        behind = name[:, None] - before

        def chosen(keys: np.ndarray, where: np.ndarray, name: np.ndarray = name):
            row, column = np.nonzero(where)
            return name[row], keys[row, column]

        last = np.ones((count, length), bool)
        last[:, :-1] = code[:, :-1] != code[:, 1:]
        yield chosen(before[:, :-1] + behind[:, 1:] * _INVERSE, last)
        for symbol in range(symbols):
            own = _VALUES[symbol]
            yield chosen(name[:, None] + (own - value) * powers[:-1], code != symbol)
            free = np.ones((count, length + 1), bool)
            free[:, 1:] = code != symbol
            yield chosen(before + own * powers + behind * U64(_BASE), free)


def _with_names(words: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = reduced_names(batch.column("word").to_pylist(), symbols).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names)], [*batch.schema.names, "reduced"])

    return words.mapInArrow(run, "word string, n long, reduced long")


def _neighbours(seeds: DataFrame, symbols: int) -> DataFrame:
    """``reduced`` and ``other``, the names of its neighbourhood that are not smaller."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, other in neighbourhoods(batch.column("word").to_pylist(), symbols):
                name, other = name.view(np.int64), other.view(np.int64)
                kept = other >= name
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[kept]), pa.array(other[kept])], ["reduced", "other"])

    # A seed makes some hundred rows, so the few bytes of seeds must not meet in one task.
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seeds.select("word").repartition(parts, "word").mapInArrow(
        run, "reduced long, other long")


# --- pairs and groups -----------------------------------------------------------
def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs of ``word`` (each once in ``words``, with ``n``) one edit apart, smaller first
    by the name of the reduced word: ``first``, ``first_n``, ``second``, ``second_n``."""
    known = stored(_with_names(words.select("word", "n"), symbols), "spelling-words")
    seeds = known.groupBy("reduced").agg(F.min("word").alias("word"))
    names = known.select(F.col("reduced").alias("other")).distinct()
    linked = _neighbours(seeds, symbols).join(names, "other")
    left = known.select("reduced", F.col("word").alias("first"), F.col("n").alias("first_n"))
    right = known.select(F.col("reduced").alias("other"), F.col("word").alias("second"),
                         F.col("n").alias("second_n"))
    once = (F.col("reduced") != F.col("other")) | (F.col("first") < F.col("second"))
    return linked.join(left, "reduced").join(right, "other").filter(
        once & (F.levenshtein("first", "second", 1) == 1)
    ).select("first", "first_n", "second", "second_n")


def forms(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word.

    The form is the near word that is most frequent, of equals the first in code-point
    order, if it is ``ratio`` times as frequent as the word.
    """
    pairs = near_pairs(words, symbols)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("first").alias("word"), F.col("second").alias("near"),
                 F.col("second_n").alias("near_n")),
        F.struct(F.col("second").alias("word"), F.col("first").alias("near"),
                 F.col("first_n").alias("near_n")))).alias("p")).select(
        "p.word", F.lit(None).cast("long").alias("n"),
        F.struct((-F.col("p.near_n")).alias("less"), "p.near").alias("near"))
    own = words.select("word", "n", F.lit(None).cast(sides.schema["near"].dataType).alias("near"))
    best = own.unionByName(sides).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
    good = -F.col("best.less") >= ratio * F.col("n")
    return best.select(
        "word", "n", "n_near", F.when(good, F.col("best.near")).alias("form"),
        F.when(good, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Add ``root``: where the forms of a word lead; the word itself if it has none.

    A form is several times as frequent as its word, so chains are short and end. Each
    round follows twice as many forms. ``found`` must be a stored table.
    """
    paths = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(paths.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        paths = moved.select("word", "root")
        if not moved.filter("moved").take(1):
            break
    return found.join(paths, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """Groups of spelling variants in a vocabulary of ``word`` and ``n``.

    Returns ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``. Words that are
    null or have a null number are left out; of a word given several times the numbers are
    added. Words of any length and letters are allowed, an empty table gives no rows,
    and other columns are ignored, whatever their names.
    """
    whole = stored(words.select("word", "n").dropna().groupBy("word").agg(
        F.sum("n").alias("n")), "spelling-vocabulary")
    return with_roots(stored(forms(whole, symbols, ratio), "spelling-forms"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).select(
        with_losses(F.col("doc_id"), F.col("run")).alias("word"))
    return variant_groups(vocabulary(words)).select(
        "word", "form", "root", "n", "n_near", "form_n")
