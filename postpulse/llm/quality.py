"""Quality rules with tokeniser fertility.

Besides plain counts, public vocabularies measure how a text splits into tokens:
characters per token, the share of tokens that are single fallback bytes, and the
entropy of its tokens. Each language has a band for each figure, around the median of
all its documents and as wide as a multiple of their spread; what lies outside is
rejected. Entropy depends on length, so its bands are per language and length class, and
documents of the neighbouring classes count a little.

Every document is judged by the same formula however many there are: the fewer documents a
band is learned from, the wider it is, so that the width changes little from one document
to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import words as W
from postpulse.llm.storage import stored, table
from postpulse.llm.tokens import byte_pair_ids, sentence_pieces

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# A band reaches from its quartiles by this many times their distance, and by a share
# of the median or a fixed width at least. It is wider by ``SLACK`` parts of the number of
# documents behind it.
WIDTHS = 3.0
MIN_SHARES = {"chars_per_token": 0.15, "entropy": 0.02, "byte_share": 0.0}
MIN_WIDTHS = {"chars_per_token": 0.0, "entropy": 0.0, "byte_share": 0.02}
SLACK = 10
# How often a document counts in its length class and in those one and two away.
WEIGHTS = (4096, 64, 1)

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double"
)
_NAMES = [part.split(" ")[0] for part in MEASURES.split(", ")]
_LINE_END = np.arange(256) == 0x0A


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each range of ``offsets``."""
    running = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return running[offsets[1:]] - running[offsets[:-1]]


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur again in their text, and which have occurred before in it."""
    keys = W.mix(hashes + owner.astype(W.U64) * W.U64(0x9E3779B97F4A7C15))
    codes, _ = pd.factorize(keys)
    often = np.bincount(codes)[codes] > 1 if len(codes) else np.zeros(0, bool)
    return often, pd.Series(codes).duplicated().to_numpy(bool)


def _duplicate_lines(texts: pa.Array, found: W.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = W.find_words(texts, _LINE_END)
    first_word = np.searchsorted(found.starts, lines.starts)
    filled = first_word < np.searchsorted(found.starts, lines.ends)
    hashes = W.word_hashes(lines, _LINE_END, fold=False)[filled]
    owner = lines.owner()[filled]
    _, later = _repeated(owner, hashes)
    return np.bincount(owner[later], minlength=len(lines.first) - 1)


def _repeat_words(found: W.Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside runs of three words that occur more than once in their text."""
    windows = W.sequence_hashes(hashes, 3)
    owner = found.owner()
    inside = owner[:len(windows)] == owner[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    often, _ = _repeated(owner[at], windows[at])
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, at[often], 1)
    np.add.at(change, at[often] + 3, -1)
    return _per_text(np.cumsum(change)[:-1] > 0, found.first)


def _entropy(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entropy of the ids of each text, in bits."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    keys, counts = np.unique((owner << 32) | ids, return_counts=True)
    part = np.bincount(keys >> 32, counts * np.log2(counts), minlength=len(sizes))
    safe = np.maximum(sizes, 1)
    return np.maximum(np.log2(safe) - part / safe, 0.0)


def measure_texts(texts: pa.Array, byte_pairs: str, pieces: str) -> list[np.ndarray]:
    """The figures of ``MEASURES`` for each text."""
    found = W.find_words(texts, W.SPACES)
    hashes = W.word_hashes(found, W.SPACES, fold=False)
    data, offsets = W.text_bytes(texts)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = letters[found.ends] - letters[found.starts]
    word_chars = np.bincount(found.owner(), chars, minlength=len(texts)).astype(np.int64)
    symbols = np.isin(np.arange(256), list(SYMBOLS))

    memory, single = sentence_pieces(pieces)
    places = memory.places(data, found.starts, found.ends, hashes)
    ids = memory.spread(places)
    by_word = np.concatenate(([0], np.cumsum(memory.lengths(places))))
    by_text = by_word[found.first]
    n_pieces = np.diff(by_text)
    all_pairs = np.diff(byte_pair_ids(texts, byte_pairs)[1])
    all_chars = letters[offsets[1:]] - letters[offsets[:-1]]
    return [
        np.diff(found.first), word_chars, _per_text(symbols[data], offsets),
        _duplicate_lines(texts, found), _repeat_words(found, hashes), n_pieces,
        all_chars / np.maximum(all_pairs, 1),
        _per_text(single[ids], by_text) / np.maximum(n_pieces, 1),
        _entropy(ids.astype(np.int64), by_text),
    ]


def measured(docs: DataFrame, byte_pairs: str, pieces: str, into: str) -> DataFrame:
    """The documents with a struct column ``into`` of the figures of their text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                figures = measure_texts(chunk.column("text"), byte_pairs, pieces)
                column = pa.StructArray.from_arrays([pa.array(f) for f in figures], _NAMES)
                yield pa.RecordBatch.from_arrays(
                    [*chunk.columns, column], names=[*chunk.schema.names, into])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    fields = MEASURES.replace(" long", ": long").replace(" double", ": double")
    return docs.mapInArrow(rows, f"{kinds}, `{into}` struct<{fields}>")


def _size_class(n_tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def bands(figures: DataFrame) -> DataFrame:
    """Bands by ``band_lang`` and ``band_size`` (-1: all lengths) from all documents: the
    quartiles of each figure and ``band_n``, the number of documents behind them.

    ``figures`` has ``lang`` and the struct ``m``. Documents that fail the base rules
    do not shape the bands. Entropy is rounded to thousandths, which bounds what a group holds.
    """
    good = figures.filter(~base_failed(F.col("m"))).select(
        F.coalesce("lang", F.lit("")).alias("band_lang"), "m")
    parts, none = [0.25, 0.5, 0.75], F.lit(None).cast("array<double>")
    whole = good.groupBy("band_lang").agg(
        F.count("*").cast("double").alias("band_n"),
        *[F.percentile_approx(f"m.{name}", parts, 1000).alias(name)
          for name in ("chars_per_token", "byte_share")])
    near = [(d, WEIGHTS[abs(d)]) for d in range(1 - len(WEIGHTS), len(WEIGHTS))]
    spread = good.select(
        "band_lang", F.round("m.entropy", 3).alias("value"),
        F.inline(F.array(*[F.struct(
            (_size_class(F.col("m.n_tokens")) + d).alias("band_size"),
            F.lit(weight).cast("long").alias("weight")) for d, weight in near])))
    sized = spread.groupBy("band_lang", "band_size").agg(
        (F.sum("weight") / WEIGHTS[0]).alias("band_n"),
        F.percentile("value", parts, F.col("weight")).alias("entropy"))
    return whole.select(
        "band_lang", F.lit(-1).alias("band_size"), "band_n", "chars_per_token", "byte_share",
        none.alias("entropy"),
    ).unionByName(sized.filter("band_size >= 0").select(
        "band_lang", "band_size", "band_n", none.alias("chars_per_token"),
        none.alias("byte_share"), "entropy"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def _outside(name: str, m: Column, quartiles: Column, n: Column) -> Column:
    value = m[name]
    spread = F.greatest(WIDTHS * (quartiles[2] - quartiles[0]), MIN_SHARES[name] * quartiles[1],
                        F.lit(MIN_WIDTHS[name])) * (1 + SLACK / n)
    off = (value < quartiles[0] - spread) | (value > quartiles[2] + spread)
    return F.coalesce(off, F.lit(False))


def judged(figures: DataFrame, limits: DataFrame, m: str, verdict: str) -> DataFrame:
    """Add ``verdict``, true for documents to keep.

    The bands have a row per language and length class. They are joined twice without
    a hint, so Spark broadcasts them only where their measured size allows it.
    """
    def side(name: str, only: Column) -> DataFrame:
        return limits.filter(only).select(*[F.col(c).alias(f"__{name}_{c}") for c in limits.columns])

    lang = F.coalesce("lang", F.lit(""))
    whole = side("w", F.col("band_size") == -1)
    sized = side("s", F.col("band_size") >= 0)
    joined = figures.join(whole, lang == F.col("__w_band_lang"), "left").join(
        sized, (lang == F.col("__s_band_lang"))
        & (_size_class(F.col(m)["n_tokens"]) == F.col("__s_band_size")), "left")
    odd = _outside("entropy", F.col(m), F.col("__s_entropy"), F.col("__s_band_n"))
    for name in ("chars_per_token", "byte_share"):
        odd = odd | _outside(name, F.col(m), F.col(f"__w_{name}"), F.col("__w_band_n"))
    kept = ~base_failed(F.col(m)) & ~F.coalesce(odd, F.lit(False))
    return joined.select(*figures.columns, kept.alias(verdict))


def quality(docs: DataFrame, byte_pairs: str, pieces: str, key: str = "doc_id") -> DataFrame:
    """The figures, ``base_failed`` and ``kept`` of every document.

    ``docs`` needs ``key``, ``text`` and ``lang``; other columns are ignored. A null
    text counts as empty and fails the base rules. Null languages form a group of their
    own. Repeated rows are judged alike; an empty table gives none.
    """
    figures = stored(
        measured(docs.select(key, "text", "lang"), byte_pairs, pieces, "m").drop("text"), "quality")
    limits = stored(bands(figures), "bands")
    return judged(figures, limits, "m", "kept").select(
        key, "m.*", base_failed(F.col("m")).alias("base_failed"), "kept")


def good_documents(docs: DataFrame, byte_pairs: str, pieces: str) -> DataFrame:
    """The documents that are kept, with their own columns.

    They are written once with their figures, so the text is not shuffled. Columns of
    any name are allowed.
    """
    m = "__figures" + "_" * max(map(len, docs.columns))
    figures = stored(measured(docs, byte_pairs, pieces, m), "measured")
    limits = stored(bands(figures.select("lang", F.col(m).alias("m"))), "bands")
    keep = f"{m}_keep"
    return judged(figures, limits, m, keep).filter(F.col(keep)).select(
        *[F.col(f"`{name}`") for name in docs.columns])


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("piece_bpe_32k.model"))


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), *vocabularies())
