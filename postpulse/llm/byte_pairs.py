"""Byte-level BPE: texts to ids by a local rank file, and ids back to raw bytes.

The tiktoken library encodes each match of the split pattern on its own. Long texts are
cut before they reach it, only where the pattern ends a match whatever surrounds the
place: between visible and white space, and after a letter that no letter follows. So the
ids are those of the whole text, and a text of any length needs the memory of its parts
only. White space longer than a part, which has no such place and on which the library's
pattern runs out of stack, is one match by itself: all of it at the end of a text, else
all but its last character, which starts what follows.

Decoding joins the bytes of the ids. Ids that cut a character in two give its bytes as
they are; nothing is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from postpulse.llm import words as W
from postpulse.llm.storage import table

PART = 1 << 14
BATCH_IDS = 1 << 19

# The white space of Unicode; some letters; characters that are no letters
# in any version of Unicode. Each is the inside of a character class, by code points.
def _characters(*spans: tuple[int, int]) -> str:
    return "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in spans)


WHITE = _characters(
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LETTERS = _characters(
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x430, 0x44F),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
NO_LETTERS = _characters(
    (0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F), (0x3001, 0x3002), (0xFF01, 0xFF01),
    (0xFF0C, 0xFF0C), (0xFF1F, 0xFF1F))

_END_OF_MATCH = re.compile(
    f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{LETTERS}])(?=[{NO_LETTERS}])")


@functools.lru_cache(maxsize=4)
def coders(ranks: str, pattern: str):
    """tiktoken by the ranks: one that splits texts by the pattern, one that does not."""
    import tiktoken

    with open(ranks, "rb") as file:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tuple(
        tiktoken.Encoding(name, pat_str=split, mergeable_ranks=known, special_tokens={})
        for name, split in (("split", pattern), ("whole", r"[\s\S]+")))


def parts(text: str, longest: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is one match of the pattern by itself.

    A part has about ``longest`` characters, or reaches to the first place that ends a
    match for sure.
    """
    if len(text) <= longest:
        yield text, False
        return
    start = 0
    for run in re.finditer(f"[{WHITE}]{{{longest},}}", text):
        yield from _cut(text, start, run.start(), longest)
        start = run.end() if run.end() == len(text) else run.end() - 1
        if start > run.start():
            yield text[run.start():start], True
    yield from _cut(text, start, len(text), longest)


def _cut(text: str, start: int, stop: int, longest: int) -> Iterator[tuple[str, bool]]:
    while stop - start > longest:
        place = _END_OF_MATCH.search(text, start + longest, stop)
        if not place:
            break
        yield text[start:place.start()], False
        start = place.start()
    if start < stop:
        yield text[start:stop], False


def text_ids(text: str | None, ranks: str, pattern: str, longest: int = PART) -> np.ndarray:
    """The ids of one text; null has none."""
    if not text:
        return np.zeros(0, np.int32)
    split, whole = coders(ranks, pattern)
    found = [np.array((whole if one else split).encode_ordinary(part), np.int32)
             for part, one in parts(text, longest)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _others(frame: DataFrame, keep: Sequence[str] | None, new: str) -> list[StructField]:
    """The columns that stay: ``keep`` or all, without one of the new name in any case."""
    return [field for field in frame.schema.fields
            if (keep is None or field.name in keep) and field.name.lower() != new.lower()]


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids",
           keep: Sequence[str] | None = None, pattern: str | None = None,
           longest: int = PART) -> DataFrame:
    """Add the token ids of ``text`` as the array ``ids``.

    ``ranks`` is the place of a rank file, the same on every executor. Rows stay as they
    are: null and empty texts have an empty array, repeated rows each their ids, an empty
    table gives none. ``keep`` names the columns to hand on, all by default; a column of
    the new name, in any case, is replaced.
    """
    split = pattern or _default_pattern()
    fields = _others(docs, keep, ids)
    names = [field.name for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.chunks(batch, text):
                found = [text_ids(t, ranks, split, longest) for t in rows.column(text).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(name) for name in names),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [*names, ids])

    schema = StructType([*fields, StructField(ids, ArrayType(IntegerType()))])
    wanted = [F.col(f"`{name}`") for name in dict.fromkeys([*names, text])]
    return docs.select(*wanted).mapInArrow(run, schema)


def decode(frame: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded",
           keep: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Add the bytes of the array ``ids`` as the binary column ``into``.

    A null array, and nulls in one, have no bytes. An id that the file does not have ends
    the job with an error. Other columns as in ``encode``.
    """
    split = pattern or _default_pattern()
    fields = _others(frame, keep, into)
    names = [field.name for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(ranks, split)[0]
        for batch in batches:
            for rows in _slices(batch, ids):
                found = [coder.decode_bytes([i for i in row or () if i is not None])
                         for row in rows.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(name) for name in names), pa.array(found, pa.binary())],
                    [*names, into])

    schema = StructType([*fields, StructField(into, BinaryType())])
    wanted = [F.col(f"`{name}`") for name in dict.fromkeys([*names, ids])]
    return frame.select(*wanted).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, ids: str, most: int = BATCH_IDS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` ids; a longer row is one slice."""
    column = batch.column(ids)
    ends = column.offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def op11_byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs, ranks, keep=("doc_id",)), ranks)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
