"""Counts of words, and of words with the word that follows, over whole texts.

A task counts the words of many texts at once (``functions.scan``), so what is shuffled and
summed are counts of distinct words, not words. Texts with letters that the scan does not
know come out as they are, and their words are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from postpulse import functions as P
from postpulse.functions import scan as S

REST = "__rest"


def word_counts(posts: DataFrame, by: Sequence[str], column: str, pairs: bool) -> DataFrame:
    """``by``, ``first``, with ``pairs`` also ``second`` (null for the last word of a text), and
    ``count``. A word or pair may come in several rows, whose counts add up."""
    texts = posts.select(*by, F.col(column).alias(REST))
    words = ["first", "second"] if pairs else ["first"]
    names = [*texts.columns[:-1], *words, "count", REST]
    width = len(names) - len(words) - 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in S.chunks(batch.column(width), S.COUNTED_BYTES):
                keys = [batch.column(i).slice(start, len(part)) for i in range(width)]
                counted, others = S.counts(part, keys, pairs)
                size = len(counted[-1])
                yield pa.RecordBatch.from_arrays([*counted, pa.nulls(size, pa.string())], names=names)
                if len(others):
                    at = pa.array(others)
                    yield pa.RecordBatch.from_arrays(
                        [*(key.take(at) for key in keys),
                         *(pa.nulls(len(at), pa.string()) for _ in words),
                         pa.nulls(len(at), pa.int64()), part.take(at)], names=names)

    schema = StructType(texts.schema.fields[:-1])
    for word in words:
        schema = schema.add(word, StringType())
    found = texts.mapInArrow(rows, schema.add("count", LongType()).add(REST, StringType()))
    one = F.lit(1).cast("long").alias("count")
    listed = P.words(F.col(REST))
    if pairs:
        following = F.concat(F.slice(listed, 2, F.size(listed)), F.array(F.lit(None).cast("string")))
        single = F.transform(
            F.filter(F.arrays_zip(listed.alias("first"), following.alias("second")),
                     lambda p: p["first"].isNotNull()),
            lambda p: F.struct(p["first"].alias("first"), p["second"].alias("second"), one))
    else:
        single = F.transform(listed, lambda w: F.struct(w.alias("first"), one))
    each = F.when(F.col(REST).isNull(), F.array(F.struct(*words, "count"))).otherwise(single)
    return found.select(*by, F.inline(each))
