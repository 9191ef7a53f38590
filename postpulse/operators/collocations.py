"""Collocations: pairs of words that stand together more often than chance explains.

Words next to each other in one post are counted once; from these counts come the numbers
of single words, as every word is the first of a pair or stands last, and the size of the
texts. A pair is scored by the log-likelihood ratio of its second word following the first
one against following any other (Dunning 1993). Stop words neither stand in pairs nor
count; a pair does not reach over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse.operators.word_counts import word_counts
from postpulse.session import scratch_path

_TINY = 1e-10
WHOLE = "__whole"


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join by columns of both sides, in which null equals null."""
    renamed = right.select([F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for name in on:
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(renamed, same).drop(*[f"__{name}" for name in on])


def pair_counts(
    posts: DataFrame, stopwords: DataFrame | Sequence[str], by: Sequence[str], column: str
) -> DataFrame:
    """``by``, ``first``, ``second`` (null where no pair begins) and ``count``, of words that
    are no stop words.

    Stop words that are part of the program are taken out before counts are shuffled, those of
    a table after counting. Nulls among them are ignored.
    """
    literal = None if isinstance(stopwords, DataFrame) else sorted({w for w in stopwords if w})
    found = word_counts(posts, by, column, True)
    if literal:
        found = found.filter(~F.col("first").isin(literal)).withColumn(
            "second", F.when(~F.col("second").isin(literal), F.col("second")))
    counted = found.groupBy(*by, "first", "second").agg(F.sum("count").alias("count"))
    if literal is not None:
        return counted
    known = stopwords.select("word").dropna().distinct()
    firsts = counted.join(known.withColumnRenamed("word", "first"), "first", "left_anti")
    stops = known.select(F.col("word").alias("second"), F.lit(True).alias("stop"))
    return firsts.join(stops, "second", "left").select(
        *by, "first", F.when(F.col("stop").isNull(), F.col("second")).alias("second"), "count"
    ).groupBy(*by, "first", "second").agg(F.sum("count").alias("count"))


def likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """How much likelier the counts are if the second word depends on the first.

    ``both`` counts the pair, ``first`` and ``second`` the words, ``total`` all words. One
    word that makes up the whole text gives 0.
    """
    def log(share: Column) -> Column:
        return F.ln(F.greatest(share, F.lit(_TINY)))

    def likelihood(hits: Column, tries: Column, share: Column) -> Column:
        return log(share) * hits + log(1 - share) * (tries - hits)

    rest, others = second - both, total - first
    free, after, elsewhere = second / total, both / first, rest / others
    ratio = 2 * (likelihood(both, first, after) + likelihood(rest, others, elsewhere)
                 - likelihood(both, first, free) - likelihood(rest, others, free))
    return F.when((total > first) & (total > second), ratio).otherwise(0.0)


def _scored(pairs: DataFrame, by: Sequence[str], threshold: float | None) -> tuple[DataFrame, DataFrame]:
    """Single words and the pairs above the threshold with their scores."""
    singles = pairs.groupBy(*by, F.col("first").alias("word")).agg(F.sum("count").alias("n"))
    totals = singles.groupBy(*by).agg(F.sum("n").alias("total"))
    scored = pairs.filter(F.col("second").isNotNull())
    for side in ("first", "second"):
        scored = _joined(scored, singles.select(
            *by, F.col("word").alias(side), F.col("n").alias(f"n_{side}")), [*by, side])
    scored = _joined(scored, totals, by).withColumn("score", likelihood_ratio(
        F.col("count"), F.col("n_first"), F.col("n_second"), F.col("total")))
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold)
    return singles, scored.select(
        *by, "first", "second", "count", F.round("score", 3).alias("score"))


def _counted(posts: DataFrame, stopwords: DataFrame | Sequence[str], by: Sequence[str], column: str
             ) -> tuple[DataFrame, list[str]]:
    """The pair counts by way of a table, as several joins read them."""
    keys = [*by] or [WHOLE]
    if not by:
        posts = posts.withColumn(WHOLE, F.lit(0))
    spark = posts.sparkSession
    counted = pair_counts(posts, stopwords, keys, column)
    path = scratch_path(spark, "pairs")
    counted.write.parquet(path)
    return spark.read.schema(counted.schema).parquet(path), keys


def collocations(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = K.STOPWORDS,
    by: Sequence[str] = ("topic",),
    column: str = "cleaned_text",
    threshold: float | None = K.COLLOCATION_THRESHOLD,
) -> DataFrame:
    """Pairs scoring above the threshold: ``by``, ``first``, ``second``, ``count``, ``score``.

    Without a threshold all pairs are scored. Groups that are null are one group.
    """
    counted, keys = _counted(posts, stopwords, by, column)
    pairs = _scored(counted, keys, threshold)[1]
    return pairs.drop(WHOLE)


def cloud_counts(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = K.STOPWORDS,
    by: Sequence[str] = ("topic",),
    column: str = "cleaned_text",
    threshold: float = K.COLLOCATION_THRESHOLD,
) -> DataFrame:
    """Words and collocations in one count: ``by``, ``word``, ``count``.

    What a word has in collocations is taken off its own count, for each of them; a word
    that has nothing left goes.
    """
    counted, keys = _counted(posts, stopwords, by, column)
    singles, pairs = _scored(counted, keys, threshold)
    own = singles.select(*keys, "word", F.col("n").alias("count"))
    used = pairs.select(*keys, F.explode(F.array("first", "second")).alias("word"),
                        (-F.col("count")).alias("count"))
    left = own.unionByName(used).groupBy(*keys, "word").agg(F.sum("count").alias("count"))
    named = pairs.select(*keys, F.concat_ws(" ", "first", "second").alias("word"), "count")
    return left.filter(F.col("count") > 0).unionByName(named).drop(WHOLE)
