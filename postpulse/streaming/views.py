"""Streaming views.

Counts are taken per micro-batch by the batch operators and summed up on read. No post
is too late for them, as nothing waits for a watermark. Only ``dedupe`` keeps state, and only
with a ``delay`` it has a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators import counts

DEDUPE_SPLITS = 16
POLLED = "requested_at"


@dataclass(frozen=True)
class CountView:
    """A view of counts by ``keys``: ``count`` counts a set of posts, sums of such counts
    count all, and ``finish`` turns the sums into the view."""

    keys: tuple[str, ...]
    count: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame] = lambda sums: sums


def hourly_volume(by: Sequence[str] = ("topic",)) -> CountView:
    """Posts per hour, however late they come."""
    return CountView((*by, "hour"), lambda posts: counts.hourly_volume(posts, by))


def hashtag_counts(by: Sequence[str] = ("topic",)) -> CountView:
    """Posts per tag."""
    return CountView((*by, "hashtag"), lambda posts: counts.hashtag_counts(posts, by))


def sentiment_counts(by: Sequence[str] = ("topic",)) -> CountView:
    """Scored posts per sentiment."""
    return CountView((*by, "sentiment"), lambda scored: scored.groupBy(*by, "sentiment").agg(
        F.count("*").alias("count")))


def crisis_scores(
    by: Sequence[str] = ("topic",), keywords: Sequence[str] = K.REFERENCE_KEYWORDS
) -> CountView:
    """Crisis score per hour of posts with ``cleaned_text``, however late they come."""
    def count(cleaned: DataFrame) -> DataFrame:
        hour = F.date_trunc("hour", F.col("created_at").cast("timestamp"))
        return cleaned.withColumn("hour", hour).filter(F.col("hour").isNotNull()).groupBy(
            *by, "hour").agg(
            F.count_if(P.is_crisis(F.col("cleaned_text"), keywords)).alias("crisis_posts"),
            F.count("*").alias("total_posts"))

    return CountView((*by, "hour"), count, counts.with_crisis_score)


def post_name(posts: DataFrame, keys: Sequence[str] = ("tweet_id",)) -> Column:
    """What copies of a post have in common: ``keys``, or for a post without an id of its own
    text, author and time."""
    nameless = F.lit(False)
    if "text" in posts.columns:
        nameless = F.col("tweet_id").isNull() | (F.col("tweet_id") == P.post_id(F.col("text")))
    told_apart_by = [c for c in ("text", "username", "created_at") if c in posts.columns]
    content = F.sha2(F.to_json(F.struct(*told_apart_by)), 256)
    named = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.when(nameless, content).otherwise(named)


def best_copies(
    posts: DataFrame, keys: Sequence[str] = ("tweet_id",), newest: str = POLLED
) -> DataFrame:
    """One copy of each post: the newest, of equally new ones the largest by its columns in
    their order, so that it does not depend on which task saw which copy. Missing values are
    smallest; without the column ``newest`` only the others decide. Columns of maps have no
    order and are not allowed.
    """
    others = [c for c in posts.columns if c != newest]
    order = [newest, *others] if newest in posts.columns else others
    best = posts.groupBy(post_name(posts, keys).alias("__post")).agg(
        F.max(F.struct(*[F.col(f"`{c}`") for c in order])).alias("__best"))
    return best.select(*[F.col(f"__best.`{c}`") for c in posts.columns])


def dedupe(
    posts: DataFrame,
    keys: Sequence[str] = ("tweet_id",),
    delay: str | None = None,
    splits: int = DEDUPE_SPLITS,
) -> DataFrame:
    """Each post once, as soon as its first copy comes, however often it was polled.

    The names of all posts are kept as state, 64 bytes each, and none is too late. With a
    ``delay`` names are kept that long only, by ``created_at``, and posts later than it are
    dropped. Which of several copies stays depends on what comes first;
    ``sinks.start_distinct`` chooses by content.

    A post that came without id has none or that of its text; such posts are the same
    only if text, author and time are. Copies of one post are first thinned in
    ``splits`` parts by where they were read, so that a post making up much of the
    stream does not pass through one task.
    """
    split = F.pmod(F.spark_partition_id(), F.lit(splits))
    named = posts.withColumn("__post", post_name(posts, keys)).withColumn("__split", split)
    if delay is None:
        return named.dropDuplicates(["__post", "__split"]).drop("__split").dropDuplicates(
            ["__post"]).drop("__post")
    timed = named.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark(
        "created_at", delay)
    thinned = timed.dropDuplicatesWithinWatermark(["__post", "__split"]).drop("__split")
    return thinned.dropDuplicatesWithinWatermark(["__post"]).drop("__post")
