"""Aggregates and ranked views, for all topics at once.

Every ranking works on aggregated rows, so a hot topic has been reduced to its
distinct users, tags, words or places before any window sees it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators.filters import filter_metric_prefix
from postpulse.operators.ranking import top_k


# --- hashtags -----------------------------------------------------------------
def hashtag_counts(
    posts: DataFrame,
    by: Sequence[str] = ("topic",),
    topic: str | None = "topic",
    tags: str | None = None,
) -> DataFrame:
    """Count of every tag per group: columns ``by``, ``hashtag``, ``count``.

    With a ``topic`` column only tags containing it count, lower-cased; without one
    (``topic=None``) all tags count as they are written.
    """
    found = F.col(tags) if tags else P.extract_hashtags(F.col("text"))
    if topic:
        found = F.transform(P.tags_with_topic(found, F.col(topic)), F.lower)
    return (
        posts.select(*by, F.explode(found).alias("hashtag"))
        .groupBy(*by, "hashtag")
        .agg(F.count("*").alias("count"))
    )


def merge_hashtag_counts(*batches: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """One count per tag out of the counts of several batches."""
    merged = batches[0]
    for batch in batches[1:]:
        merged = merged.unionByName(batch)
    return merged.groupBy(*by, "hashtag").agg(F.sum("count").alias("count"))


def top_hashtags(
    counts: DataFrame, by: Sequence[str] = ("topic",), k: int = K.TOP_HASHTAGS
) -> DataFrame:
    """The most frequent tags per group; rows of the same tag are merged first."""
    merged = merge_hashtag_counts(counts, by=by)
    return top_k(merged, by, [F.desc("count"), F.asc("hashtag")], k)


# --- sentiment ----------------------------------------------------------------
def sentiment_counts(posts: DataFrame, by: Sequence[str] = ("search_id",)) -> DataFrame:
    """Posts per sentiment as metrics: ``sentiment_<label>`` and the count as text."""
    return (
        posts.groupBy(*by, "sentiment")
        .agg(F.count("*").alias("n"))
        .select(
            *by,
            F.concat(F.lit(K.SENTIMENT_METRIC_PREFIX), "sentiment").alias("metric"),
            F.col("n").cast("string").alias("value"),
        )
    )


def sentiment_share(metrics: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Share of every sentiment in percent, out of stored metrics.

    Equal labels are summed first, so the window sees a few rows per group.
    """
    labelled = (
        filter_metric_prefix(metrics)
        .groupBy(*by, F.col("metric").alias("sentiment"))
        .agg(F.sum("value").alias("posts"))
    )
    total = F.sum("posts").over(Window.partitionBy(*by))
    return labelled.withColumn(
        "percent", F.round(F.try_divide(F.col("posts") * 100, total), 6)
    )


# --- volume -------------------------------------------------------------------
def hourly_volume(posts: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Posts per hour; hours without posts are absent, posts without a time drop out."""
    return (
        posts.filter(F.col("created_at").isNotNull())
        .groupBy(*by, P.floor_hour(F.col("created_at")).alias("hour"))
        .agg(F.count("*").alias("count"))
    )


# --- users --------------------------------------------------------------------
def top_users(
    posts: DataFrame, by: Sequence[str] = ("topic",), k: int = K.TOP_USERS
) -> DataFrame:
    """Users with most posts, with the sum of their retweets."""
    users = posts.groupBy(*by, "username").agg(
        F.count("tweet_id").alias("tweet_count"),
        F.sum("retweet_count").alias("retweet_count"),
    )
    users = users.filter(F.col("username").isNotNull())
    return top_k(users, by, [F.desc("tweet_count"), F.asc("username")], k)


def influencers(
    posts: DataFrame, by: Sequence[str] = ("topic",), k: int = K.TOP_INFLUENCERS
) -> DataFrame:
    """Users with most followers; a user counts with the largest number seen."""
    users = posts.groupBy(*by, "username").agg(F.max("user_followers").alias("user_followers"))
    return top_k(users, by, [F.desc("user_followers"), F.asc("username")], k)


# --- places -------------------------------------------------------------------
def location_counts(posts: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Posts per normalised location; posts without one drop out."""
    return (
        posts.select(*by, P.normalise_location(F.col("location")).alias("location"))
        .filter(F.col("location").isNotNull())
        .groupBy(*by, "location")
        .agg(F.count("*").alias("count"))
    )


def top_locations(
    counts: DataFrame, by: Sequence[str] = ("topic",), k: int = K.TOP_LOCATIONS
) -> DataFrame:
    """The most frequent locations per group."""
    return top_k(counts, by, [F.desc("count"), F.asc("location")], k)


def geo_center(resolved: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Mean coordinates of the resolved locations, each location counting once."""
    return resolved.groupBy(*by).agg(
        F.round(F.avg("lat"), 6).alias("center_lat"),
        F.round(F.avg("lon"), 6).alias("center_lon"),
    )


# --- key figures --------------------------------------------------------------
def kpi_row(posts: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Total posts, positive posts, mean retweets to one decimal (half to even)."""
    return posts.groupBy(*by).agg(
        F.count("*").alias("total_posts"),
        F.count_if(F.col("sentiment") == K.POSITIVE).alias("positive_posts"),
        F.bround(F.avg("retweet_count"), 1).alias("avg_retweets"),
    )


def crisis_scores(
    posts: DataFrame,
    by: Sequence[str] = ("topic",),
    keywords: Sequence[str] = K.REFERENCE_KEYWORDS,
    thresholds: Sequence[tuple[float, str]] = K.ALERT_THRESHOLDS,
) -> DataFrame:
    """Crisis posts, total posts, crisis score and alert level per group."""
    counted = posts.groupBy(*by).agg(
        F.count_if(P.is_crisis(F.col("cleaned_text"), keywords)).alias("crisis_posts"),
        F.count("*").alias("total_posts"),
    )
    return with_crisis_score(counted, thresholds)


def with_crisis_score(
    counted: DataFrame, thresholds: Sequence[tuple[float, str]] = K.ALERT_THRESHOLDS
) -> DataFrame:
    """Add score and level to rows with ``crisis_posts`` and ``total_posts``."""
    scored = counted.withColumn(
        "crisis_score", P.crisis_score(F.col("crisis_posts"), F.col("total_posts"))
    )
    return scored.withColumn("alert_level", P.alert_level(F.col("crisis_score"), thresholds))


def topic_metrics(
    posts: DataFrame,
    by: Sequence[str] = ("topic",),
    keywords: Sequence[str] = K.REFERENCE_KEYWORDS,
    thresholds: Sequence[tuple[float, str]] = K.ALERT_THRESHOLDS,
) -> DataFrame:
    """Key figures, sentiment counts and crisis score together, in one pass."""
    labels = [
        F.count_if(F.col("sentiment") == label).alias(f"{label.lower()}_posts")
        for label in K.SENTIMENTS
    ]
    counted = posts.groupBy(*by).agg(
        F.count("*").alias("total_posts"),
        *labels,
        F.bround(F.avg("retweet_count"), 1).alias("avg_retweets"),
        F.count_if(P.is_crisis(F.col("cleaned_text"), keywords)).alias("crisis_posts"),
    )
    return with_crisis_score(counted, thresholds)
