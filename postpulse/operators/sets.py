"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators.ranking import top_k


def append_posts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Both sets of posts, repeats kept."""
    return existing.unionByName(batch)


def distinct_locations(posts: DataFrame) -> DataFrame:
    """The distinct normalised locations of the posts."""
    return (
        posts.select(P.normalise_location(F.col("location")).alias("location"))
        .filter(F.col("location").isNotNull())
        .distinct()
    )


def recent_topics(searches: DataFrame, k: int = K.TOP_TOPICS) -> DataFrame:
    """The most recently searched topics, each once, with the time of the last run.

    Topics are compared without case, as runs do; the newest spelling is shown.
    """
    newest = F.max(F.struct("timestamp", "topic")).alias("newest")
    return (
        searches.groupBy(F.lower("topic")).agg(newest)
        .select("newest.topic", F.col("newest.timestamp").alias("last_search"))
        .orderBy(F.desc("last_search"), F.asc("topic"))
        .limit(k)
    )


def first_per_user(posts: DataFrame, by: tuple[str, ...] = ("topic",)) -> DataFrame:
    """One whole row per user: the one with most followers, the oldest of equals."""
    order = [F.desc("user_followers"), F.asc("created_at"), F.asc("tweet_id")]
    return top_k(posts, [*by, "username"], order, 1)
