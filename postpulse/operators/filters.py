"""Filters and projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators.ranking import top_k


def filter_topic_rows(
    posts: DataFrame, topic: str, column: str = "hashtags", literal: bool = False
) -> DataFrame:
    """Rows whose tag column matches the topic, both lower-cased; null does not.

    The topic is a regular expression unless ``literal``; the text is not looked at.
    """
    cell, wanted = F.lower(F.col(column)), topic.lower()
    if literal:
        return posts.filter(F.contains(cell, F.lit(wanted)))
    try:
        re.compile(wanted)
    except re.error as error:
        raise ValueError(
            f"topic {topic!r} is not a valid pattern ({error}); use literal=True"
        ) from error
    return posts.filter(cell.rlike(wanted))


def filter_topic_tags(posts: DataFrame, tags: str = "tags", topic: str = "topic") -> DataFrame:
    """Posts with only those tags left that contain the post's topic."""
    return posts.withColumn(tags, P.tags_with_topic(F.col(tags), F.col(topic)))


def filter_crisis(
    posts: DataFrame,
    column: str = "cleaned_text",
    keywords: Sequence[str] = K.REFERENCE_KEYWORDS,
) -> DataFrame:
    """Posts whose cleaned text contains a crisis keyword."""
    return posts.filter(P.is_crisis(F.col(column), keywords))


def filter_metric_prefix(
    analytics: DataFrame, prefix: str = K.SENTIMENT_METRIC_PREFIX
) -> DataFrame:
    """Metrics with the prefix, the prefix removed and the value as a number."""
    return analytics.filter(F.startswith("metric", F.lit(prefix))).withColumns({
        "metric": F.replace(F.col("metric"), F.lit(prefix), F.lit("")),
        "value": F.col("value").try_cast("double"),
    })


def filter_run(rows: DataFrame, search_id: int | Column) -> DataFrame:
    """Rows of one search run."""
    return rows.filter(F.col("search_id") == search_id)


def filter_topic(rows: DataFrame, topic: str, column: str = "topic") -> DataFrame:
    """Rows of a topic, ignoring case."""
    return rows.filter(F.lower(F.col(column)) == F.lower(F.lit(topic)))


def api_results(posts: DataFrame, limit: int = K.API_RESULTS_DEFAULT) -> DataFrame:
    """What the search service returns: per topic the newest original posts tagged with it.

    The topic must be a whole tag, ignoring case. A retweet is recognised by its text.
    """
    if not K.API_RESULTS_MIN <= limit <= K.API_RESULTS_MAX:
        raise ValueError(f"limit must be {K.API_RESULTS_MIN} to {K.API_RESULTS_MAX}")
    tags = F.transform(P.extract_hashtags(F.col("text")), F.lower)
    wanted = posts.filter(
        ~F.startswith("text", F.lit(K.RETWEET_PREFIX))
        & F.array_contains(tags, F.lower("topic"))
    )
    return top_k(wanted, ["topic"], [F.desc("created_at"), F.asc("tweet_id")], limit)


def crisis_sample(
    posts: DataFrame, k: int = K.CRISIS_SAMPLE, keywords: Sequence[str] = K.REFERENCE_KEYWORDS
) -> DataFrame:
    """The first ``k`` crisis posts per topic: text and sentiment."""
    kept = filter_crisis(posts, keywords=keywords)
    order = [F.asc("created_at"), F.asc("tweet_id")]
    return top_k(kept, ["topic"], order, k).select("topic", "tweet_id", "text", "sentiment")


def engagement(
    posts: DataFrame, retweet_weight: float = 1.0, like_weight: float = 1.0
) -> DataFrame:
    """Retweets against likes of every post, with positions on log axes and the index."""
    retweets, likes = F.col("retweet_count"), F.col("like_count")
    return posts.select(
        "topic", "tweet_id", "text", "sentiment", "retweet_count", "like_count",
        F.round(P.log_axis(retweets), 6).alias("log_retweets"),
        F.round(P.log_axis(likes), 6).alias("log_likes"),
        P.engagement_index(retweets, likes, retweet_weight, like_weight)
        .alias("engagement_index"),
    )
