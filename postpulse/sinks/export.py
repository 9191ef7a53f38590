"""Exports of results and one report per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators.counts import with_crisis_score
from postpulse.operators.ranking import top_k


def write_csv(
    frame: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none"
) -> None:
    """Any result as CSV with a header; arrays and structs as JSON text."""
    flat = [
        F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map"))
        else F.col(name)
        for name, kind in frame.dtypes
    ]
    frame.select(flat).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', compression=compression,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Any result as JSON lines."""
    frame.write.mode(mode).json(path, ignoreNullFields=False)


def topic_reports(posts: DataFrame, k: int = K.TOP_HASHTAGS) -> DataFrame:
    """One JSON report per topic: key figures, sentiments, crisis level, top hashtags.

    Posts are read once: each counts under its tags and once without a tag, so the
    counts by topic and tag hold both the figures of the topic and those of its tags.
    """
    tags = F.transform(
        P.tags_with_topic(P.extract_hashtags(F.col("text")), F.col("topic")), F.lower)
    listed = posts.select(
        "topic", "sentiment", "retweet_count",
        P.is_crisis(F.col("cleaned_text")).alias("is_crisis"),
        F.concat(F.coalesce(tags, F.array().cast("array<string>")),
                 F.array(F.lit(None).cast("string"))).alias("tags"),
    )
    cells = listed.select("*", F.explode("tags").alias("hashtag")).groupBy("topic", "hashtag").agg(
        F.count("*").alias("count"),
        *[F.count_if(F.col("sentiment") == label).alias(f"{label.lower()}_posts")
          for label in K.SENTIMENTS],
        F.bround(F.avg("retweet_count"), 1).alias("avg_retweets"),
        F.count_if("is_crisis").alias("crisis_posts"),
    )
    # The row without tag comes first, then the best tags.
    order = [F.desc(F.col("hashtag").isNull()), F.desc("count"), F.asc("hashtag")]
    best = top_k(cells, ["topic"], order, k + 1)
    figures = ("positive_posts", "negative_posts", "neutral_posts", "avg_retweets", "crisis_posts")
    whole = F.struct(F.col("count").alias("total_posts"), *figures)
    ranked = F.struct((-F.col("count")).alias("order"), "hashtag", "count")
    # At most k tags per topic reach the list.
    by_topic = best.groupBy("topic").agg(
        F.max(F.when(F.col("hashtag").isNull(), whole)).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("hashtag").isNotNull(), ranked))).alias("ranked"))
    scored = with_crisis_score(by_topic.select("topic", "whole.*", "ranked"))
    report = F.to_json(F.struct(
        "topic", "total_posts", "positive_posts", "negative_posts", "neutral_posts",
        "avg_retweets", "crisis_posts",
        F.round("crisis_score", 4).alias("crisis_score"), "alert_level",
        F.transform(
            "ranked",
            lambda tag: F.struct(tag["hashtag"].alias("hashtag"), tag["count"].alias("count")),
        ).alias("top_hashtags"),
    ))
    return scored.select("topic", report.alias("report"))
