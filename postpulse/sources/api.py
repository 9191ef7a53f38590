"""Posts from landed responses of the search API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.schemas import API_RESPONSE


def posts_of(responses: DataFrame) -> DataFrame:
    """One row per post of each response, with its author.

    Authors come with the response (at most 100), so they are looked up inside the
    row. A post without author stays, unnamed; one without id gets that of its text; a
    response without posts gives none.
    """
    users = F.col("includes.users")
    author = F.get(
        F.filter("users", lambda user: user["id"] == F.col("post.author_id")), F.lit(0)
    )
    exploded = responses.select(
        "topic", "requested_at", users.alias("users"), F.explode("data").alias("post")
    )
    return exploded.withColumn("author", author).select(
        "topic",
        "requested_at",
        F.coalesce("post.id", P.post_id(F.coalesce("post.text", F.lit("")))).alias("tweet_id"),
        P.fill_text(F.col("post.text"), "").alias("text"),
        F.coalesce("post.created_at", "requested_at").alias("created_at"),
        F.coalesce("post.public_metrics.retweet_count", F.lit(0).cast("long"))
        .alias("retweet_count"),
        F.coalesce("post.public_metrics.like_count", F.lit(0).cast("long")).alias("like_count"),
        P.fill_text(F.col("author.username"), K.UNKNOWN_USER).alias("username"),
        F.coalesce("author.public_metrics.followers_count", F.lit(0).cast("long"))
        .alias("user_followers"),
        F.lit(None).cast("string").alias("location"),
        F.lit(K.DEFAULT_PLATFORM).alias("platform"),
    )


def read_batch(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Posts of all landed responses, one JSON object per line."""
    return posts_of(spark.read.schema(API_RESPONSE).json(path))


def read_stream(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """The same as a stream of newly landed files; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(API_RESPONSE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return posts_of(reader.json(path))
