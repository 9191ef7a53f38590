"""Data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse.schemas import POSTS


class InputRejected(ValueError):
    """The input cannot be imported at all."""


def require_columns(frame: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """The frame itself, or an error naming the columns it lacks."""
    missing = [name for name in columns if name not in frame.columns]
    if missing:
        raise InputRejected(f"input has no column {', '.join(missing)}")
    return frame


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error if it has no row."""
    if frame.isEmpty():
        raise InputRejected(f"no rows found for {what}")
    return frame


def empty_posts(spark: SparkSession) -> DataFrame:
    """No posts, with the right schema: every view of it is empty as well."""
    return spark.createDataFrame([], POSTS)


def sentiment_domain(
    posts: DataFrame, by: Sequence[str] = (), allowed: Sequence[str] = K.SENTIMENTS
) -> DataFrame:
    """Number of posts per sentiment value and whether the value is allowed."""
    valid = F.coalesce(F.col("sentiment").isin(*allowed), F.lit(False))
    return posts.groupBy(*by, "sentiment", valid.alias("is_valid")).agg(
        F.count("*").alias("n_posts")
    )
