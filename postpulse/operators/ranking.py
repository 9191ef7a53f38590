"""Top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def top_k(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group in a total ``order``.

    Each input partition first cuts a group to ``k`` rows, so a large group does not
    reach one task as a whole: Spark's window group limit does that up to a threshold,
    above it the groups are cut by input partition. ``rank`` names a column for the
    position, if wanted.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    position = "__position"

    def cut(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn(position, F.row_number().over(window)).filter(
            F.col(position) <= k
        )

    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        rows = cut(rows.withColumn("__split", F.spark_partition_id()), [*by, "__split"])
        rows = rows.drop(position, "__split")
    ranked = cut(rows, by)
    if rank:
        return ranked.withColumnRenamed(position, rank)
    return ranked.drop(position)
