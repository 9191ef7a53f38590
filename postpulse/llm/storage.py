"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from postpulse.session import freed_shuffles, remove, scratch_path


def stored(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write the frame to the shared folder and read it from there.

    Cuts the lineage: a lost executor costs only the tasks that ran on it, since the
    files do not lie on executors. What the write shuffled is deleted at its end;
    ``discard`` deletes the files.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        frame.write.parquet(path, compression=compression)
    result = spark.read.schema(frame.schema).parquet(path)
    result._scratch_path = path
    return result


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` has returned, when nothing reads them any more."""
    for frame in frames:
        remove(frame.sparkSession, frame._scratch_path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like these that no column has, in any case."""
    longest = max((len(c) for c in columns), default=0)
    return [name + "_" * max(0, longest + 1 - len(name)) for name in names]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
