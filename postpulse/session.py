"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from postpulse.shipping import ship

# Settings the operators are written for. Adaptive execution splits skewed join
# partitions, merges small ones and picks broadcast joins from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


# Deletes the shuffle files of a statement when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app: str = "postpulse", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """A session with ``SETTINGS`` whose executors have this package.

    ``extra`` adds to the settings or overrides them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster, reachable from every executor.

    Taken from ``spark.checkpoint.dir``, or from the context if the application set
    it there. Only a local-mode session without either gets a temporary folder; a
    cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="postpulse-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go when the write has ended.

    Otherwise they stay until the driver happens to collect its garbage, which a driver that
    only plans may not do before a job of many writes has filled the disk.
    """
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in the file system it names; none if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(status.getPath().toString() for status in found or ())
