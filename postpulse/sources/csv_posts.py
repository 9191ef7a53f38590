"""Posts from CSV files with varying headers.

A row with more cells than its file has headers does not fit. It is left out of the posts
and kept, as it is written, in a table of rejected rows. A row with fewer cells fits; what
it lacks is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators.filters import filter_topic_rows
from postpulse.operators.quality import require_columns

RAW, FILE = "__raw", "__file"
TOO_MANY_CELLS = "more cells than headers"


def _first_lines(rows: Iterator[Row]) -> Iterator[tuple[str, str]]:
    """The first line of the file of a task; the rest of the file is not read."""
    for row in rows:
        if row["start"] == 0:
            yield row["file"], row["value"]
        return


def _literal(path: str) -> str:
    """A path as a pattern that only it matches."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files below ``path``, those with the same first line together, as patterns.

    Every file, or part of a large one, is a task of its own, which stops after the first
    line. What reaches the driver is a line per file, as a listing of the files does.
    """
    # Settings of this session only: no file shares a task with another one.
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    lines = own.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    groups: dict[str, list[str]] = {}
    for file, header in sorted(lines.rdd.mapPartitions(_first_lines).collect()):
        groups.setdefault(header.removeprefix("\ufeff").rstrip("\r"), []).append(
            _literal(unquote(file)))
    return list(groups.values()) or [[path] if isinstance(path, str) else path]


def _cells(raw: F.Column) -> F.Column:
    """The cells of a record up to the last that is not empty."""
    bare = F.regexp_replace(F.btrim(raw, F.lit("\r\n")), '"[^"]*"', "_")
    return F.regexp_count(F.regexp_replace(bare, ",+$", ""), F.lit(",")) + 1


def _read_alike(spark: SparkSession, files: list[str], multiline: bool) -> DataFrame:
    """All cells of files with one header as text, and rows that do not fit as ``RAW``."""
    options = {
        "header": True, "multiLine": multiline, "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    # The names of one file are those of all; its first line does not need more of the file.
    names = spark.read.csv(files[0], **{**options, "multiLine": False}).columns
    schema = StructType([StructField(name, StringType()) for name in [*names, RAW]])
    # Every cell is looked at, or a row's length would not be known: nothing is pruned, and
    # the condition below, which always holds, names all columns.
    frame = spark.read.schema(schema).option("columnPruning", False).csv(
        files, columnNameOfCorruptRecord=RAW, **options)
    whole = F.length(F.concat_ws("", *[F.col(f"`{name}`") for name in names])) >= 0
    surplus = F.col(RAW).isNotNull() & whole & (_cells(F.col(RAW)) > len(names))
    return frame.select(
        *[F.when(~F.col(f"`{name}`").isin(*K.NA_TOKENS), F.col(f"`{name}`")).alias(name)
          for name in names],
        F.when(surplus, F.col(RAW)).alias(RAW), F.col("_metadata.file_path").alias(FILE))


def _fitting(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col(RAW).isNull()).drop(RAW, FILE)


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """All columns of the rows that fit as text, missing-value spellings as null.

    Files with different headers are read apart and put together by column names; a
    column that a file lacks is null in its rows. With ``multiline`` a cell may hold
    line breaks, and a file is read by one task; turn it off to split large files that
    have none.
    """
    merged = None
    for files in files_by_header(spark, path):
        frame = _fitting(_read_alike(spark, files, multiline))
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return merged


def rejected_rows(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Rows that do not fit: ``file`` (its path), ``reason``, ``raw`` (the row as written)."""
    url = F.col(FILE)
    parts = [
        _read_alike(spark, files, multiline).filter(F.col(RAW).isNotNull()).select(
            F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))).alias("file"),
            F.lit(TOO_MANY_CELLS).alias("reason"),
            F.btrim(F.col(RAW), F.lit("\r\n")).alias("raw"))
        for files in files_by_header(spark, path)
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _header(name: str, position: int) -> str:
    """The header as written: Spark appends the position to headers that differ in case."""
    known = {header for header, _ in K.CSV_ALIASES}
    bare = re.sub(f"{position}$", "", name)
    return bare if name not in known and bare in known else name


def alias_columns(frame: DataFrame) -> DataFrame:
    """Known headers become canonical columns; other columns pass through.

    Several headers of one canonical column are coalesced in the order of the map.
    """
    headers = {_header(name, i): name for i, name in enumerate(frame.columns)}
    sources: dict[str, list[str]] = {}
    for header, canonical in K.CSV_ALIASES:
        if header in headers:
            sources.setdefault(canonical, []).append(headers[header])
    for canonical, _ in K.CSV_DEFAULTS:
        if canonical in headers and headers[canonical] not in sources.get(canonical, []):
            sources.setdefault(canonical, []).append(headers[canonical])
    used = {name for names in sources.values() for name in names}
    return frame.select(
        *[F.coalesce(*[F.col(f"`{name}`") for name in names]).alias(canonical)
          for canonical, names in sources.items()],
        *[F.col(f"`{name}`") for name in frame.columns if name not in used],
    )


def fill_defaults(frame: DataFrame, now: datetime) -> DataFrame:
    """Add the columns the file lacks; without a text column the file is rejected."""
    require_columns(frame, ["text"])
    added = {
        name: F.lit(now.isoformat() if name == "created_at" else default).cast("string")
        for name, default in K.CSV_DEFAULTS
        if name not in frame.columns
    }
    return frame.withColumns(added) if added else frame


def typed_posts(frame: DataFrame, topic: str, now: datetime) -> DataFrame:
    """Posts with the right types, plus ``tags`` of the tag column and the text."""
    at = F.lit(now.isoformat()).cast("timestamp")
    text = P.fill_text(F.col("text"), "")
    return frame.select(
        F.lit(topic).alias("topic"),
        at.alias("requested_at"),
        P.post_id(text).alias("tweet_id"),
        text.alias("text"),
        P.to_timestamp(F.col("created_at"), at).alias("created_at"),
        P.to_count(F.col("retweet_count")).alias("retweet_count"),
        P.to_count(F.col("like_count")).alias("like_count"),
        P.fill_text(F.col("username"), K.UNKNOWN_USER).alias("username"),
        P.to_count(F.col("user_followers")).alias("user_followers"),
        F.col("location"),
        P.fill_text(F.col("platform"), K.DEFAULT_PLATFORM).alias("platform"),
        P.parse_tag_list(F.col("hashtags"), text).alias("tags"),
        F.lit("csv").alias("source"),
    )


def named_posts(
    spark: SparkSession, path: str | list[str], now: datetime, multiline: bool = True
) -> DataFrame:
    """Rows that fit, by canonical columns: headers are mapped, and missing columns filled, as
    each kind of file has them."""
    named = None
    for files in files_by_header(spark, path):
        rows = _fitting(_read_alike(spark, files, multiline))
        filled = fill_defaults(alias_columns(rows), now)
        named = filled if named is None else named.unionByName(filled, allowMissingColumns=True)
    return named


def read_posts(
    spark: SparkSession,
    path: str | list[str],
    topic: str,
    now: datetime | None = None,
    literal: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """Posts of a CSV whose tag column matches the topic.

    ``now`` stands for unreadable times; it is fixed once per import.
    """
    now = now or datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    matching = filter_topic_rows(
        named_posts(spark, path, now, multiline), topic, "hashtags", literal)
    return typed_posts(matching, topic, now)
