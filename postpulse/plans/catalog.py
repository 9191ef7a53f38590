"""Every operator as a query over the driver's tables.

Each entry takes the session and the folder of the tables and returns a DataFrame;
``oracle.py`` has the same results in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postpulse import constants as K
from postpulse import functions as P
from postpulse.operators import counts, filters, joins, nlp, quality, runs, sets
from postpulse.operators.ranking import top_k
from postpulse.plans import driver_views as V
from postpulse.session import remove, scratch_path
from postpulse.sinks import compaction, export, store
from postpulse.sources import api, csv_posts
from postpulse.sources import store as stored
from postpulse.streaming import sinks as stream_sinks
from postpulse.streaming import views as stream_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENTITIES = (
    ("SparkDev", "PRODUCT"), ("Tech", "ORG"), ("Emergency", "EVENT"),
    ("purchase Tech", "DEAL"), ("bad view", "REVIEW"), ("bad view SparkDev", "REVIEW"),
    ("terrible error spark", "INCIDENT"), ("not good bad view", "VERDICT"),
    ("not good bad view SparkDev", "VERDICT"), ("terrible-error", "FAULT"), ("Tech", "ORG"),
    (None, "ORG"), ("view", None), ("--", "SIGN"),
)
IMPORT_TIME = datetime(2024, 3, 1, 12, 0, 0)


def query(function: Query) -> Query:
    """Register under the function's name; times come out without a time zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = function(spark, sf_dir)
        return frame.select([
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in frame.dtypes
        ])

    QUERIES[function.__name__] = run
    return run


# --- inputs -------------------------------------------------------------------
def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.posts(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).withColumn("cleaned_text", P.clean_text(F.col("text")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.score_posts(posts(spark, sf_dir))


def requested(frame: DataFrame) -> DataFrame:
    """Posts whose poll happened when they were written."""
    return frame.withColumn("requested_at", F.col("created_at"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per event, read from the events alone."""
    topic = F.when(F.col("event_id") % 2 == 0, "spark").otherwise("tech")
    return V.table(spark, sf_dir, "events").select(
        topic.alias("topic"), F.col("ts").cast("timestamp").alias("requested_at")
    )


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls and imports of topics in two spellings; one topic is only imported."""
    i, kind = F.col("event_id"), F.col("event_type")
    topic = (
        F.when(kind == "click", "Spark").when(kind == "view", "archive")
        .when(i % 2 == 0, "spark").otherwise("tech")
    )
    source = F.when(kind.isin("view", "signup"), "csv").otherwise("api")
    return V.table(spark, sf_dir, "events").select(
        topic.alias("topic"), F.col("ts").cast("timestamp").alias("requested_at"),
        source.alias("source"),
    )


def csv_cells() -> list[Column]:
    """Posts as the cells of a CSV under one set of headers."""
    i, kind = F.col("event_id"), F.col("event_type")
    count = F.col("like_count").cast("string")
    return [
        F.col("text").alias("Tweet-Text"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("username").alias("Author"),
        F.col("retweet_count").cast("string").alias("Retweets"),
        F.when(i % 2 == 0, count).alias("Likes"),
        F.when(i % 2 == 1, count).otherwise("0").alias("Favorites"),
        F.col("location").alias("Country"),
        tag_cell(i, kind).alias("Hashtags"),
        kind.alias("event_type"),
    ]


def tag_cell(i: Column, kind: Column) -> Column:
    """A tag cell as list, as plain tags, as a broken list, or missing."""
    return (
        F.when(i % 4 == 0, F.concat(F.lit("['#Spark', '"), kind, F.lit("']")))
        .when(i % 4 == 1, F.concat(F.lit("#SparkSQL #"), kind))
        .when(i % 4 == 2, F.concat(F.lit("['#Tech', #"), kind))
    )


def landed_csv(spark: SparkSession, sf_dir: str) -> str:
    """Files with three sets of headers in folders of odd names, and one with rows too long."""
    path = scratch_path(spark, "csv")
    rows = posts(spark, sf_dir).select("event_id", "retweet_count", *csv_cells())
    kind = F.col("event_id") % 3
    export.write_csv(rows.filter(kind == 0).drop("event_id", "retweet_count"),
                     f"{path}/posts of {{1}} [a b]", compression="gzip")
    export.write_csv(rows.filter(kind == 1).select(
        F.col("Tweet-Text").alias("Text"), F.col("Timestamp").alias("DateTime"),
        F.col("Author").alias("User"), "retweet_count", F.col("Country").alias("Place"), "Hashtags",
        "event_type"), f"{path}/100% other+more", compression="gzip")
    export.write_csv(rows.filter(kind == 2).select(
        F.col("Tweet-Text").alias("Tweet"), "event_type"), f"{path}/texts", compression="gzip")
    key = F.col("n_nationkey").cast("string")
    line = F.concat(F.lit('"Hello, '), "n_name", F.lit('",u'), key, F.when(
        F.col("n_nationkey") % 3 == 0, F.concat(F.lit(",EXTRA,"), key)).otherwise(""))
    lines = V.table(spark, sf_dir, "nation").agg(F.concat(
        F.lit("Text,User\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("file"))
    lines.write.text(f"{path}/rows too long")
    return f"{path}/*"


def landed_responses(spark: SparkSession, sf_dir: str) -> str:
    """Posts as API responses of one post each; every 23rd comes without id."""
    path = scratch_path(spark, "responses")
    author = F.when(F.col("event_id") % 19 == 0, "gone").otherwise(F.col("username"))
    post = F.struct(
        F.when(F.col("event_id") % 23 != 0, F.col("tweet_id")).alias("id"), "text", "created_at", author.alias("author_id"),
        F.struct("retweet_count", "like_count").alias("public_metrics"),
    )
    user = F.struct(
        F.col("username").alias("id"), "username",
        F.struct(F.col("user_followers").alias("followers_count")).alias("public_metrics"),
    )
    posts(spark, sf_dir).select(
        "topic", F.col("created_at").alias("requested_at"),
        F.array(post).alias("data"),
        F.struct(F.array(user).alias("users")).alias("includes"),
    ).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path, compression="gzip")
    return path


def filled_store(spark: SparkSession, sf_dir: str) -> str:
    """A store holding all posts, written twice under one batch as after a failure."""
    root = scratch_path(spark, "store")
    store.init_tables(spark, root)
    store.init_tables(spark, root)
    for _ in range(2):
        store.ingest(root, requested(scored(spark, sf_dir)), "all")
    return root


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame by way of a table, as an operator reads what another one stored."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def placed_posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts with their search run, and the searches."""
    asked = requests(spark, sf_dir)
    folded = written(runs.topic_runs(asked), "runs")
    placed = runs.assign_runs(requested(posts(spark, sf_dir)), folded)
    return placed, runs.searches_of(asked, folded)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir)
    return runs.searches_of(asked, written(runs.topic_runs(asked), "runs"))


def entity_dict(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, "entity string, label string")


# Words that only change the next one, entries of several words, and entries that do not count.
MORE_POLARITIES = (
    ("view", None, 1.5), ("sparkdev", 0.2, None), ("tech", -0.4, 1.0), ("good bad", 0.3, None),
    ("terrible error spark", -0.9, None), ("click", None, 0.5), ("not good bad view", 0.6, 1.0),
    ("not good bad view", 0.5, 9.0), (None, 0.5, None), ("the", None, None), ("great", -1.0, 2.0),
)


def lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon as a table, with a null word, a null polarity and a lower duplicate."""
    flawed = [*K.LEXICON.items(), (None, 0.5), ("the", None), ("great", -1.0)]
    return spark.createDataFrame(flawed, "word string, polarity double")


def fuller_lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon with ``MORE_POLARITIES``."""
    more = [*((word, value, None) for word, value in K.LEXICON.items()), *MORE_POLARITIES]
    return spark.createDataFrame(more, "word string, polarity double, intensity double")


def stopwords(spark: SparkSession) -> DataFrame:
    """The stop words as a table, with a null and a duplicate."""
    return spark.createDataFrame([(word,) for word in (*K.STOPWORDS, None, "the")], "word string")


def joined(tags: Column) -> Column:
    return F.array_join(tags, ",")


# --- sources ------------------------------------------------------------------
@query
def src_csv_posts(spark, sf_dir):
    path = landed_csv(spark, sf_dir)
    frame = csv_posts.read_csv(spark, path).withColumnRenamed("Tweet-Text", "Tweet_Text")
    rejected = csv_posts.rejected_rows(spark, path).select("reason", F.col("raw").alias("rejected"))
    return frame.unionByName(rejected, allowMissingColumns=True)


@query
def src_csv_alias(spark, sf_dir):
    return csv_posts.alias_columns(csv_posts.read_csv(spark, landed_csv(spark, sf_dir)))


@query
def src_csv_defaults(spark, sf_dir):
    frame = csv_posts.named_posts(spark, landed_csv(spark, sf_dir), IMPORT_TIME)
    return csv_posts.typed_posts(frame, "spark", IMPORT_TIME).drop("tweet_id").withColumn(
        "tags", joined(F.col("tags"))
    )


@query
def src_api_batch(spark, sf_dir):
    return api.read_batch(spark, landed_responses(spark, sf_dir))


@query
def src_api_filter(spark, sf_dir):
    return filters.api_results(posts(spark, sf_dir)).select(
        "topic", "tweet_id", "text", "created_at"
    )


@query
def src_api_stream(spark, sf_dir):
    arriving = api.read_stream(spark, landed_responses(spark, sf_dir))
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    stream_sinks.start_rows(arriving, path, checkpoint).awaitTermination()
    return spark.read.schema(arriving.schema).parquet(path)


@query
def src_store_tables(spark, sf_dir):
    """The latest runs in a store of four batches, each over the whole time, folded in three
    turns; the last batch is written again after it was folded."""
    root = scratch_path(spark, "store")
    store.init_tables(spark, root)
    everything = requested(scored(spark, sf_dir)).withColumn("part", F.col("event_id") % 4)
    everything = everything.select(*[c for c in everything.columns if c in store.STAGED], "part")
    scored_path = scratch_path(spark, "scored")
    everything.write.parquet(scored_path, compression=compaction.COMPRESSION)
    parts = spark.read.schema(everything.schema).parquet(scored_path)
    for part in range(4):
        store.ingest(root, parts.filter(F.col("part") == part), f"part {part}")
        if part == 2:
            compaction.compact(spark, root)
            compaction.clean_up(spark, root)
    compaction.compact(spark, root)
    compaction.clean_up(spark, root)
    store.ingest(root, parts.filter("part = 3"), "part 3")
    remove(spark, scored_path)
    compaction.compact(spark, root)
    compaction.clean_up(spark, root)
    latest = stored.read_latest(spark, root)
    return latest["tweets"].select(
        "topic", "run_start", "tweet_id", "cleaned_text", "sentiment", "created_at",
        "retweet_count", "username", "location", "hour",
    )


# --- sinks --------------------------------------------------------------------
@query
def snk_init_tables(spark, sf_dir):
    root = filled_store(spark, sf_dir)
    parts = [
        stored.read_table(spark, root, name).agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows")
        for name in store.STORE_TABLES
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query
def snk_append_run(spark, sf_dir):
    root = filled_store(spark, sf_dir)
    run_of = stored.read_table(spark, root, "searches").select(
        "search_id", "topic", F.col("timestamp").alias("run_start"), "source"
    )
    metrics = stored.read_table(spark, root, "analytics")
    tags = stored.read_table(spark, root, "hashtags").select(
        "search_id", F.concat(F.lit("hashtag_"), "hashtag").alias("metric"),
        F.col("count").cast("string").alias("value"),
    )
    return metrics.unionByName(tags).join(run_of, "search_id").drop("search_id")


@query
def snk_export_csv_json(spark, sf_dir):
    volume = counts.hourly_volume(posts(spark, sf_dir))
    as_csv, as_json = scratch_path(spark, "csv"), scratch_path(spark, "json")
    export.write_csv(volume, as_csv)
    export.write_json(volume, as_json)
    schema = StructType(volume.schema.fields)
    return (
        spark.read.schema(schema).csv(as_csv, header=True).withColumn("format", F.lit("csv"))
        .unionByName(
            spark.read.schema(schema).json(as_json).withColumn("format", F.lit("json"))
        )
    )


@query
def snk_report_json(spark, sf_dir):
    return export.topic_reports(scored(spark, sf_dir))


# --- filters and projections ----------------------------------------------------
@query
def flt_topic_rows(spark, sf_dir):
    tagged = posts(spark, sf_dir).withColumn(
        "hashtags", tag_cell(F.col("event_id"), F.col("event_type"))
    )
    return filters.filter_topic_rows(tagged, "Spark(SQL)?").select("tweet_id", "hashtags")


@query
def flt_topic_tags(spark, sf_dir):
    tagged = posts(spark, sf_dir).withColumn("tags", P.extract_hashtags(F.col("text")))
    return filters.filter_topic_tags(tagged).select(
        "topic", "tweet_id", joined(F.col("tags")).alias("tags")
    )


@query
def flt_crisis(spark, sf_dir):
    return filters.filter_crisis(cleaned(spark, sf_dir)).select(
        "topic", "tweet_id", F.length("cleaned_text").alias("n_chars")
    )


@query
def flt_metric_prefix(spark, sf_dir):
    frame = scored(spark, sf_dir)
    metrics = counts.sentiment_counts(frame, by=("topic",))
    totals = frame.groupBy("topic").agg(F.count("*").cast("string").alias("value"))
    others = totals.withColumn("metric", F.lit("total_posts"))
    return filters.filter_metric_prefix(written(metrics.unionByName(others), "metrics"))


@query
def flt_run_scope(spark, sf_dir):
    placed, searched = placed_posts(spark, sf_dir)
    runs_by_topic = joins.latest_runs(searched)
    newest = filters.filter_topic(runs_by_topic, "tech").select("search_id").scalar()
    return filters.filter_run(placed, newest).select("topic", "tweet_id", "run_start")


@query
def flt_topic_eq_ci(spark, sf_dir):
    spelled = posts(spark, sf_dir).withColumn(
        "topic", F.when(F.col("event_type") == "click", F.upper("topic")).otherwise(F.col("topic"))
    )
    return filters.filter_topic(spelled, "sPark").select("topic", "tweet_id")


@query
def prj_engagement(spark, sf_dir):
    return filters.engagement(scored(spark, sf_dir))


@query
def prj_crisis_sample(spark, sf_dir):
    return filters.crisis_sample(scored(spark, sf_dir))


# --- joins --------------------------------------------------------------------
@query
def jn_post_author(spark, sf_dir):
    users = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("author_id"),
        F.col("c_name").alias("username"),
        F.floor(F.abs("c_acctbal")).cast("long").alias("user_followers"),
    )
    author = F.when(F.col("event_id") % 19 == 0, "gone").otherwise(
        F.col("user_id").cast("string")
    )
    authored = V.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("tweet_id"), author.alias("author_id")
    )
    return joins.join_authors(authored, users)


@query
def jn_latest_run(spark, sf_dir):
    placed, searched = placed_posts(spark, sf_dir)
    newest = joins.join_latest_run(placed.drop("run_start"), searched)
    return newest.select("topic", "run_start", "tweet_id", "username", "retweet_count")


def spelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose locations name a town as well, or have a typing error."""
    i, place = F.col("event_id"), F.col("location")
    return posts(spark, sf_dir).withColumn("location", (
        F.when(i % 7 == 0, F.concat(F.lit("Old Town, "), place))
        .when(i % 7 == 1, F.concat(F.lit("Port "), place))
        .when(i % 7 == 2, F.replace(F.lower(place), F.lit("nation"), F.lit("nattion")))
        .when(i % 7 == 3, F.concat(F.lit("Harbour/"), place, F.lit("x")))
        .otherwise(place)))


@query
def jn_geocode(spark, sf_dir):
    counted = counts.location_counts(spelled_posts(spark, sf_dir))
    return joins.geocode(counted, V.gazetteer(spark, sf_dir))


@query
def jn_geo_markers(spark, sf_dir):
    counted = counts.location_counts(posts(spark, sf_dir))
    return joins.geo_markers(counted, V.gazetteer(spark, sf_dir))


# --- aggregates -----------------------------------------------------------------
@query
def agg_hashtag_counts(spark, sf_dir):
    return counts.hashtag_counts(posts(spark, sf_dir))


@query
def agg_hashtag_counts_all(spark, sf_dir):
    return counts.hashtag_counts(posts(spark, sf_dir), by=(), topic=None)


@query
def agg_sentiment_counts(spark, sf_dir):
    return counts.sentiment_counts(scored(spark, sf_dir), by=("topic",))


@query
def agg_sentiment_share(spark, sf_dir):
    metrics = counts.sentiment_counts(scored(spark, sf_dir), by=("topic", "event_type"))
    return counts.sentiment_share(written(metrics, "metrics"))


@query
def agg_hourly_volume(spark, sf_dir):
    return counts.hourly_volume(posts(spark, sf_dir))


@query
def agg_top_users(spark, sf_dir):
    return counts.top_users(posts(spark, sf_dir))


@query
def agg_influencers(spark, sf_dir):
    return counts.influencers(posts(spark, sf_dir))


@query
def agg_entity_counts(spark, sf_dir):
    found = nlp.find_entities(cleaned(spark, sf_dir), entity_dict(spark))
    return nlp.entity_counts(found)


@query
def agg_location_counts(spark, sf_dir):
    return counts.location_counts(posts(spark, sf_dir))


@query
def agg_geo_center(spark, sf_dir):
    counted = counts.location_counts(posts(spark, sf_dir))
    return counts.geo_center(joins.geocode(counted, V.gazetteer(spark, sf_dir)))


@query
def agg_kpi_row(spark, sf_dir):
    return counts.kpi_row(scored(spark, sf_dir))


@query
def agg_crisis_score(spark, sf_dir):
    return counts.crisis_scores(cleaned(spark, sf_dir))


@query
def agg_crisis_score_fixed(spark, sf_dir):
    return counts.crisis_scores(
        cleaned(spark, sf_dir), by=("event_type",), keywords=K.FIXED_KEYWORDS,
        thresholds=((90, "HIGH"), (40, "MODERATED")),
    )


@query
def agg_word_freq(spark, sf_dir):
    return nlp.word_frequencies(cleaned(spark, sf_dir), stopwords(spark))


@query
def agg_word_bigrams(spark, sf_dir):
    return nlp.word_bigrams(cleaned(spark, sf_dir))


@query
def agg_word_cloud(spark, sf_dir):
    return nlp.word_cloud(cleaned(spark, sf_dir), stopwords(spark))


# --- first row per group ----------------------------------------------------------
@query
def win_latest_run(spark, sf_dir):
    return joins.latest_runs(searches(spark, sf_dir)).select("topic", "timestamp", "source")


@query
def win_dedupe_user(spark, sf_dir):
    return sets.first_per_user(posts(spark, sf_dir)).select(
        "topic", "username", "user_followers", "tweet_id", "created_at", "location"
    )


def _named_runs(runs_of: DataFrame) -> DataFrame:
    return runs_of.select(
        "topic_key",
        F.timestamp_seconds("second").alias("requested_at"),
        F.timestamp_seconds("run_second").alias("run_start"),
    )


@query
def win_topic_runs(spark, sf_dir):
    return _named_runs(runs.topic_runs(requests(spark, sf_dir)))


@query
def win_topic_runs_ci(spark, sf_dir):
    return _named_runs(runs.topic_runs(mixed_requests(spark, sf_dir)))


# --- top-k ------------------------------------------------------------------------
@query
def top_hashtags(spark, sf_dir):
    stored_counts = counts.hashtag_counts(posts(spark, sf_dir), by=("topic", "username"))
    return counts.top_hashtags(stored_counts)


@query
def top_topics_recent(spark, sf_dir):
    history = V.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("topic"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return sets.recent_topics(history)


@query
def top_locations(spark, sf_dir):
    return counts.top_locations(counts.location_counts(posts(spark, sf_dir)))


# --- set operations ---------------------------------------------------------------
def _post_columns(frame: DataFrame) -> DataFrame:
    return frame.select("topic", "tweet_id", "username", "created_at", "retweet_count")


@query
def set_append_posts(spark, sf_dir):
    batch = _post_columns(posts(spark, sf_dir))
    return sets.append_posts(batch, batch)


@query
def set_merge_tag_counts(spark, sf_dir):
    batch = counts.hashtag_counts(posts(spark, sf_dir))
    return counts.merge_hashtag_counts(batch, batch)


@query
def set_distinct_locations(spark, sf_dir):
    return sets.distinct_locations(posts(spark, sf_dir))


# --- functions ----------------------------------------------------------------------
@query
def fn_clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir).select("tweet_id", "cleaned_text")


@query
def fn_extract_hashtags(spark, sf_dir):
    tags = P.extract_hashtags(F.col("text"))
    return posts(spark, sf_dir).select(
        "tweet_id", joined(tags).alias("tags"), F.size(tags).cast("long").alias("n_tags")
    )


@query
def fn_parse_tag_list(spark, sf_dir):
    cell = tag_cell(F.col("event_id"), F.col("event_type"))
    return posts(spark, sf_dir).select(
        "tweet_id", joined(P.parse_tag_list(cell, F.col("text"))).alias("tags")
    )


@query
def fn_sentiment_label(spark, sf_dir):
    return scored(spark, sf_dir).select("tweet_id", "sentiment")


def number_cell() -> Column:
    """Whole numbers, fractions, exponents and texts that are no numbers."""
    i = F.col("event_id")
    whole = F.floor("value").cast("long").cast("string")
    return (
        F.when(i % 8 == 0, whole)
        .when(i % 8 == 1, F.concat(F.lit(" -"), whole, F.lit(".9 ")))
        .when(i % 8 == 2, F.concat(whole, F.lit("d")))
        .when(i % 8 == 3, F.concat(F.lit("1,"), whole))
        .when(i % 8 == 4, F.concat(whole, F.lit("e2")))
        .when(i % 8 == 5, F.concat(F.lit("."), whole))
        .when(i % 8 == 6, F.lit("inf"))
    )


@query
def fn_to_count(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        "event_id", P.to_count(number_cell()).alias("count")
    )


@query
def fn_to_timestamp(spark, sf_dir):
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    cell = (
        F.when(i % 8 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(i % 8 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(i % 8 == 2, F.date_format(ts, "MM/dd/yyyy HH:mm:ss"))
        .when(i % 8 == 3, F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy"))
        .when(i % 8 == 4, F.date_format(ts, "MMM d yyyy HH:mm:ss"))
        .when(i % 8 == 5, F.concat(F.unix_seconds(ts).cast("string"), F.lit("000000000")))
        .when(i % 8 == 6, F.lit("junk"))
    )
    now = F.lit(IMPORT_TIME.isoformat()).cast("timestamp")
    return V.table(spark, sf_dir, "events").select(
        "event_id", P.to_timestamp(cell, now).alias("created_at")
    )


@query
def fn_date_parts(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", *P.date_parts(F.col("ts")))


@query
def fn_floor_hour(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        "event_id", P.floor_hour(F.col("ts")).alias("hour")
    )


@query
def fn_norm_location(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "tweet_id", P.normalise_location(F.col("location")).alias("location")
    )


@query
def fn_post_id(spark, sf_dir):
    """The id is as fine as the text: documents, copies among them, get as many ids."""
    return V.table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n_texts"),
        F.count_distinct(P.post_id(F.col("text"))).alias("n_ids"),
    )


@query
def fn_alert_level(spark, sf_dir):
    score = F.floor("value") / 4
    return V.table(spark, sf_dir, "events").select(
        "event_id",
        P.alert_level(score).alias("alert_level"),
        P.alert_level(score, ((50, "LOUD"), (10, "AUDIBLE"))).alias("own_level"),
    )


@query
def fn_engagement_index(spark, sf_dir):
    index = P.engagement_index(F.col("retweet_count"), F.col("like_count"), 2.0, 0.5)
    return posts(spark, sf_dir).select("tweet_id", index.alias("engagement_index"))


@query
def fn_fill_str(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "tweet_id", P.fill_text(F.col("location"), K.UNKNOWN_USER).alias("location")
    )


# --- text analytics -------------------------------------------------------------------
@query
def txt_polarity(spark, sf_dir):
    frame = nlp.with_polarity(cleaned(spark, sf_dir), fuller_lexicon(spark))
    return frame.select("tweet_id", "polarity")


@query
def txt_polarity_words(spark, sf_dir):
    """A table of single words and the same words as part of the program agree on all posts."""
    frame = nlp.with_polarity(cleaned(spark, sf_dir), lexicon(spark)).withColumnRenamed(
        "polarity", "by_table")
    both = nlp.with_polarity(frame, K.LEXICON)
    return both.select("tweet_id", "polarity", (F.col("polarity") == F.col("by_table")).alias("agree"))


@query
def txt_entities(spark, sf_dir):
    return nlp.find_entities(cleaned(spark, sf_dir), entity_dict(spark))


@query
def txt_topics_lda(spark, sf_dir):
    return nlp.lda_topics(cleaned(spark, sf_dir))


@query
def txt_topics_lda_facts(spark, sf_dir):
    """What SQL can state of the topics, whatever the model."""
    frame = cleaned(spark, sf_dir)
    return nlp.topic_facts(nlp.lda_topics(frame), frame)


@query
def txt_topic_coherence(spark, sf_dir):
    """Coherence of the ten words that are in most posts of each topic."""
    frame = cleaned(spark, sf_dir)
    words = frame.select("topic", F.explode(F.array_distinct(
        nlp.lda_words(F.col("cleaned_text")))).alias("word"))
    counted = words.groupBy("topic", "word").agg(F.count("*").alias("n"))
    best = written(top_k(counted, ["topic"], [F.desc("n"), F.asc("word")], 10), "words")
    return nlp.topic_coherence(best, frame, "topic")


@query
def txt_geo_resolve(spark, sf_dir):
    located = sets.distinct_locations(spelled_posts(spark, sf_dir))
    return joins.resolve_locations(located, V.gazetteer(spark, sf_dir))


# --- streams ----------------------------------------------------------------------------
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events in several files and micro-batches, each over the whole time, so
    that many are hours late."""
    events, path = V.table(spark, sf_dir, "events"), scratch_path(spark, "events")
    events.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def late_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of ``late_events``."""
    return V.posts_from(spark, sf_dir, late_events(spark, sf_dir))


def _counted(stream: DataFrame, view: stream_views.CountView) -> DataFrame:
    """Run a view over all input and read it, from compacted sums."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    stream_sinks.start_counts(stream, view, path, checkpoint).awaitTermination()
    stream_sinks.compact_counts(spark, path, view, stream.schema)
    return stream_sinks.read_counts(spark, path, view, stream.schema)


@query
def st_hourly_volume(spark, sf_dir):
    return _counted(late_posts(spark, sf_dir), stream_views.hourly_volume())


@query
def st_hashtag_counts(spark, sf_dir):
    return _counted(late_posts(spark, sf_dir), stream_views.hashtag_counts())


@query
def st_sentiment_counts(spark, sf_dir):
    return _counted(nlp.score_posts(late_posts(spark, sf_dir)), stream_views.sentiment_counts())


@query
def st_crisis_score(spark, sf_dir):
    frame = late_posts(spark, sf_dir).withColumn("cleaned_text", P.clean_text(F.col("text")))
    return _counted(frame, stream_views.crisis_scores())


@query
def st_dedupe_posts(spark, sf_dir):
    """Each post is polled four times, with other counts, many of them hours late; the last
    two polls are of one time."""
    copies = late_posts(spark, sf_dir).withColumn("copy", F.explode(F.array(*map(F.lit, range(4)))))
    later = F.least("copy", F.lit(2))
    polled = copies.select(
        "topic", "tweet_id", "username", "created_at",
        (F.col("retweet_count") + F.col("copy")).alias("retweet_count"),
        (F.col("created_at") + F.make_dt_interval(hours=later)).alias("requested_at"))
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    stream_sinks.start_distinct(polled, path, checkpoint).awaitTermination()
    stream_sinks.compact_distinct(spark, path, polled.schema)
    return stream_sinks.read_distinct(spark, path, polled.schema)


@query
def st_topic_runs(spark, sf_dir):
    topic = F.when(F.col("event_id") % 2 == 0, "spark").otherwise("tech")
    polls = late_events(spark, sf_dir).select(
        topic.alias("topic"), F.col("ts").cast("timestamp").alias("requested_at")
    )
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    stream_sinks.start_requests(polls, path, checkpoint).awaitTermination()
    stream_sinks.compact_topic_runs(spark, path)
    return _named_runs(stream_sinks.read_topic_runs(spark, path))


@query
def st_sink_append(spark, sf_dir):
    """Several micro-batches, each over the whole time: runs follow what came before."""
    root, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "checkpoint")
    events, path = V.table(spark, sf_dir, "events"), scratch_path(spark, "events")
    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).write.parquet(f"{path}/{part}")
        arriving = spark.readStream.schema(events.schema).parquet(f"{path}/*")
        polled = requested(V.posts_from(spark, sf_dir, arriving))
        stream_sinks.start_ingest(polled, root, checkpoint).awaitTermination()
    compaction.compact(spark, root)
    run_of = stored.read_table(spark, root, "searches")
    tweets = stored.read_table(spark, root, "tweets")
    return (
        tweets.join(run_of, "search_id")
        .groupBy("topic", F.col("timestamp").alias("run_start"), "sentiment")
        .agg(F.count("*").alias("n_posts"), F.sum("retweet_count").alias("retweets"))
    )


# --- data checks --------------------------------------------------------------------------
@query
def dq_required_columns(spark, sf_dir):
    checked = quality.require_rows(
        quality.require_columns(posts(spark, sf_dir), ["text"]), "any topic"
    )
    return checked.groupBy("topic").agg(F.count("text").alias("n_texts"))


# Views whose size ``dq_skip_unusable`` reports, by the query that computes each.
SIZED_VIEWS = {
    "agg_hourly_volume": counts.hourly_volume, "agg_top_users": counts.top_users,
    "agg_influencers": counts.influencers, "agg_location_counts": counts.location_counts,
}


@query
def dq_skip_unusable(spark, sf_dir):
    """The size of every view, of all posts and of a topic nobody wrote about: the view of
    nothing is empty, not an error."""
    everything = posts(spark, sf_dir)
    nothing = filters.filter_topic(everything, "nobody wrote about this")
    parts = [
        view(of).agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("view_name"), F.lit(scope).alias("posts"), "n_rows")
        for name, view in SIZED_VIEWS.items()
        for scope, of in (("all", everything), ("none", nothing))
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query
def dq_sentiment_domain(spark, sf_dir):
    """Labels of all posts, some spoiled."""
    spoiled = scored(spark, sf_dir).withColumn(
        "sentiment",
        F.when(F.col("event_type") == "error", "Mixed").otherwise(F.col("sentiment")),
    )
    return quality.sentiment_domain(spoiled, by=("topic",))
