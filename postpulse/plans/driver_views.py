"""Post tables derived from the driver's tables, in Spark.

``posts`` has one row per event, carrying the whole text of a document. The same
definitions in SQL are in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """A table over all cores if it comes in fewer splits than there are cores.

    Scoring a text costs far more than reading it, and one small file is one split.
    Larger tables have enough splits and stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if frame.rdd.getNumPartitions() < cores else frame


def text_parts(spark: SparkSession) -> int:
    """Parts in which posts get their texts.

    The number is stated, as rows without texts are small: by their size Spark would put
    them together in too few parts for what is done with the texts.
    """
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def marked_text() -> F.Column:
    """Document text with the marks of a post: retweet, sentiment, tags, crisis, link."""
    i = F.col("event_id")
    user = F.col("user_id").cast("string")
    return F.concat(
        F.when(i % 7 == 0, F.concat(F.lit("RT @user_"), user, F.lit(": "))).otherwise(""),
        F.col("text"),
        F.when(i % 4 == 0, " great").when(i % 4 == 1, " terrible")
        .when(i % 4 == 2, " not good bad").otherwise(""),
        F.lit(" #"), F.col("event_type"),
        F.when(i % 3 == 0, " #SparkDev").when(i % 3 == 1, " #spark").otherwise(" #Tech"),
        F.when(i % 29 == 0, " Emergency").when(i % 31 == 0, " helpful")
        .when(i % 37 == 0, " police").otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit(" https://t.co/"), i.cast("string"))).otherwise(""),
    )


def location() -> F.Column:
    """Customer's nation in two spellings, a place nobody can resolve, or none."""
    i = F.col("event_id")
    return (
        F.when(i % 13 == 0, "")
        .when(i % 17 == 0, " unknown ")
        .when(i % 19 == 0, F.lit(None).cast("string"))
        .when(F.col("c_mktsegment") == "BUILDING", " Atlantis")
        .when(F.col("c_mktsegment") == "FURNITURE",
              F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")))
        .otherwise(F.concat(F.lit(" "), F.lower("n_name")))
    )


def posts_from(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The ``posts`` view over a batch or a stream of events.

    The text is joined last, to rows that are spread by document, so that texts leave the
    table of documents only: a post with its text is not shuffled.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        events.withColumn("doc_id", F.col("event_id") % n_docs)
        .join(customer, F.col("c_custkey") == F.col("user_id"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .repartition(text_parts(spark), "doc_id")
        .join(documents, "doc_id")
        .select(
            "event_id",
            F.col("event_id").cast("string").alias("tweet_id"),
            marked_text().alias("text"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.floor("value").cast("long").alias("retweet_count"),
            F.floor(F.col("value") * 3).cast("long").alias("like_count"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
            F.floor(F.abs("c_acctbal")).cast("long").alias("user_followers"),
            location().alias("location"),
            F.lit("twitter").alias("platform"),
            F.when(F.col("event_id") % 2 == 0, "spark").otherwise("tech").alias("topic"),
            F.col("event_type"),
        )
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``posts`` view of a batch."""
    return posts_from(spark, sf_dir, spread(table(spark, sf_dir, "events"), "event_id"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of every nation, with coordinates."""
    key = F.col("n_nationkey")
    spellings = F.array(
        F.upper("n_name"), F.concat(F.lit("NATION "), key.cast("string"))
    )
    return table(spark, sf_dir, "nation").select(
        F.explode(spellings).alias("alias"),
        F.col("n_name").alias("country"),
        ((key * 7) % 160 - 80).cast("double").alias("lat"),
        ((key * 13) % 340 - 170).cast("double").alias("lon"),
    )
