"""Whole jobs: import a CSV, ingest landed responses, show topics."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from postpulse import constants as K
from postpulse.operators import counts, filters, joins, nlp, quality
from postpulse.sinks import store
from postpulse.sources import api, csv_posts


def import_csv(
    spark: SparkSession,
    path: str,
    topic: str,
    root: str,
    batch_id: str,
    lexicon: DataFrame | Mapping[str, float] = K.LEXICON,
    now: datetime | None = None,
    literal: bool = False,
    multiline: bool = True,
) -> None:
    """Import the rows of a CSV on a topic; repeat a failed import with its ``batch_id``.

    Files of one import may have different headers; without line breaks inside cells,
    ``multiline=False`` splits large files. A run of the topic is continued whatever its age. A file without a text column,
    or without a row on the topic, is rejected. Rows that do not fit the header of their file
    are kept below ``rejected``. A repeated import replaces the first one and keeps its time, if
    that opened a run.
    """
    store.init_tables(spark, root)
    now = now or store.first_time_of(spark, root, batch_id)
    posts = csv_posts.read_posts(spark, path, topic, now, literal, multiline)
    quality.require_rows(posts, f"topic {topic!r}")
    store.write_rejected(csv_posts.rejected_rows(spark, path, multiline), root, batch_id)
    store.write_rejected(csv_posts.rejected_rows(spark, path, multiline), root, batch_id)
    store.ingest(root, nlp.score_posts(posts, lexicon), batch_id)


def ingest_responses(
    spark: SparkSession,
    path: str,
    root: str,
    batch_id: str,
    lexicon: DataFrame | Mapping[str, float] = K.LEXICON,
) -> None:
    """Append the posts of landed API responses to the store."""
    store.init_tables(spark, root)
    store.ingest(root, nlp.score_posts(api.read_batch(spark, path), lexicon), batch_id)


def topic_views(
    posts: DataFrame, gazetteer: DataFrame, entity_dict: DataFrame
) -> dict[str, DataFrame]:
    """Every view of scored posts, for all topics.

    ``posts`` is best the stored table: it holds cleaned text and sentiment, so no
    view scores a post again. Key figures and crisis score come from one pass.
    """
    metrics = counts.sentiment_counts(posts, by=("topic",))
    return {
        "metrics": counts.topic_metrics(posts),
        "crisis_sample": filters.crisis_sample(posts),
        "sentiment_share": counts.sentiment_share(metrics),
        "hourly_volume": counts.hourly_volume(posts),
        "top_hashtags": counts.top_hashtags(counts.hashtag_counts(posts)),
        "engagement": filters.engagement(posts),
        "top_users": counts.top_users(posts),
        "influencers": counts.influencers(posts),
        "entities": nlp.entity_counts(nlp.find_entities(posts, entity_dict)),
        "words": nlp.word_frequencies(posts),
        "bigrams": nlp.word_bigrams(posts),
        **{f"geo_{name}": view for name, view in joins.geo_view(posts, gazetteer).items()},
    }
