"""Column expressions: every function is Column -> Column and stays in the JVM."""

from postpulse.functions.scalar import (
    alert_level,
    crisis_score,
    date_parts,
    engagement_index,
    fill_text,
    floor_hour,
    log_axis,
    normalise_location,
    to_count,
    to_timestamp,
)
from postpulse.functions.sentiment import polarity, sentiment_label
from postpulse.functions.text import (
    clean_text,
    extract_hashtags,
    is_crisis,
    parse_tag_list,
    post_id,
    strip,
    tags_with_topic,
    words,
)

__all__ = [
    "alert_level", "clean_text", "crisis_score", "date_parts", "engagement_index",
    "extract_hashtags", "fill_text", "floor_hour", "is_crisis", "log_axis",
    "normalise_location", "parse_tag_list", "polarity", "post_id",
    "sentiment_label", "strip", "tags_with_topic", "to_count", "to_timestamp",
    "words",
]
