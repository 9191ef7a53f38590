"""Numbers, times, places and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse.functions.text import strip


def to_count(text: Column) -> Column:
    """Text to a whole number, truncated toward zero; anything unreadable gives 0.

    The shape test refuses what a cast would let through ("1d"); infinities and
    values outside the range of a long give 0 too.
    """
    value = strip(text)
    whole = F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("long"))
    number = F.when(value.rlike(K.NUMBER_PATTERN), value.try_cast("double"))
    return F.coalesce(whole, number.try_cast("long"), F.lit(0).cast("long"))


def to_timestamp(
    text: Column,
    now: Column | None = None,
    formats: Sequence[str] = K.TIMESTAMP_FORMATS,
) -> Column:
    """Text to a timestamp; blank or unreadable gives ``now`` (the current time).

    Reads ISO 8601, an integer (nanoseconds since 1970) and the given formats, with
    or without a leading day name.
    """
    raw = strip(text)
    body = F.regexp_replace(raw, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", "")
    digits = F.when(
        raw.rlike(r"^[0-9]+$"), F.timestamp_micros(F.floor(raw.try_cast("long") / 1000).cast("long"))
    )
    tries = [F.when(~raw.rlike(r"^[0-9]*$"), raw.try_cast("timestamp"))]
    tries += [F.try_to_timestamp(body, F.lit(fmt)) for fmt in formats]
    return F.coalesce(digits, *tries, F.current_timestamp() if now is None else now)


def date_parts(ts: Column) -> list[Column]:
    """Columns ``year``, ``month``, ``day``, ``hour`` of a timestamp."""
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
    ]


def floor_hour(ts: Column) -> Column:
    """The hour a timestamp falls in."""
    return F.date_trunc("hour", ts)


def normalise_location(location: Column) -> Column:
    """Upper-cased, stripped location; blanks and "unknown" spellings give null."""
    place = strip(F.upper(location))
    return F.when(~place.isin(*K.EMPTY_LOCATIONS), place)


def fill_text(value: Column, default: str) -> Column:
    """A missing text becomes ``default``."""
    return F.coalesce(value, F.lit(default))


def crisis_score(crisis_posts: Column, total_posts: Column) -> Column:
    """Share of crisis posts times 1000, at most 100; 0 without posts.

    One crisis post in ten is already the maximum.
    """
    share = F.try_divide(crisis_posts.cast("double"), total_posts.cast("double"))
    share = F.coalesce(share, F.lit(0.0))
    return F.least(F.lit(float(K.CRISIS_CAP)), share * K.CRISIS_SCALE)


def alert_level(
    score: Column, thresholds: Sequence[tuple[float, str]] = K.ALERT_THRESHOLDS
) -> Column:
    """Name of the alert level: the first threshold the score is strictly above."""
    level = F.lit(K.ALERT_DEFAULT)
    for bound, name in sorted(thresholds):
        level = F.when(score > bound, F.lit(name)).otherwise(level)
    return level


def engagement_index(
    retweets: Column, likes: Column, retweet_weight: float = 1.0, like_weight: float = 1.0
) -> Column:
    """Weighted sum of retweets and likes; the weights are a choice of the caller."""
    return retweets * F.lit(float(retweet_weight)) + likes * F.lit(float(like_weight))


def log_axis(value: Column) -> Column:
    """Position on a log10 axis; null for values without one (zero and below)."""
    return F.when(value > 0, F.log10(value.cast("double")))
