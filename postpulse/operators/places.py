"""Places: free-text locations resolved by a gazetteer table.

A location is read as words between spaces, commas, slashes and the like. The longest run
of words at its end that is a known spelling gives the place, so "Old Town, Utopia" and
"Port Utopia" are in Utopia. What stays unresolved is compared with the spellings that are
one typing error away: a letter too many, too few or wrong. Both sides are joined on what is
left of them without one letter, which two spellings one error apart have in common, and then
compared as they are. All of it works on distinct locations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P

BY_NAME, BY_ERROR = "name", "typing error"


def place_words(location: Column) -> Column:
    """The words of an upper-case spelling."""
    return F.filter(F.split(location, K.PLACE_SEPARATORS), lambda word: word != "")


def spellings(gazetteer: DataFrame) -> DataFrame:
    """One row per spelling by its words: ``alias``, ``n_words``, ``place``.

    Of several places for a spelling the first by name counts; spellings without a word
    are left out.
    """
    words = place_words(P.strip(F.upper("alias")))
    return gazetteer.select(words.alias("words"), F.struct("country", "lat", "lon").alias("place")
                            ).filter(F.size("words") > 0).groupBy(
        F.array_join("words", " ").alias("alias"), F.size("words").alias("n_words")).agg(
        F.min("place").alias("place"))


def _endings(locations: DataFrame, longest: int) -> DataFrame:
    """The last words of every location, as many as a spelling may have."""
    words = locations.select("location", place_words(F.col("location")).alias("words"))
    counts = F.sequence(F.lit(1), F.least(F.size("words"), F.lit(longest)))
    return words.filter(F.size("words") > 0).select(
        "location", "words", F.explode(counts).alias("n_words")).select(
        "location", "n_words", F.array_join(
            F.slice("words", F.size("words") - F.col("n_words") + 1, F.col("n_words")), " ").alias("ending"))


def _with_one_less(spelling: Column) -> Column:
    """The spelling, and what is left of it without one of its letters."""
    places = F.sequence(F.lit(1), F.length(spelling))
    return F.array_distinct(F.concat(F.array(spelling), F.transform(places, lambda i: F.concat(
        F.substring(spelling, F.lit(1), i - 1), F.substring(spelling, i + 1, F.length(spelling))))))


def resolve_places(
    locations: DataFrame, gazetteer: DataFrame, shortest: int = K.TYPING_ERROR_LENGTH
) -> DataFrame:
    """Distinct locations with ``country``, ``lat``, ``lon`` and ``resolved_by``; null if unknown.

    ``locations`` are normalised. Spellings of under ``shortest`` letters are not taken for
    others. Among places one error away, the longest ending decides, then the spelling's name.
    """
    found = locations.select("location").dropna().distinct()
    known = spellings(gazetteer)
    # Two numbers of the gazetteer, whatever its size.
    sizes = known.agg(F.max("n_words"), F.max(F.length("alias"))).first()
    endings = _endings(found, sizes[0] or 1)
    named = endings.join(known.select(F.col("alias").alias("ending"), "place"), "ending").groupBy(
        "location").agg(F.max_by("place", "n_words").alias("place"))
    # Longer endings cannot be an error away, and their parts would be many.
    open_ = endings.join(named, "location", "left_anti").filter(
        F.length("ending").between(shortest, (sizes[1] or 0) + 1))
    left = open_.select("*", F.explode(_with_one_less(F.col("ending"))).alias("part"))
    right = known.filter(F.length("alias") >= shortest).select(
        "alias", F.col("place").alias("near_place"),
        F.explode(_with_one_less(F.col("alias"))).alias("part"))
    near = left.join(right, "part").filter(F.levenshtein("ending", "alias", 1) == 1).groupBy(
        "location").agg(F.min(F.struct((-F.col("n_words")).alias("less"), "alias", "near_place")).alias("best"))
    by_name = named.select("location", "place", F.lit(BY_NAME).alias("resolved_by"))
    by_error = near.select("location", F.col("best.near_place").alias("place"),
                           F.lit(BY_ERROR).alias("resolved_by"))
    return found.join(by_name.unionByName(by_error), "location", "left").select(
        "location", "place.country", "place.lat", "place.lon", "resolved_by")
