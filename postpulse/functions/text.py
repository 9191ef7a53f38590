"""Text functions on posts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse import constants as K

# Letters equal to an ASCII letter when case is ignored, beyond lower-casing.
FOLDED_LETTERS = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def strip(text: Column) -> Column:
    """Remove every kind of Unicode space from both ends, in linear time.

    Only a text with a space at an end is trimmed; it is bound once, as the only element of
    an array.
    """
    spaces = F.lit(K.SPACE_CHARS)

    def step(t: Column) -> Column:
        spaced = F.contains(spaces, F.substring(t, 1, 1)) | F.contains(spaces, F.substring(t, -1, 1))
        return F.when(spaced, F.btrim(t, spaces)).otherwise(t)

    return F.get(F.transform(F.array(text), step), F.lit(0))


def clean_text(text: Column, retweet_pattern: str = K.RETWEET_PATTERN) -> Column:
    """Post text without mentions, ``#`` signs, retweet marks and links; null gives ''.

    The order of the steps matters: mentions go first, so an e-mail address loses
    its middle, and the retweet mark has no word boundary ("START now" loses its
    "RT ") unless ``retweet_pattern`` says otherwise.
    """
    no_mentions = _remove(text, "@", K.MENTION_PATTERN)
    no_hash = F.replace(no_mentions, F.lit("#"), F.lit(""))
    retweet_mark = "RT" if retweet_pattern == K.RETWEET_PATTERN else ""
    no_retweet = _remove(no_hash, retweet_mark, retweet_pattern)
    no_links = _remove(no_retweet, "http", K.URL_PATTERN)
    return F.coalesce(strip(no_links), F.lit(""))


def _remove(text: Column, mark: str, pattern: str) -> Column:
    """Text without the pattern; the regex runs only on texts holding its fixed mark.

    The text is bound once, as the only element of an array.
    """
    def step(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, "")).otherwise(t)

    return F.get(F.transform(F.array(text), step), F.lit(0))


def extract_hashtags(text: Column) -> Column:
    """All hashtags of a text without the ``#``, in order, repeats kept; null gives []."""
    found = F.regexp_extract_all(text, F.lit(K.HASHTAG_PATTERN), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_tag_list(cell: Column, text: Column) -> Column:
    """Tags of a CSV cell followed by the tags of the text.

    A cell starting with ``[`` is read as a list of strings; a broken list, or any
    other cell, gives the hashtags found in it. A leading ``#`` of a listed tag is
    dropped, so that it counts together with the same tag of the text.
    """
    listed = F.from_json(cell, "array<string>")
    listed = F.transform(
        F.filter(listed, lambda tag: tag.isNotNull()),
        lambda tag: F.regexp_replace(tag, "^#", ""),
    )
    from_cell = F.coalesce(
        F.when(F.startswith(cell, F.lit("[")), listed), extract_hashtags(cell)
    )
    return F.concat(from_cell, extract_hashtags(text))


def tags_with_topic(tags: Column, topic: Column) -> Column:
    """Tags that contain the topic as a literal substring, ignoring case."""
    return F.filter(tags, lambda tag: F.contains(F.lower(tag), F.lower(topic)))


def is_crisis(cleaned: Column, keywords: Sequence[str] = K.REFERENCE_KEYWORDS) -> Column:
    """Whether the text contains any keyword, as a substring, ignoring case.

    Null gives false. The lower-cased text is bound once, as the only element of an
    array, and scanned with ``contains``: that costs a fraction of a
    case-insensitive regex, in a filter as well as in an aggregate. The four
    replaced letters are those that match an ASCII letter when case is ignored but
    do not lower-case to it.
    """
    letters = "".join(letter for letter, _ in FOLDED_LETTERS)
    ascii_letters = "".join(letter for _, letter in FOLDED_LETTERS)
    # Only a text with one of these letters is rewritten.
    rare = reduce(lambda a, b: a | b, (F.contains(cleaned, F.lit(c)) for c in letters))
    folded = F.when(rare, F.translate(cleaned, letters, ascii_letters)).otherwise(cleaned)

    def any_keyword(text: Column) -> Column:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(text, F.lit(keyword.lower()))
        return hit

    return F.coalesce(F.exists(F.array(F.lower(folded)), any_keyword), F.lit(False))


def post_id(text: Column) -> Column:
    """Stable id of a post that came without one: 128 bits of the digest of its text."""
    return F.left(F.sha2(text, 256), F.lit(32))


def words(text: Column) -> Column:
    """Lower-case words for counting: no trailing ``'s``, no bare numbers; null gives []."""
    # Numbers match without the group and come as empty texts.
    found = F.regexp_extract_all(F.lower(text), F.lit(K.COUNTED_WORD_PATTERN), F.lit(1))
    return F.coalesce(F.array_remove(found, ""), F.array().cast("array<string>"))


def names(text: Column) -> Column:
    """Words with their case kept, for entity matching; null gives []."""
    found = F.regexp_extract_all(text, F.lit(K.NAME_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))
