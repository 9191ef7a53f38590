"""Lexicon sentiment of one post, as a stateless expression.

The score of a post needs only its own words, so it is computed inside the row with array
functions: no explode, no shuffle, and it works unchanged on a stream. What is found of a
lexicon is folded from left to right. It is found by a scan of many texts at once; a text
with letters that the scan does not know is searched in the row: a gate finds the places
where an entry may begin, and entries are looked up there in a hash table that is part of
the expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse.functions import scan as S
from postpulse.functions.gate import checksum, gate_of, listed

# The lexicon becomes part of the plan, so its size is bounded.
MAX_LEXICON_WORDS = 10_000

# What is known of a word or words: polarity, or none for what only changes the next
# entry; and by how much it changes it.
Entry = float | tuple[float | None, float]
HIT = "struct<at:int,width:int,polarity:double,intensity:double,negates:boolean>"
_APART = "\x1f"


def entries_of(lexicon: Mapping[str, Entry]) -> dict[str, tuple[float | None, float]]:
    """Entries as polarity and intensity."""
    return {phrase: (value if isinstance(value, tuple) else (float(value), 1.0))
            for phrase, value in lexicon.items()}


def sentiment_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.WORD_PATTERN), F.lit(0))


def lookup(entries: Mapping[str, tuple[float | None, float]]) -> Callable[[Column], Column]:
    """A function from a phrase to its entry, a struct of polarity and intensity, or null.

    Entries lie in buckets by their checksum, so a phrase is compared with those of its
    bucket only.
    """
    size = 1
    while size < 2 * len(entries):
        size *= 2
    ordered = sorted(entries, key=lambda phrase: (zlib.crc32(phrase.encode()) % size, phrase))
    counts = [0] * (size + 1)
    for phrase in ordered:
        counts[zlib.crc32(phrase.encode()) % size + 1] += 1
    for slot in range(size):
        counts[slot + 1] += counts[slot]
    starts, phrases = listed(counts, "int"), listed(ordered, "string", _APART)
    polarities = listed(["NaN" if entries[p][0] is None else entries[p][0] for p in ordered], "double")
    intensities = listed([entries[p][1] for p in ordered], "double")

    def entry(phrase: Column) -> Column:
        slot = (checksum(phrase) % size).cast("int")

        def in_bucket(slot: Column) -> Column:
            first, end = F.get(starts, slot), F.get(starts, slot + 1)
            places = F.when(end > first, F.sequence(first, end - 1))
            return F.get(F.filter(places, lambda i: F.get(phrases, i) == phrase), 0)

        place = F.transform(F.array(slot), in_bucket)
        return F.get(F.transform(place, lambda i: F.when(i.isNotNull(), F.struct(
            F.nanvl(F.get(polarities, i), F.lit(None).cast("double")).alias("polarity"),
            F.get(intensities, i).alias("intensity")))), 0)

    return entry


def hits(
    words: Column, entries: Mapping[str, tuple[float | None, float]], negators: Sequence[str]
) -> Column:
    """Where entries and negators stand among the words, of several the longest."""
    lengths = sorted({len(phrase.split(" ")) for phrase in entries}, reverse=True)
    heads = gate_of({phrase.split(" ")[0] for phrase in entries} | set(negators))
    entry = lookup(entries)
    starts = heads.places(words)

    def at(i: Column) -> Column:
        def found(n: int) -> Column:
            known = entry(F.get(words, i) if n == 1 else F.array_join(F.slice(words, i + 1, n), " "))
            return F.transform(F.array(known), lambda e: F.when(
                (i + n <= F.size(words)) & e.isNotNull(), F.struct(
                    i.alias("at"), F.lit(n).alias("width"), e["polarity"].alias("polarity"),
                    e["intensity"].alias("intensity"), F.lit(False).alias("negates"))))

        negator = F.when(F.get(words, i).isin(list(negators)), F.struct(
            i.alias("at"), F.lit(1).alias("width"), F.lit(None).cast("double").alias("polarity"),
            F.lit(1.0).alias("intensity"), F.lit(True).alias("negates")))
        longer = [found(n) for n in lengths if n > 1]
        single = [found(n) for n in lengths if n == 1]
        every = F.concat(*longer, F.array(negator), *single)
        return F.get(F.filter(every, lambda hit: hit.isNotNull()), 0)

    return F.filter(F.transform(starts, at), lambda hit: hit.isNotNull())


def scanned_hits(
    entries: Mapping[str, tuple[float | None, float]], negators: Sequence[str]
) -> Callable[[Column], Column]:
    """A function from a text to its ``hits``, or null if the text has letters that the scan
    does not know."""
    longer = sorted({len(phrase.split(" ")) for phrase in entries} - {1}, reverse=True)
    heads = {phrase.split(" ")[0] for phrase in entries} | set(negators)
    keys, stops = S.keys_of(heads), set(negators)
    # A polarity that is no number is none.
    known = {phrase: (None if polarity is None or polarity != polarity else polarity, intensity)
             for phrase, (polarity, intensity) in entries.items()}
    kind = pa.struct([("at", pa.int32()), ("width", pa.int32()), ("polarity", pa.float64()),
                      ("intensity", pa.float64()), ("negates", pa.bool_())])

    def hits_of(texts: pa.Array) -> pa.Array:
        found = S.scan(texts, True)
        places = S.candidates(found, keys)
        owners = np.searchsorted(found.first, places, "right") - 1
        real = found.known[owners]
        places, owners = places[real], owners[real]
        starts, ends, first = found.starts, found.ends, found.first

        def word(i: int) -> str:
            return found.text[starts[i]:ends[i]].lower()

        rows, counts = [], np.zeros(len(texts), np.int64)
        for i, t in zip(places.tolist(), owners.tolist()):
            head = word(i)
            if head not in heads:
                continue
            at = i - first[t]
            for n in longer:
                if i + n <= first[t + 1] and (
                        phrase := " ".join(map(word, range(i, i + n)))) in known:
                    rows.append((at, n, *known[phrase], False))
                    break
            else:
                if head in stops:
                    rows.append((at, 1, None, 1.0, True))
                elif head in known:
                    rows.append((at, 1, *known[head], False))
                else:
                    continue
            counts[t] += 1
        columns = zip(*rows) if rows else [()] * len(kind)
        values = pa.StructArray.from_arrays(
            [pa.array(column, field.type) for column, field in zip(columns, kind)], fields=list(kind))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), values, mask=pa.array(~found.known))

    def hits_of_all(texts: pa.Array) -> pa.Array:
        parts = [hits_of(part) for _, part in S.chunks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return F.arrow_udf(hits_of_all, f"array<{HIT}>")


def folded(found: Column, factor: float = K.NEGATION_FACTOR, reach: int = K.NEGATION_REACH) -> Column:
    """Mean polarity of what was found, folded from left to right; nothing gives 0.

    A negator turns the polarity of an entry that follows within ``reach`` words, by the
    factor. An entry without polarity changes the entry right behind it by its intensity; it
    does not count for the reach, and several of them multiply. What lies inside a longer
    entry is passed over. Values are kept within -1 and 1.
    """
    none = F.lit(-1)
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).alias("n"), none.alias("negated"),
        F.lit(1.0).alias("boost"), none.alias("boosted"), F.lit(0).alias("free"))

    def step(state: Column, hit: Column) -> Column:
        at, end = hit["at"], hit["at"] + hit["width"]
        follows, turned = state["boosted"] == at, at <= state["negated"]
        boost = F.when(follows, state["boost"]).otherwise(1.0)
        value = hit["polarity"] * boost * F.when(turned, F.lit(float(factor))).otherwise(1.0)

        def state_of(total: Column, n: Column, negated: Column, boost: Column, boosted: Column) -> Column:
            return F.struct(total.alias("total"), n.alias("n"), negated.alias("negated"),
                            boost.alias("boost"), boosted.alias("boosted"), end.alias("free"))

        kept = (state["total"], state["n"])
        return (
            F.when(at < state["free"], state)
            .when(hit["negates"], state_of(*kept, at + reach, F.lit(1.0), none))
            .when(hit["polarity"].isNull(), state_of(
                *kept, F.when(turned, state["negated"] + hit["width"]).otherwise(state["negated"]),
                boost * hit["intensity"], end))
            .otherwise(state_of(
                state["total"] + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)),
                state["n"] + 1, none, F.lit(1.0), none)))

    last = F.aggregate(found, start, step)
    mean = F.get(F.transform(F.array(last), lambda s: F.try_divide(s["total"], s["n"])), 0)
    return F.round(F.coalesce(mean, F.lit(0.0)), 6)


def polarity(
    text: Column,
    lexicon: Mapping[str, Entry] = K.LEXICON,
    negators: Sequence[str] = K.NEGATORS,
    factor: float = K.NEGATION_FACTOR,
    reach: int = K.NEGATION_REACH,
) -> Column:
    """Mean polarity of the lexicon entries of a text, rounded to 6 digits; none gives 0.

    An entry is a word, or several words with a space between; its value is a polarity, or a
    pair of polarity (or None) and intensity. See ``folded`` for how entries act together.
    """
    if not lexicon:
        return F.lit(0.0)
    if len(lexicon) > MAX_LEXICON_WORDS:
        raise ValueError(
            f"lexicon has {len(lexicon)} words, more than {MAX_LEXICON_WORDS}; "
            "use operators.nlp.with_polarity, which joins large lexicons"
        )
    entries = entries_of(lexicon)
    # The word list is bound once, as the only element of an array.
    in_row = F.get(F.transform(
        F.array(sentiment_words(text)), lambda words: hits(words, entries, negators)), 0)
    return folded(F.coalesce(scanned_hits(entries, negators)(text), in_row), factor, reach)


def sentiment_label(score: Column, cutoff: float = K.SENTIMENT_CUTOFF) -> Column:
    """Positive above the cutoff, Negative below its negative, else Neutral (also null)."""
    return (
        F.when(score > cutoff, K.POSITIVE)
        .when(score < -cutoff, K.NEGATIVE)
        .otherwise(K.NEUTRAL)
    )
