"""Column functions against hand-written cases and against plain Python."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P

FEW = settings(max_examples=12, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])
PIECES = st.sampled_from([
    "RT ", "RT ", "START ", "@bob", "@a_1:", "#", "#café", "#日本語", "#éx", "http://x.y/z",
    "https://t.co/1", " ", " ", "\x1c", " ", "\n", "a@b.com", "word", "Help", "fire", "'s",
    "not", "good", "İ", "Kelp", "alart", "9", "_",
])
TEXTS = st.lists(st.lists(PIECES, max_size=9).map("".join), min_size=1, max_size=40)


def apply(spark, function, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    out = frame.select("i", function(F.col("v")).alias("out")).collect()
    return [row["out"] for row in sorted(out, key=lambda row: row["i"])]


def python_clean(text):
    for pattern in (r"@[A-Za-z0-9_]+", r"#", r"RT\s+", r"https?://\S+"):
        text = re.sub(pattern, "", text)
    return text.strip()


@FEW
@given(texts=TEXTS)
def test_clean_text_is_the_four_steps(spark, texts):
    assert apply(spark, P.clean_text, texts) == [python_clean(t) for t in texts]


@FEW
@given(texts=TEXTS)
def test_hashtags_are_unicode_words(spark, texts):
    assert apply(spark, P.extract_hashtags, texts) == [re.findall(r"#(\w+)", t) for t in texts]


@FEW
@given(texts=TEXTS)
def test_crisis_is_a_caseless_substring(spark, texts):
    pattern = re.compile("|".join(K.REFERENCE_KEYWORDS), re.IGNORECASE)
    assert apply(spark, P.is_crisis, texts) == [bool(pattern.search(t)) for t in texts]


def test_text_edge_cases(spark):
    assert apply(spark, P.clean_text, [None, "", "a@b.com", "RT @bob: START now"]) == [
        "", "", "a.com", ": STAnow"
    ]
    assert apply(spark, P.extract_hashtags, [None, "#a #a"]) == [[], ["a", "a"]]
    assert apply(spark, P.is_crisis, [None, "policeflood", "police", "helpful", "FIREworks"]) == [
        False, True, False, True, True
    ]
    fixed = lambda text: P.is_crisis(text, K.FIXED_KEYWORDS)
    assert apply(spark, fixed, ["police", "flood"]) == [True, True]
    assert apply(spark, P.words, ["Bob's 42 x9 it's", None]) == [["bob", "x9", "it"], []]


def test_the_retweet_mark_is_a_parameter(spark):
    whole_word = lambda text: P.clean_text(text, r"\bRT\s+")
    assert apply(spark, whole_word, ["START now RT x"]) == ["START now x"]


@pytest.mark.parametrize(("cell", "text", "tags"), [
    ("['#Python','Tech']", "x #py", ["Python", "Tech", "py"]),
    ("#PythonDev #py", None, ["PythonDev", "py"]),
    ("['a'", "", []),
    ("['a', #b", "#b", ["b", "b"]),
    (None, "#q", ["q"]),
    ("", "", []),
])
def test_tag_lists(spark, cell, text, tags):
    frame = spark.createDataFrame([(cell, text)], "c string, t string")
    assert frame.select(P.parse_tag_list(F.col("c"), F.col("t"))).first()[0] == tags


def test_tags_with_topic(spark):
    frame = spark.createDataFrame([(["Python", "pythonDev", "go"], "PYTHON")], "t array<string>, k string")
    assert frame.select(P.tags_with_topic(F.col("t"), F.col("k"))).first()[0] == ["Python", "pythonDev"]


def test_counts(spark):
    cases = {
        "x": 0, "1e3": 1000, "-3.9": -3, "1,000": 0, "1d": 0, "": 0, " 12 ": 12, "inf": 0,
        "1e30": 0, ".5": 0, "0x10": 0, "1_000": 0, "9007199254740993": 9007199254740993,
        "99999999999999999999": 0, " 7": 7,
    }
    assert apply(spark, P.to_count, list(cases)) == list(cases.values())
    assert apply(spark, P.to_count, [None]) == [0]


def test_timestamps(spark):
    now = datetime(2000, 1, 1)
    ten = datetime(2023, 1, 15, 10)
    cases = {
        "2023-01-15 10:00:00": ten, "2023-01-15T10:00:00Z": ten, "2023-01-15T12:00:00+02:00": ten,
        "01/15/2023 10:00": ten, "15/01/2023 10:00": ten, "Jan 15 2023 10:00": ten,
        "Sun Jan 15 10:00:00 +0000 2023": ten, "1673776800000000000": ten, "15 Jan 2023 10:00": ten,
        "junk": now, "": now, "13/13/2023": now,
    }
    convert = lambda text: P.to_timestamp(text, F.lit("2000-01-01").cast("timestamp"))
    assert apply(spark, convert, list(cases)) == list(cases.values())
    assert apply(spark, convert, [None]) == [now]


def test_locations(spark):
    assert apply(spark, P.normalise_location, ["  usa ", "unknown", "None", " null", "", None, " X"]) == [
        "USA", None, None, None, None, None, "X"
    ]


def test_levels_are_strict(spark):
    frame = spark.createDataFrame([(75.0,), (75.1,), (55.0,), (55.1,), (25.0,), (25.1,)], "s double")
    levels = [row[0] for row in frame.select(P.alert_level(F.col("s"))).collect()]
    assert levels == ["HIGH", "EXTREME", "MODERATED", "HIGH", "Normal", "MODERATED"]


def test_crisis_score_is_capped_and_zero_without_posts(spark):
    frame = spark.createDataFrame([(1, 10), (1, 100), (0, 5), (0, 0)], "c long, n long")
    scores = [row[0] for row in frame.select(P.crisis_score(F.col("c"), F.col("n"))).collect()]
    assert scores == [100.0, 10.0, 0.0, 0.0]


def test_engagement_and_log_axis(spark):
    frame = spark.createDataFrame([(0, 7), (100, 1)], "r long, l long")
    out = frame.select(
        P.engagement_index(F.col("r"), F.col("l"), 2, 1), P.log_axis(F.col("r"))
    ).collect()
    assert [tuple(row) for row in out] == [(7.0, None), (201.0, 2.0)]


def test_post_id_is_stable(spark):
    first, second, other = apply(spark, P.post_id, ["same", "same", "other"])
    assert first == second != other
    assert apply(spark, P.post_id, ["same"]) == [first]


def python_polarity(text, lexicon):
    found = re.findall(r"[^\W][\w']*", text.lower())
    values = [
        lexicon[w] * (-0.5 if i and found[i - 1] in K.NEGATORS else 1.0)
        for i, w in enumerate(found) if w in lexicon
    ]
    return round(sum(values) / len(values), 6) if values else 0.0


@FEW
@given(texts=st.lists(st.lists(st.sampled_from(
    ["not", "never", "no", "good", "bad", "great", "the", "awful,", "Good", "'", "knot"]), max_size=12)
    .map(" ".join), min_size=1, max_size=30))
def test_polarity_is_the_mean_with_negation(spark, texts):
    scores = apply(spark, P.polarity, texts)
    assert scores == pytest.approx([python_polarity(t, K.LEXICON) for t in texts])


def test_sentiment_label_bounds(spark):
    frame = spark.createDataFrame([(0.1,), (0.11,), (-0.1,), (-0.11,), (None,)], "p double")
    labels = [row[0] for row in frame.select(P.sentiment_label(F.col("p"))).collect()]
    assert labels == ["Neutral", "Positive", "Neutral", "Negative", "Neutral"]
