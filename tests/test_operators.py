"""Rankings, runs, text analytics and checks against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from functools import partial
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postpulse.operators import counts, filters, joins, nlp, quality, ranking, runs, sets
from postpulse.session import shared_folder


@pytest.mark.parametrize("k", [1, 3, 1500])
def test_top_k_is_sort_and_slice(spark, k):
    chance = random.Random(k)
    data = [("hot" if i % 3 else f"g{i % 7}", chance.randrange(50), f"n{i}") for i in range(3000)]
    frame = spark.createDataFrame(data, "g string, c long, n string")
    best = ranking.top_k(frame, ["g"], [F.desc("c"), F.asc("n")], k).collect()
    expected = []
    for group in {row[0] for row in data}:
        expected += sorted((r for r in data if r[0] == group), key=lambda r: (-r[1], r[2]))[:k]
    assert sorted(tuple(row) for row in best) == sorted(expected)


def test_top_k_limits_groups_before_the_shuffle(spark):
    frame = spark.createDataFrame([("g", 1)], "g string, c long")
    plan = ranking.top_k(frame, ["g"], [F.desc("c")], 10)
    assert "Partial" in plan._jdf.queryExecution().executedPlan().toString()


# --- runs ---------------------------------------------------------------------
def plain_runs(requests):
    """(topic, second) -> run start, one request after the other."""
    open_run, result = {}, {}
    for second, topic, source in sorted(requests, key=lambda r: (r[0], r[2] == "csv")):
        key = topic.lower()
        start = open_run.get(key)
        if start is None or (source == "api" and second - start >= 3600):
            start = open_run[key] = second
        result[key, second] = start
    return result


def run_rows(spark, requests):
    base = datetime(2024, 1, 1)
    data = [(t, base + timedelta(seconds=s, milliseconds=s % 7), src) for s, t, src in requests]
    frame = spark.createDataFrame(data, "topic string, requested_at timestamp, source string")
    zero = int((base - datetime(1970, 1, 1)).total_seconds())
    return frame, {
        (r["topic_key"], r["second"] - zero): r["run_second"] - zero
        for r in runs.topic_runs(frame).collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_plain_loop(spark, seed):
    chance = random.Random(seed)
    span = [3 * 3600, 40 * 24 * 3600, 90 * 24 * 3600, 20 * 24 * 3600][seed]
    requests = [
        (chance.randrange(span), chance.choice(["a", "A", "b"]),
         "csv" if chance.random() < 0.3 else "api")
        for _ in range(1500)
    ]
    # A topic asked for all the time, across the borders of weeks, and one only imported.
    requests += [(s, "busy", "api") for s in range(6 * 24 * 3600, 9 * 24 * 3600, 97)]
    requests += [(s, "Archive", "csv") for s in (5, 50 * 24 * 3600, 99 * 24 * 3600)]
    _, got = run_rows(spark, requests)
    assert got == plain_runs(requests)


def test_an_hour_later_is_a_new_run(spark):
    _, got = run_rows(spark, [(0, "t", "api"), (3599, "t", "api"), (3600, "t", "api")])
    assert got == {("t", 0): 0, ("t", 3599): 0, ("t", 3600): 3600}


def test_searches_have_the_first_spelling(spark):
    frame, _ = run_rows(spark, [(0, "Spark", "csv"), (10, "spark", "api"), (4000, "SPARK", "api")])
    found = runs.searches_of(frame, runs.topic_runs(frame)).orderBy("timestamp").collect()
    assert [(r["topic"], r["source"]) for r in found] == [("Spark", "csv"), ("SPARK", "api")]
    assert len({r["search_id"] for r in found}) == 2
    latest = joins.latest_runs(runs.searches_of(frame, runs.topic_runs(frame))).collect()
    assert [r["topic"] for r in latest] == ["SPARK"]


# --- text analytics -------------------------------------------------------------
TEXTS = [
    "New York City is great", "not good in New York", "York never bad bad", "City City New",
    "", "nothing here", "good good not terrible New York New York City",
]
LEXICON = {"great": 0.8, "good": 0.7, "bad": -0.7, "terrible": -1.0}
ENTITIES = [("New York City", "GPE"), ("New York", "GPE"), ("York", "PER"), ("City", "ORG"),
            ("City", "GPE"), ("City is", "X")]


def text_frame(spark):
    # The first text has many copies, as a hot key would.
    data = [(f"t{i}", t) for i, t in enumerate(TEXTS)] + [(f"c{i}", TEXTS[0]) for i in range(30)]
    return spark.createDataFrame(data, "tweet_id string, cleaned_text string").withColumn(
        "topic", F.lit("x")
    )


def test_lexicon_table_equals_the_expression(spark, rows):
    frame = text_frame(spark)
    flawed = [*LEXICON.items(), (None, 1.0), ("fine", None), (next(iter(LEXICON)), -9.0)]
    lexicon = spark.createDataFrame(flawed, "word string, polarity double")
    columns = ["tweet_id", "polarity"]
    joined = nlp.with_polarity(frame, lexicon).select(columns)
    assert rows(joined) == rows(nlp.with_polarity(frame, LEXICON).select(columns))
    scores = dict(rows(joined))
    assert scores["t0"] == 0.8 and scores["t1"] == -0.35 and scores["t2"] == pytest.approx(-0.175)
    assert scores["t4"] == scores["t5"] == 0.0
    empty = spark.createDataFrame([], "word string, polarity double")
    assert set(dict(rows(nlp.with_polarity(frame, empty).select(columns))).values()) == {0.0}


def plain_entities(text):
    words = text.split()
    spans = [
        (i, n, " ".join(words[i:i + n]))
        for n in (1, 2, 3) for i in range(len(words) - n + 1)
    ]
    spans = [s for s in spans if s[2] in {e for e, _ in ENTITIES}]
    kept = [
        s for s in spans
        if not any(o[1] > s[1] and o[0] <= s[0] and o[0] + o[1] >= s[0] + s[1] for o in spans)
    ]
    return [(i, e, label) for i, _, e in kept for name, label in ENTITIES if name == e]


def test_entities_are_the_longest_matches(spark, rows):
    frame = text_frame(spark)
    dictionary = spark.createDataFrame(ENTITIES, "entity string, label string")
    found = nlp.find_entities(frame, dictionary)
    expected = [
        ("x", row["tweet_id"], *match)
        for row in frame.collect() for match in plain_entities(row["cleaned_text"])
    ]
    assert rows(found) == sorted(expected, key=repr)


def test_entities_of_any_length_and_spelling(spark, rows):
    entities = [
        ("United States of America", "GPE"), ("United States", "GPE"), ("Coca-Cola", "ORG"),
        ("O'Reilly", "ORG"), ("United States", "GPE"), (None, "ORG"), ("of", None), ("--", "X"),
        ("the President of the United States of America", "ROLE"),
    ]
    dictionary = spark.createDataFrame(entities, "entity string, label string")
    texts = [
        "in the United States of America", "the President of the United States of America spoke",
        "Coca Cola and Coca-Cola at O'Reilly", "the United States", "", None,
    ]
    frame = spark.createDataFrame(
        [("x", str(i), t) for i, t in enumerate(texts)],
        "topic string, tweet_id string, cleaned_text string")
    assert rows(nlp.find_entities(frame, dictionary).drop("topic")) == [
        ("0", 2, "United States of America", "GPE"),
        ("1", 0, "the President of the United States of America", "ROLE"),
        ("2", 0, "Coca-Cola", "ORG"), ("2", 3, "Coca-Cola", "ORG"), ("2", 6, "O'Reilly", "ORG"),
        ("3", 1, "United States", "GPE"),
    ]
    assert nlp.find_entities(frame, dictionary.limit(0)).count() == 0


def test_bigrams_stay_inside_a_post(spark, rows):
    frame = spark.createDataFrame(
        [("x", "red fox the red fox"), ("x", "fox red"), ("x", None)],
        "topic string, cleaned_text string",
    )
    expected = [("x", "fox red", 1, 0.5), ("x", "red fox", 2, 1.0)]
    every = lambda words: nlp.word_bigrams(frame, words, threshold=None).drop("score")
    assert rows(every(["the"])) == expected
    table = spark.createDataFrame([("the",), (None,), ("the",)], "word string")
    assert rows(every(table)) == expected
    assert rows(nlp.word_frequencies(frame, table)) == rows(nlp.word_frequencies(frame, ["the"]))
    assert nlp.word_frequencies(frame, table.limit(0)).count() == 3


def test_lda_numbers_every_word(spark):
    """More words than the 262,144 that the model once kept."""
    n, letters = 300_000, "abcdefghij"
    texts = spark.range(n).select(F.translate(
        F.format_string("w%06d", "id"), "0123456789", letters).alias("cleaned_text"))
    numbered = nlp.word_numbers(nlp.lda_tokens(texts))
    assert numbered.agg(
        F.countDistinct("word"), F.countDistinct("term"), F.min("term"), F.max("term")
    ).first() == (n, n, 0, n - 1)


def test_lda_shape_and_seed(spark, rows):
    texts = [("cats dogs pets cats animal",), ("stocks bonds money market",), ("goal match team",)]
    frame = spark.createDataFrame(texts * 20, "cleaned_text string")
    first, second = nlp.lda_topics(frame, words=4), nlp.lda_topics(frame, words=4)
    assert rows(first) == rows(second)
    assert len(first.collect()) == 3 * 4
    assert all(0 < row["weight"] <= 1 for row in first.collect())


# --- small views ------------------------------------------------------------------
def test_geo_markers_are_not_backfilled(spark, rows):
    counted = spark.createDataFrame(
        [("x", f"P{i}", 10 - i) for i in range(7)], "topic string, location string, count long"
    )
    places = spark.createDataFrame(
        [(f" p{i}", "C", 1.0, 2.0) for i in (0, 2, 6)], "alias string, country string, lat double, lon double"
    )
    assert [r[0] for r in rows(joins.geo_markers(counted, places))] == ["P0", "P2"]
    assert joins.geocode(counted, places, keep_unresolved=True).count() == 7


def test_missing_author_keeps_the_post(spark, rows):
    posts = spark.createDataFrame([("1", "a"), ("2", "z")], "tweet_id string, author_id string")
    users = spark.createDataFrame([("a", "ann", 5), ("a", "ann", 7)],
                                  "author_id string, username string, user_followers long")
    out = joins.join_authors(posts, users).select("tweet_id", "username", "user_followers")
    assert rows(out) == [("1", "ann", 7), ("2", "unknown", 0)]


def test_topic_filter_is_a_pattern_unless_literal(spark):
    frame = spark.createDataFrame([("['C++']",), ("#c",), (None,)], "hashtags string")
    assert filters.filter_topic_rows(frame, "c++", literal=True).count() == 1
    assert filters.filter_topic_rows(frame, "C[+]{2}").count() == 1
    with pytest.raises(ValueError, match="literal=True"):
        filters.filter_topic_rows(frame, "c(")


def test_mean_is_rounded_half_to_even(spark, rows):
    frame = spark.createDataFrame([("x", "Positive", v) for v in (0, 0, 0, 1)],
                                  "topic string, sentiment string, retweet_count long")
    assert rows(counts.kpi_row(frame)) == [("x", 4, 4, 0.2)]


def test_repeated_metrics_are_summed(spark, rows):
    metrics = spark.createDataFrame(
        [("x", "sentiment_Positive", "1"), ("x", "sentiment_Positive", "2"),
         ("x", "sentiment_Neutral", "1"), ("x", "other", "9")],
        "topic string, metric string, value string")
    assert rows(counts.sentiment_share(metrics)) == [
        ("x", "Neutral", 1.0, 25.0), ("x", "Positive", 3.0, 75.0)]


def test_hashtags_with_and_without_topic(spark, rows):
    frame = spark.createDataFrame([("py", "#PyDay #pyday #Go"), ("py", None)], "topic string, text string")
    assert rows(counts.hashtag_counts(frame)) == [("py", "pyday", 2)]
    assert rows(counts.hashtag_counts(frame, by=(), topic=None)) == [
        ("Go", 1), ("PyDay", 1), ("pyday", 1)]


def test_api_results_bounds(spark):
    with pytest.raises(ValueError, match="10 to 100"):
        filters.api_results(spark.createDataFrame([], "topic string, text string"), 5)


def test_checks(spark, rows):
    frame = spark.createDataFrame([("Positive",), ("Mixed",), (None,)], "sentiment string")
    assert rows(quality.sentiment_domain(frame)) == [
        ("Mixed", False, 1), ("Positive", True, 1), (None, False, 1)]
    with pytest.raises(quality.InputRejected, match="text"):
        quality.require_columns(frame, ["text"])
    with pytest.raises(quality.InputRejected, match="no rows"):
        quality.require_rows(frame.filter("false"), "x")
    empty = quality.empty_posts(spark)
    assert counts.hourly_volume(empty).count() == 0
    assert nlp.score_posts(empty).count() == 0
    assert sets.distinct_locations(empty).count() == 0


def test_shared_folder_comes_from_the_session():
    def session(master, conf=None, context=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: conf or default),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context),
        )

    assert shared_folder(session("yarn", conf="hdfs:/shared/")) == "hdfs:/shared"
    assert shared_folder(session("yarn", context="hdfs:/set")) == "hdfs:/set"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))
