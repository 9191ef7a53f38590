"""What moves texts: shuffles and files, and word lists against plain Python."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postpulse import functions as P
from postpulse.functions import gate as gates
from postpulse.operators import nlp, runs
from postpulse.plans import driver_views
from postpulse.sinks import export, store
from postpulse.sources import csv_posts


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_posts_are_not_shuffled_with_their_texts(spark, tmp_path, no_broadcast):
    at = datetime(2024, 1, 1)
    tables = {
        "events": ([(i, at, i % 3, "click", 1.0) for i in range(20)],
                   "event_id long, ts timestamp, user_id long, event_type string, value double"),
        "documents": ([(i, f"text {i}") for i in range(7)], "doc_id long, text string"),
        "customer": ([(i, 1.0, "BUILDING", 0) for i in range(3)],
                     "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int"),
        "nation": ([(0, "NOWHERE")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    posts = driver_views.posts(spark, str(tmp_path))
    joins = [line for line in plan_of(posts).splitlines() if "Join" in line]
    assert "doc_id" in joins[0], "the text is joined last"
    assert posts.count() == 20


def test_runs_are_found_without_a_shuffle_of_posts(spark):
    rng, at = random.Random(7), datetime(2024, 1, 5)
    asked = [(rng.choice(["Spark", "spark", "tech", None]),
              rng.choice([at + timedelta(seconds=rng.randrange(20 * 86400)), at, None]))
             for _ in range(400)]
    posts = spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(asked)],
                                  "topic string, requested_at timestamp, i long")
    folded = runs.topic_runs(posts)
    placed = runs.assign_runs(posts, folded)
    assert "SortMergeJoin" not in plan_of(placed)
    by_second = posts.withColumns({
        "topic_key": F.lower("topic"), "second": F.unix_seconds("requested_at")}).join(
        runs.with_search_id(folded), ["topic_key", "second"])
    want = by_second.select("i", "search_id", F.timestamp_seconds("run_second").alias("run_start"))
    assert sorted(placed.select("i", "search_id", "run_start").collect()) == sorted(want.collect())


def test_compressed_csv_is_read_back(spark, tmp_path):
    frame = spark.createDataFrame([("a\nb, \"c\"", "x"), ("é", "y")], "Text string, User string")
    export.write_csv(frame, f"{tmp_path}/out", compression="gzip")
    assert list(tmp_path.glob("out/*.csv.gz"))
    got = csv_posts.read_csv(spark, f"{tmp_path}/out")
    assert sorted(got.collect()) == sorted(frame.collect())


def test_the_store_is_written_as_zstd(spark, tmp_path):
    at = datetime(2024, 1, 1)
    posts = spark.createDataFrame([("spark", at, "1", "a great day", at, 1, 1, "u", 1, None, "x")],
                                  "topic string, requested_at timestamp, tweet_id string, text string, "
                                  "created_at timestamp, retweet_count long, like_count long, "
                                  "username string, user_followers long, location string, platform string")
    store.init_tables(spark, str(tmp_path))
    store.ingest(str(tmp_path), nlp.score_posts(posts), "b")
    files = list(tmp_path.glob("tweets/batch_id=b/*/*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_few_values_are_a_set_not_a_bitmap(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "word string")
    for gate in (gates.gate(frame, "word"), gates.gate_of({"a", "b"})):
        assert gate.values == ("a", "b")
        row = spark.createDataFrame([(["x", "b", "a", "a"], []), (None, None)],
                                    "words array<string>, none array<string>")
        got = row.select(gate.places(F.col("words")), gate.places(F.col("none"))).collect()
        assert [tuple(r) for r in got] == [([1, 2, 3], None), (None, None)]


def test_word_patterns_do_what_filters_did(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1s9_'  'é\nÉS-") for _ in range(rng.randrange(60)))
             for _ in range(3000)] + ["''" * 20000, "a" + "'" * 20000 + "s", "", "s's's", "12's", "1''s"]
    frame = spark.createDataFrame([(t,) for t in (*texts, None)], "t string")
    got = frame.select("t", P.words(F.col("t")).alias("w"), nlp.lda_words(F.col("t")).alias("l"))
    assert "lambdafunction" not in plan_of(got)
    for text, words, letters in got.collect():
        found = re.findall(r"\w[\w']*", (text or "").lower())
        cut = [w[:-2] if w.endswith("'s") else w for w in found]
        assert words == [w for w in cut if not re.fullmatch("[0-9]+", w)]
        if text is not None:
            runs_of = re.findall(r"[^\W\d]+", text.lower())
            assert letters == [w for w in runs_of if 2 <= len(w) <= 15 and not w.startswith("_")]
