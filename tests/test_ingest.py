"""Sources, store and exports on small files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postpulse.operators import counts, nlp, quality
from postpulse.plans import jobs
from postpulse.sinks import export, store
from postpulse.sources import api, csv_posts
from postpulse.sources import store as stored

NOW = datetime(2024, 5, 1, 8)
CSV = '''Text,Timestamp,User,Hashtags,Retweets,Likes,Country,Extra
"Rain, then sun","2022-11-03 06:45:10",@mira,"['#Python','Tech']",17,93,Peru,a
"tagged #PythonDev","2023-01-15T10:00:00Z",u2,"#PythonDev #py",x,1e3,  usa ,b
"broken",01/15/2023 10:00,u3,"['python'",-3.9,"1,000",unknown,c
"only text #python",junk,u4,#other,1d,,None,d
"no tags #python",,u5,,1,1,,e
"two
lines and ""quotes"" #café #日本語",,,#python,1,1,,f
"RT @bob: START now",2023-01-15 10:00:00,u6,python #Python,1,1,x,g
"RT @bob: START now",2023-01-15 10:00:00,u7,NaN #python,1,1,x,h
'''


@pytest.fixture()
def csv_file(tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(CSV, encoding="utf8")
    return str(path)


def by_user(frame):
    return {row["username"]: row for row in frame.collect()}


def test_csv_posts(spark, csv_file):
    posts = by_user(csv_posts.read_posts(spark, csv_file, "Python", NOW))
    # The topic only in the text, or a missing tag cell, drops the row.
    assert sorted(posts) == ["@mira", "u2", "u3", "u6", "u7", "unknown"]
    assert posts["@mira"]["tags"] == ["Python", "Tech"]
    assert posts["u2"]["tags"] == ["PythonDev", "py", "PythonDev"]
    assert posts["u3"]["tags"] == []
    assert [posts["u2"][n] for n in ("retweet_count", "like_count")] == [0, 1000]
    assert [posts["u3"][n] for n in ("retweet_count", "like_count")] == [-3, 0]
    assert posts["u3"]["created_at"] == datetime(2023, 1, 15, 10)
    assert posts["unknown"]["text"] == 'two\nlines and "quotes" #café #日本語'
    assert posts["unknown"]["created_at"] == NOW
    assert posts["unknown"]["location"] is None and posts["u2"]["location"] == "  usa "
    assert posts["u6"]["tweet_id"] == posts["u7"]["tweet_id"]
    assert {row["platform"] for row in posts.values()} == {"twitter"}


def test_csv_aliases_coalesce_in_order(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Tweet,text,Text,Likes,Favorites,hashtags,location\nt1,t2,,,7,#a,x\n")
    frame = csv_posts.alias_columns(csv_posts.read_csv(spark, str(path)))
    assert frame.collect()[0].asDict() == {
        "text": "t2", "like_count": "7", "hashtags": "#a", "location": "x"}


def test_csv_files_with_other_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Text,User,Hashtags,Likes\nhello,ann,#x,7\n")
    (tmp_path / "2.csv").write_text("User,Tweet,Likes,Hashtags\nbob,world,9,#x\n")
    (tmp_path / "3.csv").write_text("text,hashtags\nbare,#x\n")
    posts = csv_posts.read_posts(spark, str(tmp_path), "x", NOW)
    found = {r["text"]: (r["username"], r["like_count"], r["created_at"]) for r in posts.collect()}
    assert found == {"hello": ("ann", 7, NOW), "world": ("bob", 9, NOW),
                     "bare": ("unknown", 0, NOW)}
    raw = csv_posts.read_csv(spark, str(tmp_path))
    assert {r["User"] for r in raw.collect()} == {"ann", "bob", None}


ODD_NAMES = ["a b.csv", "a{1}.csv", "[x]y.csv", "100%25.csv", "a+b&c.csv", "back\\slash.csv", "é ü.csv"]


@pytest.mark.parametrize("multiline", (True, False))
def test_csv_files_of_any_name(spark, tmp_path, multiline):
    for i, name in enumerate(ODD_NAMES):
        (tmp_path / name).write_text(f"Text,User\nhello,u{i}\n" if i % 2 else f"User,Tweet\nu{i},hello\n")
    # These would be read as well if a name were taken for a pattern.
    (tmp_path / "a1.csv").write_text("Text,User\nother,o1\n")
    (tmp_path / "xy.csv").write_text("Text,User\nother,o2\n")
    found = csv_posts.read_csv(spark, str(tmp_path), multiline)
    got = sorted(row["User"] for row in found.collect())
    assert got == sorted([*(f"u{i}" for i in range(len(ODD_NAMES))), "o1", "o2"])
    groups = csv_posts.files_by_header(spark, str(tmp_path))
    assert sorted(map(len, groups)) == [4, 5]


LONG = '''Text,User
hello,bob,EXTRA,MORE
fits,ann
"a, b",carl
short
"quoted ""x"", y",dan,EXTRA
empty cells,eve,,
,,,last
'''


@pytest.mark.parametrize("multiline", (True, False))
def test_rows_with_too_many_cells_are_rejected(spark, tmp_path, multiline):
    (tmp_path / "a b{1}.csv").write_text(LONG)
    (tmp_path / "other.csv").write_text("Text\nfine\n")
    rows = csv_posts.read_csv(spark, str(tmp_path), multiline).collect()
    assert sorted((r["Text"], r["User"]) for r in rows if r["Text"]) == sorted([
        ("fits", "ann"), ("a, b", "carl"), ("short", None), ("empty cells", "eve"), ("fine", None)],
        key=repr)
    rejected = csv_posts.rejected_rows(spark, str(tmp_path), multiline).collect()
    assert sorted(r["raw"] for r in rejected) == sorted([
        "hello,bob,EXTRA,MORE", '"quoted ""x"", y",dan,EXTRA', ",,,last"])
    assert {r["reason"] for r in rejected} == {"more cells than headers"}
    assert {r["file"].split("/")[-1] for r in rejected} == {"a b{1}.csv"}


def test_only_the_first_line_of_a_file_is_taken(spark, tmp_path):
    def rows(start):
        for i in range(5):
            pulled.append(i)
            yield {"start": start, "file": "f", "value": f"line {i}"}

    for start, found in ((0, [("f", "line 0")]), (1 << 20, [])):
        pulled = []
        assert list(csv_posts._first_lines(rows(start))) == found and pulled == [0]
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text("Text,User\nword,someone\n" * 10)
    assert [len(g) for g in csv_posts.files_by_header(spark, str(tmp_path))] == [5]
    (tmp_path / "empty.csv").write_text("")
    assert csv_posts.read_csv(spark, str(tmp_path)).count() == 95


def test_an_import_keeps_what_does_not_fit(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Text,Hashtags\nhello,#x\nlong,#x,EXTRA\n")
    root = str(tmp_path / "store")
    for _ in range(2):
        jobs.import_csv(spark, str(path), "x", root, "b 1", now=NOW)
        assert stored.read_table(spark, root, "tweets").count() == 1
        kept = spark.read.parquet(f"{root}/rejected")
        assert [(r["raw"], r["batch_id"]) for r in kept.collect()] == [("long,#x,EXTRA", "b 1")]


def test_csv_without_text_or_topic_is_rejected(spark, tmp_path, csv_file):
    path = tmp_path / "b.csv"
    path.write_text("Hashtags\n#python\n")
    with pytest.raises(quality.InputRejected, match="text"):
        csv_posts.read_posts(spark, str(path), "python", NOW)
    with pytest.raises(quality.InputRejected, match="no rows"):
        jobs.import_csv(spark, csv_file, "cobol", str(tmp_path / "s"), "1", now=NOW)


def response(topic, at, posts, users):
    return json.dumps({
        "topic": topic, "requested_at": at,
        "data": [
            {"id": i, "text": t, "created_at": at, "author_id": a,
             "public_metrics": {"retweet_count": r, "like_count": 1}} for i, t, a, r in posts
        ],
        "includes": {"users": [
            {"id": u, "username": f"name {u}", "public_metrics": {"followers_count": f}}
            for u, f in users]},
    })


@pytest.fixture()
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    lines = [
        response("Spark", "2024-05-01T07:30:00Z", [("1", "great #SparkDev", "a", 3),
                                                   ("2", "terrible #spark", "gone", 5)], [("a", 9)]),
        response("spark", "2024-05-01T08:00:00Z", [("3", "fire #spark", "b", 1)], [("b", 2)]),
        response("spark", "2024-05-01T08:30:00Z", [("4", "late #spark", "b", 1)], [("b", 2)]),
        response("other", "2024-05-01T08:30:00Z", [], []),
    ]
    for i, line in enumerate(lines):
        (folder / f"{i}.json").write_text(line)
    return str(folder)


def test_api_posts(spark, landed):
    posts = {row["tweet_id"]: row for row in api.read_batch(spark, landed).collect()}
    assert sorted(posts) == ["1", "2", "3", "4"]
    assert (posts["1"]["username"], posts["1"]["user_followers"]) == ("name a", 9)
    assert (posts["2"]["username"], posts["2"]["user_followers"]) == ("unknown", 0)
    assert posts["3"]["location"] is None


def contents(spark, root):
    return {name: sorted(map(repr, stored.read_table(spark, root, name).collect()))
            for name in store.STORE_TABLES}


def test_store_keeps_runs_and_survives_a_replay(spark, landed, csv_file, tmp_path):
    root = str(tmp_path / "store")
    jobs.ingest_responses(spark, landed, root, "first")
    once = contents(spark, root)
    assert len(once["searches"]) == 2 and len(once["tweets"]) == 4
    jobs.ingest_responses(spark, landed, root, "first")
    assert contents(spark, root) == once
    # The same posts polled again under another batch are appended.
    jobs.ingest_responses(spark, landed, root, "second")
    twice = contents(spark, root)
    assert len(twice["searches"]) == 2 and len(twice["tweets"]) == 8

    latest = stored.read_latest(spark, root, "SPARK")
    # Requests of the second batch older than the open run went into it.
    ids = sorted(row["tweet_id"] for row in latest["tweets"].collect())
    assert ids == ["1", "2", "3", "4", "4"]
    tags = {row["hashtag"]: row["count"] for row in latest["hashtags"].collect()}
    assert tags == {"spark": 4, "sparkdev": 1}
    every = stored.read_latest(spark, root)["tweets"]
    assert sorted(row["tweet_id"] for row in every.collect()) == ids
    assert stored.read_latest(spark, root, "unheard of")["tweets"].count() == 0
    plan = latest["tweets"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan


def test_csv_import_continues_the_newest_run(spark, csv_file, tmp_path):
    root = str(tmp_path / "store")
    jobs.import_csv(spark, csv_file, "Python", root, "1", now=NOW)
    later = datetime(2024, 6, 1)
    jobs.import_csv(spark, csv_file, "python", root, "2", now=later)
    found = stored.read_table(spark, root, "searches").collect()
    assert [(row["topic"], row["timestamp"], row["source"]) for row in found] == [
        ("Python", NOW, "csv")]
    tweets = stored.read_table(spark, root, "tweets")
    assert tweets.count() == 12 and tweets.select("search_id").distinct().count() == 1
    metrics = stored.read_table(spark, root, "analytics").withColumn("topic", F.lit("python"))
    shares = {r["sentiment"]: r["posts"] for r in counts.sentiment_share(metrics).collect()}
    assert sum(shares.values()) == 12


def test_a_retry_on_another_day_leaves_one_copy(spark, csv_file, tmp_path):
    root = str(tmp_path / "store")
    jobs.import_csv(spark, csv_file, "python", root, "b 1", now=datetime(2024, 1, 1, 23, 59))
    once = contents(spark, root)
    jobs.import_csv(spark, csv_file, "python", root, "b 1")
    assert contents(spark, root) == once
    jobs.import_csv(spark, csv_file, "python", root, "b 1", now=datetime(2024, 1, 2, 0, 5))
    again = contents(spark, root)
    assert {k: len(v) for k, v in again.items()} == {k: len(v) for k, v in once.items()}
    fewer = tmp_path / "fewer.csv"
    fewer.write_text("text,hashtags\nno tag in the text,Python\n")
    jobs.import_csv(spark, str(fewer), "python", root, "b 1", now=datetime(2024, 1, 3))
    assert len(contents(spark, root)["tweets"]) == 1 and not contents(spark, root)["hashtags"]


def test_init_keeps_what_is_there(spark, landed, tmp_path):
    root = str(tmp_path / "store")
    store.init_tables(spark, root)
    assert all(not rows for rows in contents(spark, root).values())
    jobs.ingest_responses(spark, landed, root, "1")
    store.init_tables(spark, root)
    assert len(contents(spark, root)["tweets"]) == 4


def test_topic_views_and_exports(spark, landed, tmp_path):
    posts = nlp.score_posts(api.read_batch(spark, landed))
    places = spark.createDataFrame([], "alias string, country string, lat double, lon double")
    names = spark.createDataFrame([("SparkDev", "PRODUCT")], "entity string, label string")
    views = jobs.topic_views(posts, places, names)
    assert views["metrics"].filter("topic = 'spark'").first()["crisis_score"] == 100.0
    for name, view in views.items():
        export.write_csv(view, str(tmp_path / f"{name}.csv"))
        export.write_json(view, str(tmp_path / f"{name}.json"))
        assert spark.read.schema(view.schema).json(str(tmp_path / f"{name}.json")).count() == view.count()
    report = json.loads(export.topic_reports(posts).filter("topic = 'Spark'").first()["report"])
    assert report["top_hashtags"] == [{"hashtag": "spark", "count": 1}, {"hashtag": "sparkdev", "count": 1}]
    assert report["avg_retweets"] == 4.0 and report["alert_level"] == "Normal"
