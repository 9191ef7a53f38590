"""Words found for many texts at once, against the patterns that define them."""

import pytest
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.functions import sentiment as S
from postpulse.operators.word_counts import REST, word_counts

TEXTS = [
    "A dog's tail, the dog's it's 12's 'tis x''s ''s 's a's's 12' 12'sx", "b a b a b a", "a b", None, "",
    " ' ", "café ÉTÉ naïve—dash", "great\U0001f600bad 7 seven7",
    "ΣίσυφοΣ a b", "İzmir a", "\U00010400 b", "漢字 漢字 c",
]
# Letters that are not the same in all versions of Unicode, or whose lower case depends on others.
ODD = TEXTS[8:11]


@pytest.fixture(scope="module")
def posts(spark):
    rows = [("x" if i % 2 else None, text) for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "topic string, cleaned_text string").coalesce(1)


def test_pairs_are_those_of_the_pattern(posts):
    listed = posts.select("topic", P.words(F.col("cleaned_text")).alias("words"))
    wanted = {}
    for topic, words in listed.collect():
        for pair in zip(words, [*words[1:], None]):
            wanted[topic, *pair] = wanted.get((topic, *pair), 0) + 1
    found = word_counts(posts, ["topic"], "cleaned_text", True).groupBy(
        "topic", "first", "second").agg(F.sum("count"))
    assert {tuple(row[:3]): row[3] for row in found.collect()} == wanted


def test_a_task_counts_before_rows_leave_it(spark):
    posts = spark.createDataFrame([("x", "a b " * 500)] * 40, "topic string, cleaned_text string")
    rows = word_counts(posts.coalesce(1), ["topic"], "cleaned_text", False).collect()
    assert sorted(map(tuple, rows)) == [("x", "a", 20000), ("x", "b", 20000)]
    assert REST not in posts.columns


def test_hits_are_those_of_the_row(posts):
    lexicon = S.entries_of({**K.LEXICON, "not good": 0.3, "very": (None, 1.5), "it's 12's": 1.0})
    more = posts.unionByName(posts.sparkSession.createDataFrame(
        [(None, text) for text in ("It's 12's GREAT", "not good; NOT Bad very 'good' ''bad no good not")],
        posts.schema))
    text = F.col("cleaned_text")
    scanned = S.scanned_hits(lexicon, K.NEGATORS)(text)
    in_row = S.hits(F.col("words"), lexicon, K.NEGATORS)
    rows = more.withColumn("words", S.sentiment_words(text)).select(
        "cleaned_text", scanned.alias("scanned"), in_row.alias("in_row")).collect()
    assert {row["cleaned_text"] for row in rows if row["scanned"] is None} == set(ODD)
    for row in rows:
        if row["scanned"] is not None:
            assert row["scanned"] == (row["in_row"] or []), row["cleaned_text"]
