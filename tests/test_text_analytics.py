"""Gates, collocations, folded polarity, places and coherence against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse.functions import gate as gates
from postpulse.functions import sentiment
from postpulse.operators import collocations, joins, nlp, places, topics


# --- gates ----------------------------------------------------------------------
def test_a_gate_lets_all_of_its_values_through_and_few_others(spark):
    values = [f"w{i}" for i in range(3000)] + ["é", "", "two words"]
    frame = spark.createDataFrame([(v,) for v in (*values, "w1")], "word string")
    others = spark.createDataFrame([(f"x{i}",) for i in range(3000)], "word string")
    for opened in (gates.gate(frame, "word"), gates.gate_of(set(values))):
        assert frame.filter(~opened.opens(F.col("word"))).count() == 0
        assert others.filter(opened.opens(F.col("word"))).count() < 600


def test_a_full_gate_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(gates, "MAX_BITS", 64)
    frame = spark.createDataFrame([(f"w{i}",) for i in range(3000)], "word string")
    opened = gates.gate(frame, "word")
    assert opened.bits == 64 and frame.filter(~opened.opens(F.col("word"))).count() == 0


def test_only_gated_runs_of_words_become_rows(spark):
    """Of 400,000 words a few become rows: matches, and one in a hundred in vain."""
    text = " ".join(f"n{i}" for i in range(1000))
    rows = [("x", f"t{i}", f"{text} New York{' City' * (i % 2)}") for i in range(400)]
    frame = spark.createDataFrame(rows, "topic string, tweet_id string, cleaned_text string")
    names = [(f"Name{i} of Place{i}", "GPE") for i in range(500)] + [
        ("New York", "GPE"), ("New York City", "GPE"), ("York City", "ORG")]
    phrases = nlp.entity_phrases(spark.createDataFrame(names, "entity string, label string"))
    matches = 400 + 200 + 200
    rows_made = nlp.entity_candidates(frame, phrases, ["tweet_id"]).count()
    assert matches <= rows_made <= 2 * matches + 400 * 1000 // 50
    found = nlp.find_entities(frame, spark.createDataFrame(names, "entity string, label string"))
    assert found.count() == 400


# --- collocations ------------------------------------------------------------------
def plain_cloud(texts, stops, threshold):
    """Collocations and what is left of the words, counted in one go."""
    lists = [re.findall(r"[a-z]+", text) for text in texts]
    words = Counter(w for words in lists for w in words if w not in stops)
    pairs = Counter(p for words in lists for p in pairwise(words) if not set(p) & stops)
    total, kept = sum(words.values()), {}
    for (a, b), n in pairs.items():
        if total > words[a] and total > words[b]:
            def part(hits, tries, share):
                return hits * math.log(max(share, 1e-10)) + (tries - hits) * math.log(
                    max(1 - share, 1e-10))
            rest, others, free = words[b] - n, total - words[a], words[b] / total
            score = 2 * (part(n, words[a], n / words[a]) + part(rest, others, rest / others)
                         - part(n, words[a], free) - part(rest, others, free))
            if score > threshold:
                kept[a, b] = n, round(score, 3)
    left = Counter(words)
    for (a, b), (n, _) in kept.items():
        left[a] -= n
        left[b] -= n
    cloud = {w: n for w, n in left.items() if n > 0} | {" ".join(p): n for p, (n, _) in kept.items()}
    return kept, cloud


@pytest.mark.parametrize("by", (("topic",), ()))
def test_collocations_equal_a_plain_count(spark, rows, by):
    chance = random.Random(3)
    common = "red fox ran over the hill and saw the big dog".split()
    texts = []
    for _ in range(300):
        words = chance.choices(common, k=8)
        if chance.random() < 0.4:
            words += ["machine", "learning"]
        if chance.random() < 0.2:
            words += ["learning", "machine", "the", "learning"]
        texts.append(" ".join(words))
    frame = spark.createDataFrame([("x", t) for t in [*texts, "", None, "solo"]],
                                  "topic string, cleaned_text string")
    stops = {"the", "and"}
    kept, cloud = plain_cloud([*texts, "solo"], stops, 30.0)
    assert ("machine", "learning") in kept and 0 < len(kept) < 60
    table = spark.createDataFrame([("the",), ("and",), (None,), ("the",)], "word string")
    for words in (sorted(stops), table):
        found = collocations.collocations(frame, words, by)
        got = {(r["first"], r["second"]): (r["count"], r["score"]) for r in found.collect()}
        assert got.keys() == kept.keys()
        for pair, (n, score) in kept.items():
            assert got[pair][0] == n and got[pair][1] == pytest.approx(score, abs=0.002)
        counted = collocations.cloud_counts(frame, words, by)
        assert {r["word"]: r["count"] for r in counted.collect()} == cloud
    best = nlp.word_cloud(frame, sorted(stops), by, k=3).collect()
    assert sorted(r["count"] for r in best) == sorted(cloud.values())[-3:]


def test_one_word_has_no_collocation(spark):
    frame = spark.createDataFrame([("x", "la la la la")], "topic string, cleaned_text string")
    assert collocations.collocations(frame, []).count() == 0
    assert [tuple(r) for r in collocations.cloud_counts(frame, []).collect()] == [("x", "la", 4)]


def test_null_topics_are_one_group(spark):
    frame = spark.createDataFrame([(None, "big data rocks and big data rules")] * 30,
                                  "topic string, cleaned_text string")
    found = collocations.collocations(frame, ["and"])
    assert ("big", "data") in {(r["first"], r["second"]) for r in found.collect()}


# --- polarity ----------------------------------------------------------------------
ENTRIES = {
    "good": 0.7, "bad": (-0.7, 1.0), "great": 0.8, "very": (None, 1.3), "hardly": (None, 0.5),
    "not bad": 0.4, "bad not good": (-0.9, 1.0), "very very good": 1.0, "no doubt": (None, 1.5),
}
NEGATORS = ("not", "never", "no")


def plain_polarity(text, reach=1, factor=-0.5):
    """The same rule, one word after the other."""
    words, values = re.findall(r"[a-z]+", (text or "").lower()), []
    at, negated, boost, boosted = 0, -1, 1.0, -1
    while at < len(words):
        width = next((n for n in (3, 2) if " ".join(words[at:at + n]) in ENTRIES
                      and at + n <= len(words)), 1)
        entry = ENTRIES.get(" ".join(words[at:at + width]))
        if width == 1 and words[at] in NEGATORS:
            negated, boost, boosted = at + reach, 1.0, -1
        elif entry is not None:
            value, force = entry if isinstance(entry, tuple) else (entry, 1.0)
            before = boost if boosted == at else 1.0
            if value is None:
                if at <= negated:
                    negated += width
                boost, boosted = before * force, at + width
            else:
                value *= before * (factor if at <= negated else 1.0)
                values.append(max(-1.0, min(1.0, value)))
                negated, boost, boosted = -1, 1.0, -1
        at += width
    return round(sum(values) / len(values), 6) if values else 0.0


WORDS = st.lists(st.sampled_from(
    "good bad great very hardly not never no doubt the so x".split()), max_size=14).map(" ".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(WORDS, min_size=30, max_size=40), st.integers(1, 3))
def test_polarity_equals_a_plain_loop(spark, texts, reach):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    scored = frame.select("text", sentiment.polarity(F.col("text"), ENTRIES, NEGATORS, -0.5, reach))
    for text, score in scored.collect():
        assert score == pytest.approx(plain_polarity(text, reach), abs=2e-6), text


TEXTS = ["", None, "not very good", "not bad", "bad not good at all", "very very good", "no doubt great",
         "hardly very good", "not the good", "never no good", "very", "good" + " x" * 5000 + " bad",
         "very very very very good", "Not VERY Good", "not bad not bad bad"]


def test_a_lexicon_table_of_any_size_gives_the_same(spark, rows, monkeypatch):
    data = [("t", str(i), text) for i, text in enumerate([*TEXTS, TEXTS[2], TEXTS[2]])]
    frame = spark.createDataFrame(data, "topic string, tweet_id string, cleaned_text string")
    listed = [(w, *(e if isinstance(e, tuple) else (e, None))) for w, e in ENTRIES.items()]
    listed += [(None, 1.0, 1.0), ("the", None, None), ("good", -0.9, 9.0), ("--", 0.1, None),
               ("Great", 0.8, None), ("not", 0.9, 2.0)]
    table = spark.createDataFrame(listed, "word string, polarity double, intensity double")
    want = sorted((i, plain_polarity(t)) for _, i, t in data)
    small = nlp.with_polarity(frame, table)
    assert rows(small.select("tweet_id", "polarity")) == sorted(want, key=repr)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(nlp, "MAX_LEXICON_WORDS", 3)
    large = nlp.with_polarity(frame, table)
    assert rows(large.select("tweet_id", "polarity")) == sorted(want, key=repr)


# --- places ------------------------------------------------------------------------
GAZETTEER = [
    ("France", "France", 46.0, 2.0), ("Germany", "Germany", 51.0, 10.0), ("Paris", "France", 48.9, 2.4),
    ("New York", "United States", 40.7, -74.0), ("York", "United Kingdom", 54.0, -1.1),
    ("Côte d'Ivoire", "Ivory Coast", 7.5, -5.5), ("Niger", "Niger", 17.0, 8.0),
    ("Nigeria", "Nigeria", 9.0, 8.0), ("Oman", "Oman", 21.0, 57.0), (None, "Nowhere", 0.0, 0.0),
    (" , ", "Nowhere", 0.0, 0.0), ("germany", "Germany", 51.0, 10.0), ("UK", "United Kingdom", 55.0, -3.0),
]
LOCATIONS = [
    "PARIS, FRANCE", "BERLIN GERMANY", "FRANCE", "NEW YORK", "OLD  YORK", "GERMANNY", "FRNCE", "FRANXE",
    "SOMEWHERE IN FRANCA", "NIGERI", "OMAM", "ATLANTIS", "MOON/UK", "UKK", "CÔTE D'IVOIRE",
    "THE CÔTE D'IVOIR", "GERMANY, ATLANTIS", ",", "X" * 5000, "WORD " * 500 + "PARIS", "EW YORK", None,
]


def plain_place(location):
    """The same rule by trying everything."""
    known = {}
    for alias, *place in GAZETTEER:
        words = re.split(r"[\s,;/|()]+", (alias or "").upper().strip())
        key = " ".join(w for w in words if w)
        if key:
            known[key] = min(known.get(key, tuple(place)), tuple(place))
    words = [w for w in re.split(r"[\s,;/|()]+", location) if w]
    endings = [" ".join(words[i:]) for i in range(max(0, len(words) - 2), len(words))]
    for ending in endings:
        if ending in known:
            return (*known[ending], "name")

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for ending in endings:
        close = [alias for alias in known if len(alias) >= 5 <= len(ending) and near(alias, ending)]
        if close:
            return (*known[min(close)], "typing error")
    return None, None, None, None


def test_places_equal_trying_everything(spark):
    located = spark.createDataFrame([(x,) for x in [*LOCATIONS, "FRANCE"]], "location string")
    known = spark.createDataFrame(GAZETTEER, "alias string, country string, lat double, lon double")
    got = {r["location"]: tuple(r)[1:] for r in places.resolve_places(located, known).collect()}
    assert got == {x: plain_place(x) for x in LOCATIONS if x is not None}
    assert got["GERMANNY"][0] == "Germany" and got["BERLIN GERMANY"][3] == "name"
    assert got["NIGERI"][0] == "Niger" and got["OMAM"][0] is None
    nothing = places.resolve_places(located, known.limit(0)).collect()
    assert len(nothing) == len(got) and all(r["country"] is None for r in nothing)
    counted = located.groupBy("location").count()
    assert {r["location"] for r in joins.geocode(counted, known).collect()} == {
        x for x, place in got.items() if place[0]}


# --- topics ------------------------------------------------------------------------
def test_coherence_equals_a_plain_count(spark):
    chance = random.Random(4)
    texts = [" ".join({*chance.choices("cats dogs pets".split(), k=2), *chance.choices(
        "stocks bonds money".split(), k=chance.randrange(2)), "always"}) for _ in range(80)]
    frame = spark.createDataFrame([(t,) for t in [*texts, "", None]], "cleaned_text string")
    topics = [(0, w) for w in "cats dogs pets".split()] + [(1, w) for w in "cats bonds unseen".split()]
    topics += [(2, "alone"), (3, "always"), (3, "cats"), (3, "cats")]
    described = spark.createDataFrame(topics, "topic_id int, word string")
    sets = [set(t.split()) for t in texts] + [set(), set()]

    def share(*words):
        return sum(set(words) <= s for s in sets) / len(sets)

    want = {}
    for topic in {t for t, _ in topics}:
        words = sorted({w for t, w in topics if t == topic})
        values = []
        for i, a in enumerate(words):
            for b in words[i + 1:]:
                both = share(a, b)
                values.append(-1.0 if not both else math.log(
                    both / (share(a) * share(b))) / -math.log(both))
        if values:
            want[topic] = len(values), pytest.approx(sum(values) / len(values), abs=2e-6)
    got = {r["topic_id"]: (r["n_pairs"], r["coherence"]) for r in nlp.topic_coherence(
        described, frame).collect()}
    assert got == want
    assert nlp.topic_coherence(described.limit(0), frame).count() == 0


def test_topics_of_apart_texts_are_coherent(spark):
    texts = [("cats dogs pets cats animal",), ("stocks bonds money market",), ("goal match team win",)]
    frame = spark.createDataFrame(texts * 20, "cleaned_text string")
    topics = nlp.lda_topics(frame, words=4)
    good = [r["coherence"] for r in nlp.topic_coherence(topics, frame).collect()]
    mixed = spark.createDataFrame([(0, w) for w in "cats stocks goal".split()], "topic_id int, word string")
    bad = nlp.topic_coherence(mixed, frame).first()["coherence"]
    assert bad == -1.0 and min(good) > bad and sum(good) / len(good) > -0.5


def test_no_python_runs_on_posts(spark):
    """Words, entities, polarity and topics stay in the JVM."""
    frame = spark.createDataFrame([("x", "1", "a b")], "topic string, tweet_id string, cleaned_text string")
    names = spark.createDataFrame([("a b", "X")], "entity string, label string")
    for view in (nlp.find_entities(frame, names), nlp.word_frequencies(frame), nlp.lda_tokens(frame),
                 nlp.with_polarity(frame, K.LEXICON)):
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_topic_rounds_are_those_of_a_plain_loop(spark):
    """Blocks of a few words give the weights that one table of all words gives."""
    texts = ["cats dogs pets cats", "bonds money market", "goal match team goal", "cats goal money",
             "cats dogs pets cats", "market market match", "team"] * 3
    frame = spark.createDataFrame([(t,) for t in texts], "cleaned_text string").repartition(3)
    tokens = nlp.lda_tokens(frame).cache()
    k, seed, rounds = 3, 7, 6
    numbered, weights = topics.topic_weights(tokens, nlp.word_numbers, k, seed, rounds, words=5)
    term = {row["word"]: row["term"] for row in numbered.collect()}
    got = {row["term"]: [row[f"w{t}"] for t in range(k)] for row in weights.collect()}
    posts = [(row["draw"], Counter(row["tokens"])) for row in tokens.select(
        "tokens", F.xxhash64("tokens").alias("draw")).collect()]
    cells = [(p, draw, term[w], n) for p, (draw, words) in enumerate(posts) for w, n in words.items()]
    share = [list(topics.drawn_shares(np.array([draw]), np.array([w]), k, seed)[:, 0])
             for _, draw, w, _ in cells]
    for turn in range(rounds + 1):
        by_word = [[0.0] * k for _ in term]
        by_post = [[0.0] * k for _ in posts]
        for (p, _, w, n), s in zip(cells, share):
            for t in range(k):
                by_word[w][t] += n * s[t]
                by_post[p][t] += n * s[t]
        total = [sum(row[t] for row in by_word) for t in range(k)]
        share = []
        for p, _, w, _ in cells:
            raw = [(by_word[w][t] + 0.1) / (total[t] + 0.1 * len(term)) * (by_post[p][t] + 50 / k)
                   for t in range(k)]
            share.append([x / sum(raw) for x in raw])
    assert set(got) == set(term.values())
    for w, row in got.items():
        assert row == pytest.approx([by_word[w][t] / total[t] for t in range(k)], rel=1e-9)


def test_topics_do_not_depend_on_where_posts_lie(spark, rows):
    """The same texts in another order and other partitions give the same model."""
    texts = [("cats dogs pets cats animal",), ("stocks bonds money market",), ("goal match team",),
             ("goal money cats",)]
    frame = spark.createDataFrame(texts * 5, "cleaned_text string")
    other = spark.createDataFrame(texts[::-1] * 5, "cleaned_text string").repartition(5)
    one, two = rows(nlp.lda_topics(frame, words=4)), rows(nlp.lda_topics(other, words=4))
    assert [r[:3] for r in one] == [r[:3] for r in two]
    assert [r[3] for r in one] == pytest.approx([r[3] for r in two], abs=1e-9)
