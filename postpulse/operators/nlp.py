"""Text analytics: scoring, word weights, entities, topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse import constants as K
from postpulse import functions as P
from postpulse.functions.gate import gate, listed
from postpulse.functions.sentiment import HIT, MAX_LEXICON_WORDS, Entry, folded, sentiment_words
from postpulse.functions.text import names
from postpulse.operators.collocations import cloud_counts, collocations
from postpulse.operators.ranking import top_k
from postpulse.operators.topics import topic_weights
from postpulse.operators.word_counts import word_counts
from postpulse.session import scratch_path


# --- sentiment ----------------------------------------------------------------
def _lexicon_table(lexicon: DataFrame) -> DataFrame:
    """One row per phrase: ``phrase``, ``polarity``, ``intensity``, ``n`` words, ``head``.

    Words are read as those of texts. Rows without a word, or with neither polarity nor
    intensity, are left out; of several rows for a phrase the highest polarity counts, then
    the highest intensity.
    """
    if "intensity" not in lexicon.columns:
        lexicon = lexicon.withColumn("intensity", F.lit(None).cast("double"))
    known = lexicon.select(sentiment_words(F.col("word")).alias("words"), "polarity", "intensity")
    best = known.filter((F.size("words") > 0) & F.coalesce("polarity", "intensity").isNotNull()).groupBy(
        F.array_join("words", " ").alias("phrase")).agg(
        F.max(F.struct("polarity", "intensity")).alias("best"), F.first("words").alias("words"))
    return best.select(
        "phrase", "best.polarity", F.coalesce("best.intensity", F.lit(1.0)).alias("intensity"),
        F.size("words").alias("n"), F.get("words", 0).alias("head"))


def _with_joined_polarity(posts: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Polarity by a lexicon of any size: what passes its gates is joined, not the posts.

    Only the hits of distinct texts are shuffled, and one number per distinct text comes
    back by the digest of the text.
    """
    digest = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    stops = posts.sparkSession.createDataFrame([(w,) for w in K.NEGATORS], "phrase string").select(
        "phrase", F.lit(None).cast("double").alias("polarity"), F.lit(1.0).alias("intensity"),
        F.lit(1).alias("n"), F.col("phrase").alias("head"), F.lit(True).alias("negates"))
    entries = known.withColumn("negates", F.lit(False)).join(
        stops.filter(F.col("n") == 1).select("phrase"), "phrase", "left_anti").unionByName(stops)
    placed = phrase_candidates(
        posts.select(digest.alias("digest"), sentiment_words(F.col(column)).alias("words")),
        entries, ["digest"])
    found = placed.distinct().join(
        entries.select(F.col("phrase").alias("known"), "polarity", "intensity", "negates"),
        F.col("phrase") == F.col("known"))
    # Of entries that begin at one place the longest counts; hits of a text are few.
    longest = found.groupBy("digest", "position").agg(F.max_by(F.struct(
        F.col("position").alias("at"), F.col("n").alias("width"), "polarity", "intensity", "negates"),
        "n").alias("hit"))
    means = longest.groupBy("digest").agg(
        folded(F.sort_array(F.collect_list("hit")).cast(f"array<{HIT}>")).alias("polarity"))
    keyed = posts.withColumn("__digest", digest)
    return keyed.join(means.withColumnRenamed("digest", "__digest"), "__digest", "left").drop(
        "__digest").withColumn("polarity", F.coalesce("polarity", F.lit(0.0)))


def with_polarity(
    posts: DataFrame,
    lexicon: DataFrame | Mapping[str, Entry] = K.LEXICON,
    column: str = "cleaned_text",
) -> DataFrame:
    """Add ``polarity``.

    A mapping is part of the program and becomes part of the expression, and so does a table
    (``word`` or words, ``polarity``, and optionally ``intensity``) whose size allows it: then
    posts are not shuffled. A larger table is joined with what its gates let through.
    """
    if isinstance(lexicon, Mapping):
        return posts.withColumn("polarity", P.polarity(F.col(column), lexicon))
    known = _lexicon_table(lexicon)
    rows = known.limit(MAX_LEXICON_WORDS + 1).collect()
    if len(rows) > MAX_LEXICON_WORDS:
        return _with_joined_polarity(posts.drop("polarity"), known, column)
    entries = {row["phrase"]: (row["polarity"], row["intensity"]) for row in rows}
    return posts.withColumn("polarity", P.polarity(F.col(column), entries))


def score_posts(
    posts: DataFrame, lexicon: DataFrame | Mapping[str, Entry] = K.LEXICON
) -> DataFrame:
    """Add ``cleaned_text``, ``polarity`` and ``sentiment`` to posts."""
    cleaned = posts.withColumn("cleaned_text", P.clean_text(F.col("text")))
    scored = with_polarity(cleaned, lexicon)
    return scored.withColumn("sentiment", P.sentiment_label(F.col("polarity")))


# --- words --------------------------------------------------------------------
def _weights(
    counted: DataFrame, name: str, by: Sequence[str], k: int, *more: str
) -> DataFrame:
    """The ``k`` most frequent per group, with the count relative to the largest."""
    best = top_k(counted, by, [F.desc("count"), F.asc(name)], k)
    largest = F.max("count").over(Window.partitionBy(*by))
    weight = F.round(F.col("count") / largest, 6).alias("weight")
    return best.select(*by, name, "count", *more, weight)


def _word_table(spark: SparkSession, words: DataFrame | Sequence[str]) -> DataFrame:
    """Words as a table without nulls."""
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(word,) for word in words], "word string")
    return words.select("word").dropna().distinct()


def word_frequencies(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = K.STOPWORDS,
    by: Sequence[str] = ("topic",),
    k: int = K.TOP_WORDS,
    column: str = "cleaned_text",
) -> DataFrame:
    """Word-cloud weights: the most frequent words that are no stop words.

    Stop words are taken out after counting, from distinct words only. Nulls among
    them are ignored.
    """
    found = word_counts(posts, by, column, False).withColumnRenamed("first", "word")
    counted = found.groupBy(*by, "word").agg(F.sum("count").alias("count"))
    known = _word_table(posts.sparkSession, stopwords)
    return _weights(counted.join(known, "word", "left_anti"), "word", by, k)


def word_bigrams(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = K.STOPWORDS,
    by: Sequence[str] = ("topic",),
    k: int = K.TOP_WORDS,
    column: str = "cleaned_text",
    threshold: float | None = K.COLLOCATION_THRESHOLD,
) -> DataFrame:
    """Weights and scores of word pairs next to each other in one post, neither a stop word.

    Pairs that chance explains are left out (see ``operators.collocations``), or none
    without a ``threshold``.
    """
    pairs = collocations(posts, stopwords, by, column, threshold)
    named = pairs.select(*by, F.concat_ws(" ", "first", "second").alias("bigram"), "count", "score")
    return _weights(named, "bigram", by, k, "score")


def word_cloud(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = K.STOPWORDS,
    by: Sequence[str] = ("topic",),
    k: int = K.TOP_WORDS,
    column: str = "cleaned_text",
    threshold: float = K.COLLOCATION_THRESHOLD,
) -> DataFrame:
    """Weights of words and collocations together; words count without their collocations."""
    return _weights(cloud_counts(posts, stopwords, by, column, threshold), "word", by, k)


# --- entities -----------------------------------------------------------------
def entity_phrases(entity_dict: DataFrame) -> DataFrame:
    """Entries of a dictionary by their words: ``entity``, ``label``, ``phrase``, ``n``, ``head``.

    Entries with a null or without a word are left out, repeated ones are one.
    """
    split = entity_dict.select("entity", "label").dropna().distinct().withColumn(
        "words", names(F.col("entity"))).filter(F.size("words") > 0)
    return split.select(
        "entity", "label", F.array_join("words", " ").alias("phrase"),
        F.size("words").alias("n"), F.get("words", 0).alias("head"))


def phrase_candidates(worded: DataFrame, phrases: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Runs of ``words`` that may be phrases: ``keep``, ``position``, ``n``, ``phrase``.

    ``phrases`` has ``phrase``, its number of words ``n`` and the first of them, ``head``.
    Inside the row, a gate is asked for every word whether a phrase begins with it; only
    there are phrases of the lengths that occur built, and shown to the gate of phrases.
    """
    # The lengths that occur: a few numbers, whatever the size of the dictionary.
    lengths = sorted(row[0] for row in phrases.select("n").distinct().collect())
    if not lengths:
        return worded.select(*keep, F.lit(0).alias("position"), F.lit(0).alias("n"),
                             F.lit("").alias("phrase")).filter(F.lit(False))
    heads, whole = gate(phrases, "head"), gate(phrases, "phrase")

    def found(words: Column) -> Column:
        starts = heads.places(words)

        def at(i: Column) -> Column:
            runs = [F.struct(i.alias("position"), F.lit(n).alias("n"), F.array_join(
                F.slice(words, i + 1, n), " ").alias("phrase")) for n in lengths]
            return F.filter(F.array(*runs), lambda run: (
                i + run["n"] <= F.size(words)) & whole.opens(run["phrase"]))

        return F.flatten(F.transform(starts, at))

    # The word list is bound once, as the only element of an array.
    return worded.select(*keep, F.inline(F.get(F.transform(F.array("words"), found), 0)))


def entity_candidates(
    posts: DataFrame, phrases: DataFrame, keep: Sequence[str], column: str = "cleaned_text"
) -> DataFrame:
    """Runs of words of posts that may be entities, with ``__text`` to tell posts apart."""
    worded = posts.select(
        *keep, F.xxhash64(column).alias("__text"), names(F.col(column)).alias("words"))
    return phrase_candidates(worded, phrases, [*keep, "__text"])


def find_entities(
    posts: DataFrame,
    entity_dict: DataFrame,
    keep: Sequence[str] = ("topic", "tweet_id"),
    column: str = "cleaned_text",
) -> DataFrame:
    """Dictionary entities of any length in each post, case kept.

    Entities are split into words as the texts are, so signs between words do not
    matter; entries with a null or without a word are ignored. Runs of words that pass the
    gates are looked up by a join, so the dictionary may have any size. A match lying
    inside a longer one is dropped. Result: ``keep``, ``position`` (of the first word),
    ``entity`` as it is in the dictionary, ``label``.
    """
    phrases = entity_phrases(entity_dict)
    placed = entity_candidates(posts, phrases, keep, column)
    labels = phrases.select("entity", "label", F.col("phrase").alias("__phrase"))
    found = placed.join(labels, F.col("phrase") == F.col("__phrase"))
    # Inside a post, a match is enclosed if an earlier or longer one reaches its end.
    post = [*keep, "__text"]
    reach = F.max(F.col("position") + F.col("n")).over(
        Window.partitionBy(*post).orderBy("position", F.desc("n"))
        .rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy(*post, "position", "n").agg(
        F.collect_list(F.struct("entity", "label")).alias("__hits"))
    open_spans = spans.withColumn("__reach", reach).filter(
        F.col("__reach").isNull() | (F.col("__reach") < F.col("position") + F.col("n")))
    return open_spans.select(*keep, "position", F.inline("__hits"))


def entity_counts(
    entities: DataFrame, by: Sequence[str] = ("topic",), k: int = K.TOP_ENTITIES
) -> DataFrame:
    """The most frequent entities with their labels."""
    counted = entities.groupBy(*by, "entity", "label").agg(F.count("*").alias("count"))
    return top_k(counted, by, [F.desc("count"), F.asc("entity"), F.asc("label")], k)


# --- topics -------------------------------------------------------------------
LDA_RESULT = "topic_id int, rank int, word string, weight double"


def lda_topics(
    posts: DataFrame,
    topics: int = K.LDA_TOPICS,
    words: int = K.LDA_WORDS,
    seed: int = K.LDA_SEED,
    stopwords: Sequence[str] = (),
    column: str = "cleaned_text",
) -> DataFrame:
    """Top words of LDA topics: ``topic_id``, ``rank``, ``word``, ``weight``.

    Words are lower-cased runs of letters of 2 to 15 characters, and all of them are in
    the model. The weights of words stay distributed (see ``operators.topics``).
    """
    fitted = topic_weights(lda_tokens(posts, stopwords, column), word_numbers, topics, seed)
    if fitted is None:
        return posts.sparkSession.createDataFrame([], LDA_RESULT)
    numbered, weights = fitted
    # Sums are taken in any order: what differs behind the 12th digit counts as equal.
    each = F.inline(F.array(*[F.struct(
        F.lit(topic).alias("topic_id"), F.round(f"w{topic}", 12).alias("weight"))
        for topic in range(topics)]))
    described = weights.select("term", each).join(numbered, "term").select(
        "topic_id", "word", "weight")
    order = [F.desc("weight"), F.asc("word")]
    best = _stored(top_k(described, ["topic_id"], order, words), "lda-topics")
    ranked = F.row_number().over(Window.partitionBy("topic_id").orderBy(*order))
    return best.select("topic_id", ranked.alias("rank"), "word", "weight")


def lda_words(text: Column) -> Column:
    """Lower-case runs of letters of the lengths that topics are made of."""
    # Runs of other lengths match without the group and come as empty texts.
    found = F.regexp_extract_all(F.lower(text), F.lit(K.LDA_TOKEN_PATTERN), F.lit(1))
    return F.array_remove(found, "")


def lda_tokens(posts: DataFrame, stopwords: Sequence[str] = (), column: str = "cleaned_text"
               ) -> DataFrame:
    """The words of every post that has any, as ``tokens``."""
    tokens = posts.select(lda_words(F.col(column)).alias("tokens"))
    if stopwords:
        tokens = tokens.select(F.filter("tokens", lambda w: ~w.isin(*stopwords)).alias("tokens"))
    return tokens.filter(F.size("tokens") > 0)


def word_numbers(tokens: DataFrame) -> DataFrame:
    """All words of ``tokens`` in the order of their names, numbered from 0: ``word``, ``term``.

    Words are sorted by ranges; a word's number is its place in its range and the number of
    words in the ranges before.
    """
    sorted_ = _stored(tokens.select(F.explode("tokens").alias("word")).distinct().orderBy("word").select(
        "word", F.spark_partition_id().alias("range"),
        F.monotonically_increasing_id().alias("place")), "lda-words")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range.
    ranges = sorted_.groupBy("range").agg(F.count("*").alias("n"), F.min("place").alias("first")).select(
        "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return _stored(sorted_.join(ranges, "range").select("word", (
        F.col("before") + F.col("place") - F.col("first")).cast("int").alias("term")), "lda-numbers")


def topic_coherence(
    described: DataFrame, posts: DataFrame, by: str = "topic_id", column: str = "cleaned_text"
) -> DataFrame:
    """How well the words of topics go together: ``by``, ``n_pairs``, ``coherence``.

    Coherence is the mean over all pairs of a topic's words of their normalised pointwise
    mutual information in the posts: 1 for words that only come together, 0 for independent
    ones, -1 for words that never meet or are in no post. A topic of one word has none.

    Topics have a few words each, which become part of the expression that finds them in the
    row, so no post is shuffled and only pairs of these words are counted.
    """
    wanted = described.select(by, "word").dropna().distinct()
    words = sorted({row["word"] for row in wanted.select("word").distinct().collect()})
    tokens = lda_tokens(posts, column=column)
    total = posts.agg(F.count("*")).scalar().cast("double")
    present = tokens.select(F.sort_array(F.array_intersect(
        F.array_distinct("tokens"), listed(words, "string"))).alias("words")) if words else tokens.select(
        F.col("tokens").alias("words")).filter(F.lit(False))
    pairs = F.flatten(F.transform("words", lambda a, i: F.transform(
        F.slice("words", i + 1, F.size("words")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = present.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))
    alone = met.filter(F.col("a") == F.col("b")).select(F.col("a").alias("word"), "n")
    every = wanted.select(by, F.col("word").alias("a")).join(
        wanted.select(by, F.col("word").alias("b")), by).filter(F.col("a") < F.col("b"))
    counted = every.join(met, ["a", "b"], "left")
    for side in ("a", "b"):
        counted = counted.join(alone.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")),
                               side, "left")
    share = F.col("n") / F.col("total")
    measure = F.when(F.col("n").isNull(), -1.0).when(F.col("n") == F.col("total"), 1.0).otherwise(
        F.ln(share * F.col("total") * F.col("total") / (F.col("n_a") * F.col("n_b"))) / -F.ln(share))
    return counted.withColumn("total", total).groupBy(by).agg(
        F.count("*").alias("n_pairs"), F.round(F.avg(measure), 6).alias("coherence"))


def topic_facts(described: DataFrame, posts: DataFrame, column: str = "cleaned_text") -> DataFrame:
    """What holds for the words of topics in any model: by ``topic_id`` and ``rank``, whether
    the word occurs in the texts, occurs once in its topic, has a weight in (0, 1], and
    none larger than that of the rank before."""
    known = lda_tokens(posts, column=column).select(F.explode("tokens").alias("word")).join(
        described.select("word").distinct(), "word", "left_semi").distinct().withColumn(
        "occurs", F.lit(True))
    ranked = Window.partitionBy("topic_id").orderBy("rank")
    return described.join(known, "word", "left").select(
        "topic_id", "rank", F.coalesce("occurs", F.lit(False)).alias("occurs"),
        (F.count("*").over(Window.partitionBy("topic_id", "word")) == 1).alias("is_distinct"),
        ((F.col("weight") > 0) & (F.col("weight") <= 1)).alias("weight_in_range"),
        F.coalesce(F.col("weight") <= F.lag("weight").over(ranked), F.lit(True)).alias("falling"))


def _stored(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
