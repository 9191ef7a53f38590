"""Personal data by weak supervision, in DataFrame expressions only.

Patterns find candidate spans. Six labelers vote on each (-1 no, 0 don't know, 1 yes):
the strict pattern, the shape, gazetteers of prefixes and domains, words in front that
name the kind, signs around that speak against it, and clean borders. Expectation
maximisation over the counts of all vote patterns estimates how reliable every labeler
is for every kind, and so how likely each pattern is. A logistic regression is trained
on these probabilities with features of the span; it decides on the spans beyond the
base rules. Spans of the base rules always stay.

Only counts of vote patterns reach the driver: there are at most ``3 ** 6`` for a kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.storage import fresh, stored, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base patterns, written so that the JVM neither recurses nor starts again inside a
# run of characters: a match starts where such a run starts or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole chain of digits with single spaces or hyphens, if it has 13 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Further candidates; those that touch a base span are dropped.
MORE = {
    "phone": r"(?<![0-9A-Za-z+.,-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])"
             r"[0-9]{3}[ .-][0-9]{4}(?![0-9])(?![ .,-][0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=@.-])(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9_/+=-]{16,}+"
              r"(?![A-Za-z0-9_/+=@-])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Fixed values of the labelers.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0+\.|127\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49)[^0-9]|^\+(?:1|33|34|44|49)",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|AIza|eyJ)",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|contacto|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|adresse|dirección)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|téléphone|teléfono|telefon)\b",
    "secret": r"(?i)\b(?:key|token|secret|password|passwd|api|bearer)\b",
}
AGAINST_BEFORE = r"(?i)(?:\bversion |\bv|[#$€£/=&?]|https?:\S*)$"
AGAINST_AFTER = r"^(?:%|°|[A-Za-z0-9])"
CLEAN_BEFORE = r"(?:^|[\s(\[<\"'«:;,])$"
CLEAN_AFTER = r"^(?:$|[\s)\]>\"'».,;:!?])"
LABELERS = 6
AROUND = 32
ROUNDS = 30
GATHERED = 256
THRESHOLD = 0.5


# --- candidates ---------------------------------------------------------------
def _gathered(items: Column, kind: str,
              step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A walk over an array: ``step`` gives the next place and a result of ``kind``, from the
    place so far and an item. Returns a struct of the last place and all results, ``out``.

    Appending to an array copies it, so results are gathered in short arrays, and these in one.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("few"),
        F.array().cast(f"array<array<{kind}>>").alias("full"))

    def append(state: Column, item: Column) -> Column:
        at, result = step(state["at"], item)
        is_full = F.size(state["few"]) >= GATHERED
        return F.struct(
            at.alias("at"),
            F.when(is_full, F.array(result)).otherwise(
                F.concat(state["few"], F.array(result))).alias("few"),
            F.when(is_full, F.concat(state["full"], F.array(state["few"]))).otherwise(
                state["full"]).alias("full"))

    return F.aggregate(items, start, append, lambda state: F.struct(
        state["at"].alias("at"),
        F.concat(F.flatten(state["full"]), state["few"]).alias("out")))


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places in code points.

    Matches and the texts between them come from the same left-to-right search, so the
    places are running sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    steps = F.zip_with(hits, gaps, lambda hit, gap: F.struct(
        hit.alias("value"), F.length(gap).cast("long").alias("gap")))
    def step(at: Column, item: Column) -> tuple[Column, Column]:
        begin = at + item["gap"]
        end = begin + F.length(item["value"])
        return end, F.struct(
            begin.alias("start"), end.alias("end"), item["value"].alias("value"))

    found = _gathered(steps, "struct<start:bigint,end:bigint,value:string>", step)["out"]
    placed = F.transform(found, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        m["value"].alias("value"),
        F.substring(text, F.greatest(m["start"] - AROUND, F.lit(0)).cast("int") + 1,
                    F.least(m["start"], F.lit(AROUND)).cast("int")).alias("before"),
        F.substring(text, m["end"].cast("int") + 1, F.lit(AROUND)).alias("after")))
    none = F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the check digit is right."""
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(
            F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.regexp_like(v, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda m: VALID[kind](m["value"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda m: m["kind"] == kind


def with_candidates(docs: DataFrame, text: str, base: str, more: str) -> DataFrame:
    """Add the spans of the base rules and further candidates as arrays of structs."""
    safe = F.coalesce(F.col(text), F.lit(""))
    rules = {}
    for kind in BASE_KINDS:
        rules[kind] = F.filter(_located(safe, BASE[kind], kind), _valid(kind))
    columns = [f"{base}_{kind}" for kind in BASE_KINDS]
    staged = docs.select("*", *[rules[k].alias(c) for k, c in zip(BASE_KINDS, columns)])
    staged = staged.withColumn(base, F.concat(*columns)).drop(*columns)
    loose = F.concat(*[_located(safe, pattern, kind) for kind, pattern in MORE.items()])
    free = staged.withColumn(more, loose)
    return free.withColumn(more, F.filter(more, lambda m: ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


# --- votes --------------------------------------------------------------------
def _by_kind(kind: Column, choices: dict[str, Column]) -> Column:
    result = F.lit(0)
    for name, value in choices.items():
        result = F.when(kind == name, value).otherwise(result)
    return result


def _vote(condition: Column, yes: int, no: int) -> Column:
    return F.when(condition, yes).otherwise(no)


def votes(span: Column, strict: Column) -> list[Column]:
    """What each labeler says about a span; ``strict`` tells whether it is a base span."""
    kind, value, before, after = (span[n] for n in ("kind", "value", "before", "after"))

    def matches(pattern: str, of: Column = value) -> Column:
        return F.regexp_like(of, F.lit(pattern))

    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    hexadecimal = matches(r"^(?=.*[0-9])(?:[0-9]*[a-fA-F]){3}[0-9a-fA-F]{16,}$")
    coded = matches("[0-9]") & matches("[A-Z]") & ~matches("[a-z]{6}")
    shape = _by_kind(kind, {
        "email": _vote(matches(r"\.[A-Za-z]{2,}$") & (F.length(value) <= 80), 1, -1),
        "ip": _vote(matches(r"[0-9]{2}"), 1, -1),
        "card": _vote(F.size(F.array_distinct(F.split(_digits(value), ""))) > 2, 1, -1),
        "phone": _vote(F.length(_digits(value)).between(9, 15), 1, -1),
        "secret": _vote(varied & (hexadecimal | coded), 1, -1),
    })
    gazetteer = _by_kind(kind, {
        "email": _vote(matches(GAZETTEER["email"]), 1, 0),
        "ip": _vote(matches(GAZETTEER["ip"]), 1, -1),
        "card": _vote(matches(GAZETTEER["card"]), 1, -1),
        "phone": _vote(matches(GAZETTEER["phone"]), 1, 0),
        "secret": _vote(matches(GAZETTEER["secret"]), 1, 0),
    })
    context = _by_kind(kind, {k: _vote(matches(p, before), 1, 0) for k, p in CONTEXT.items()})
    against = _vote(matches(AGAINST_BEFORE, before) | matches(AGAINST_AFTER, after), -1, 0)
    borders = _vote(matches(CLEAN_BEFORE, before) & matches(CLEAN_AFTER, after), 1, -1)
    return [_vote(strict, 1, 0), shape, gazetteer, context, against, borders]


def features(span: Column, strict: Column) -> Column:
    """Votes and coarse properties of a span: few distinct values, whatever the corpus."""
    cast = votes(span, strict)
    length = F.least(F.floor(F.length(span["value"]) / 8), F.lit(7)).cast("int")
    share = F.floor(4 * F.length(_digits(span["value"])) / F.length(span["value"])).cast("int")
    return F.struct(
        span["kind"].alias("kind"), *[v.alias(f"v{i}") for i, v in enumerate(cast)],
        length.alias("length"), share.alias("digits"))


# --- label model --------------------------------------------------------------
def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS
                ) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Estimate the share of true spans and, per labeler, the chance of each vote for a
    false and for a true span, from how often each vote pattern occurs.

    Starts from the majority of votes and adds one half to every count, so that rare
    votes keep a chance.
    """
    total = sum(n for _, n in patterns)
    truth = [1 / (1 + math.exp(-sum(votes_))) for votes_, _ in patterns]
    prior, chances = 0.5, []
    for _ in range(rounds):
        yes = sum(p * n for p, (_, n) in zip(truth, patterns))
        prior = (yes + 0.5) / (total + 1)
        chances = []
        for j in range(LABELERS):
            table_ = {}
            for vote in (-1, 0, 1):
                good = sum(p * n for p, (v, n) in zip(truth, patterns) if v[j] == vote)
                bad = sum((1 - p) * n for p, (v, n) in zip(truth, patterns) if v[j] == vote)
                table_[vote] = ((bad + 0.5) / (total - yes + 1.5), (good + 0.5) / (yes + 1.5))
            chances.append(table_)
        truth = []
        for votes_, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(chances[j][v][1] / chances[j][v][0]) for j, v in enumerate(votes_))
            truth.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, chances


def _posterior(f: Column, models: dict[str, tuple]) -> Column:
    odds = F.lit(-30.0)
    for kind, (prior, chances) in models.items():
        own = F.lit(math.log(prior / (1 - prior)))
        for j in range(LABELERS):
            gain = {v: math.log(good / bad) for v, (bad, good) in chances[j].items()}
            own = own + F.when(f[f"v{j}"] == 1, gain[1]).when(
                f[f"v{j}"] == -1, gain[-1]).otherwise(gain[0])
        odds = F.when(f["kind"] == kind, own).otherwise(odds)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


# --- classifier ---------------------------------------------------------------
def _inputs(f: Column) -> list[tuple[str, Column]]:
    flags = [(f"is_{kind}", f["kind"] == kind) for kind in KINDS]
    for j in range(LABELERS):
        flags += [(f"yes_{j}", f[f"v{j}"] == 1), (f"no_{j}", f[f"v{j}"] == -1)]
    scaled = [("length", f["length"] / 7), ("digits", f["digits"] / 4)]
    return [(name, flag.cast("double")) for name, flag in flags] + scaled


def train(spans: DataFrame) -> Callable[[Column], Column]:
    """Learn from spans (``span``, ``strict``) and return the scoring expression.

    Without any span the score is 0 for all.
    """
    counted = stored(
        spans.select(features(F.col("span"), F.col("strict")).alias("f")).groupBy("f").agg(
            F.count("*").alias("n")), "votes")
    names = [f"v{i}" for i in range(LABELERS)]
    rows = counted.groupBy("f.kind", *[f"f.{n}" for n in names]).agg(
        F.sum("n").alias("n")).orderBy("kind", *names).collect()
    if not rows:
        return lambda f: F.lit(0.0)
    models = {}
    for kind in KINDS:
        own = [(tuple(r[n] for n in names), r["n"]) for r in rows if r["kind"] == kind]
        if own:
            models[kind] = label_model(own)
    p = _posterior(F.col("f"), models)
    inputs = [name for name, _ in _inputs(F.col("f"))]
    labelled = counted.select(
        *[c.alias(name) for name, c in _inputs(F.col("f"))],
        F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), (p * F.col("n")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), ((1 - p) * F.col("n")).alias("weight")),
        )).alias("l")).select(*inputs, "l.label", "l.weight")
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(labelled)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50,
                                standardization=False).fit(vectors.coalesce(1))
    weights = [float(w) for w in fitted.coefficients]

    def score(f: Column) -> Column:
        terms = [F.lit(w) * c for w, (_, c) in zip(weights, _inputs(f))]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(float(fitted.intercept)))))

    return score


def _all_spans(base: str, more: str) -> Column:
    yes = F.transform(base, lambda m: F.struct(m.alias("span"), F.lit(True).alias("strict")))
    no = F.transform(more, lambda m: F.struct(m.alias("span"), F.lit(False).alias("strict")))
    return F.explode(F.concat(yes, no))


def accepted(more: str, score: Callable[[Column], Column]) -> Column:
    """The candidates beyond the base rules that the classifier takes for personal data."""
    return F.filter(more, lambda m: score(features(m, F.lit(False))) >= THRESHOLD)


# --- results ------------------------------------------------------------------
def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(
        ":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """By kind as listed, then by start."""
    return F.concat(*[
        F.array_sort(F.filter(spans, _of_kind(kind)),
                     lambda a, b: F.when(a["start"] < b["start"], -1).when(
                         a["start"] > b["start"], 1).otherwise(0))
        for kind in KINDS])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of base spans by kind, the digest of all base spans and
    all spans as ``kind:start:end`` in code points.

    Null and empty texts have none; repeated rows are treated alike; other columns are
    ignored. In an empty table nothing is trained.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = stored(with_candidates(source, "t", "base", "more").drop("t"), "candidates")
    score = train(found.select(_all_spans("base", "more").alias("s")).select("s.span", "s.strict"))
    taken = found.withColumn("taken", accepted("more", score))
    counts = [
        F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE_KINDS]
    return taken.select(
        F.col("k").alias(key), *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(_in_order(F.concat("base", "taken"))).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets.

    Documents without spans stay as they are. All columns are kept; their names may be
    any.
    """
    base, more = fresh(docs.columns, "__base", "__more")
    found = stored(with_candidates(docs, text, base, more), "candidates")
    score = train(found.select(_all_spans(base, more).alias("s")).select("s.span", "s.strict"))
    spans = F.array_sort(
        F.concat(F.col(base), accepted(more, score)),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(
            a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    whole = F.col(text)

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        gap = F.substring(whole, at.cast("int") + 1, (m["start"] - at).cast("int"))
        piece = F.concat(gap, F.lit("["), F.upper(m["kind"]), F.lit("]"))
        return F.greatest(at, m["end"]), F.when(m["start"] >= at, piece).otherwise("")

    # The walk is bound once, as the only element of an array.
    rebuilt = F.get(F.transform(F.array(_gathered(F.col(more), "string", step)), lambda state: F.concat(
        F.array_join(state["out"], ""),
        F.substring(whole, state["at"].cast("int") + 1, F.length(whole)))), 0)
    merged = found.withColumn(more, spans)
    return merged.select(*[
        F.when(F.size(more) > 0, rebuilt).otherwise(whole).alias(text) if name == text
        else F.col(f"`{name}`") for name in docs.columns])


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
