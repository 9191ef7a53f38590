"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postpulse.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(numbers: dict[str, int]):
    near = {w: [v for v in numbers if one_edit(w, v)] for w in numbers}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-numbers[v], v), default=None)
        if best is not None and numbers[best] >= 5 * numbers[word]:
            form[word] = best
    rows = []
    for word, n in numbers.items():
        root = word
        while root in form:
            root = form[root]
        last = form.get(word)
        rows.append((word, n, len(near[word]), last, numbers.get(last), root))
    return sorted(rows, key=repr)


def grouped(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "word string, n long, root string, first int")
    found = spelling.variant_groups(frame, **settings)
    return sorted(map(tuple, found.select(
        "word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdé😀"), min_size=1, max_size=9), st.integers(2, 5))
def test_neighbourhood_is_full_and_without_repeats(word, symbols):
    code = spelling.symbols_of(np.array([ord(c) for c in word], np.uint32), symbols).tolist()
    every = {tuple(code)}
    for i in range(len(code) + 1):
        every |= {(*code[:i], s, *code[i:]) for s in range(symbols)}
        if i < len(code):
            every |= {(*code[:i], s, *code[i + 1:]) for s in range(symbols)}
            every.add((*code[:i], *code[i + 1:]))
    powers = [pow(spelling._BASE, i, 1 << 64) for i in range(len(code) + 2)]
    names = sorted(sum(int(spelling._VALUES[s]) * powers[i] for i, s in enumerate(c)) % (1 << 64)
                   for c in every)
    found = np.concatenate([keys for _, keys in spelling.neighbourhoods([word], symbols)])
    assert sorted(found.tolist()) == names
    assert spelling.reduced_names([word], symbols)[0] in names


@pytest.mark.parametrize("symbols", (2, 8))
def test_groups_equal_brute_force(spark, symbols):
    draw = random.Random(5)
    words = {"".join(draw.choice("abcé") for _ in range(draw.randint(1, 6))) for _ in range(700)}
    numbers = {word: 5 ** draw.randint(0, 5) + draw.randint(0, 2) for word in sorted(words)}
    got = grouped(spark, [(w, n, "x", 1) for w, n in numbers.items()], symbols=symbols)
    assert got == brute(numbers)
    assert any(row[3] and row[5] != row[3] for row in got)  # chains of several forms


def test_long_chain(spark):
    chain = {"a" * (20 - i): 5 ** i for i in range(15)}
    got = grouped(spark, [(w, n, None, None) for w, n in chain.items()])
    assert got == brute(chain) and {row[5] for row in got} == {"a" * 6}


def test_rows_of_every_kind(spark):
    long = "xyz" * 4_000
    rows = [(None, 5, "x", 1), ("nul", None, "x", 1), ("", 7, "x", 1), ("a", 50, "x", 1),
            ("twice", 2, "x", 1), ("twice", 3, "x", 1), ("twyce", 25, "x", 1),
            (long, 5, "x", 1), (long + "a", 1, "x", 1), ("ties", 1, "x", 1), ("tiea", 9, "x", 1),
            ("tieb", 9, "x", 1)]
    numbers = Counter()
    for word, n, *_ in rows:
        if word is not None and n is not None:
            numbers[word] += n
    assert grouped(spark, rows) == brute(dict(numbers))
    assert grouped(spark, []) == []


def test_words_and_losses(spark):
    texts = [None, "", "Été d'ÉTÉ x×÷y ABC_def 12", "Zz" * 50_000, "one two " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.select("doc_id", F.explode(spelling.runs(docs["text"])).alias("run")).select(
        "doc_id", "run", spelling.with_losses(F.col("doc_id"), F.col("run"), 3).alias("word"))
    want = []
    for key, text in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            at = h % len(run)
            want.append((key, run, run[:at] + run[at + 1:] if h % 3 == 0 else run))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    name = "op13_spelling_variants"
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    assert difference(mine, connect(sf_dir).execute(entry.oracle_sql()[name]).df()) is None
    assert mine["form"].notna().any()
