"""Merkle manifests against trees built in plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from postpulse.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and for each leaf its siblings before and after, level by level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(places):
            start = at // 8 * 8
            run = level[start:start + 8]
            paths[i].append(("".join(run[:at - start]), "".join(run[at - start + 1:])))
            places[i] = at // 8
        level = [digest(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_leaf(row) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], plain_leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for group in order:
        groups[group].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[group] = plain_tree([leaf for _, leaf in groups[group]])
    root, over = plain_tree([trees[g][0] for g in order]) if order else ("", [])
    return [(group, key, leaf, trees[group][0], root, path + above)
            for group, above in zip(order, over, strict=True)
            for (key, leaf), path in zip(groups[group], trees[group][1], strict=True)]


def same(spark, rows, levels):
    docs = spark.createDataFrame(
        [(*row, "x", "y", 1) for row in rows], "doc_id long, source string, lang string, "
        "n_chars long, text string, node string, number string, path int")
    found = merkle.manifest(docs, FIELDS, "lang", ["doc_id"], levels=levels)
    got = sorted(((r["lang"], r["doc_id"], r["leaf"], r["subroot"], r["root"],
                   [tuple(step) for step in r["path"]]) for r in found.collect()), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)
    folded = found.select((merkle.folded(found["leaf"], found["path"]) == found["root"]).alias("ok"))
    assert all(row["ok"] for row in folded.collect())


def documents(sizes):
    """Groups of these sizes, with gaps and any order of keys."""
    return [(997 * i % 7919, f"s{i % 3}", lang, i, f"Text {i} ÀB" if i % 5 else None)
            for lang, size in sizes.items() for i in range(size)]


@pytest.mark.parametrize("levels", (1, 2, 4))
def test_groups_of_all_sizes(spark, levels):
    # one, full runs, runs of one, and several tiers of blocks where they are low
    same(spark, documents({None: 1, "": 8, "de": 9, "en": 65, "é": 64, "z": 73, "fr": 130}), levels)


def test_many_groups_need_levels_above_them(spark):
    same(spark, documents({f"g{i}": 1 + i % 3 for i in range(70)}), 1)


def test_nulls_ties_repeats_and_long_texts(spark):
    row = (1, None, "en", None, "a" * 300_000)
    rows = [row] * 20 + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, ""),
            (1, "s", "en", 2, "tie"), (1, "s", "en", 2, "other tie"), (-5, "", "", 0, "")]
    same(spark, rows, 1)


def test_no_rows(spark):
    same(spark, [], 4)


def test_a_changed_field_shows(spark):
    rows = documents({"en": 20})
    docs = spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, FIELDS, "lang", ["doc_id"],
                            {"text": merkle.ascii_lower(docs["text"])})
    for row in found.withColumn("end", merkle.folded(found["tampered"], found["path"])).collect():
        assert (row["end"] == row["root"]) == (row["tampered"] == row["leaf"])


def test_fields_cannot_be_shifted(spark):
    pairs = spark.createDataFrame([("1", "2:ab"), ("12", ":ab"), (None, "-"), ("-", None)],
                                  "a string, b string")
    leaves = [row[0] for row in pairs.select(merkle.leaf([pairs["a"], pairs["b"]])).collect()]
    assert len(set(leaves)) == 4


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    name = "op12_merkle_manifest"
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    assert difference(mine, connect(sf_dir).execute(entry.oracle_sql()[name]).df()) is None
