"""N-gram join, tiling and compact windows against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postpulse.llm import components, ngram_join, passages, tiling

VOCABULARY = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "io", "ué")]


def prose(chance, n):
    return " ".join(chance.choice(VOCABULARY) for _ in range(n))


def changed(chance, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[chance.randrange(len(words))] = chance.choice(VOCABULARY).upper()
    return " ".join(words)


def shout(text):
    return re.sub("[a-z]", lambda m: m[0].upper(), text)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def rows_of_documents():
    chance = random.Random(3)
    base = [prose(chance, chance.randrange(1, 200)) for _ in range(25)]
    hot, line = prose(chance, 120), prose(chance, 60)
    texts = base + base[:8]
    texts += [changed(chance, chance.choice(base), chance.randrange(0, 9)) for _ in range(40)]
    # A large group of near copies, at both sides of the threshold, and a common passage.
    texts += [changed(chance, hot, chance.randrange(1, 5)) for _ in range(60)]
    texts += [f"{prose(chance, 40)} {line} {prose(chance, 40)}" for _ in range(20)]
    texts += ["", None, " \t\n", "one", "ONE", "two words", "Two Words", "a" * 50_000]
    return [(i, text, "x", i) for i, text in enumerate(texts)]


@pytest.fixture(scope="module")
def documents(spark, rows_of_documents):
    # A clashing column name, and a row that comes twice.
    rows = [*rows_of_documents, rows_of_documents[3], (None, "no key here at all", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n long").repartition(5)


def shingles(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def plain_components(rows):
    sets = {i: shingles(text) for i, text, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [64, 1])
def test_ngram_join_finds_all_components(documents, rows_of_documents, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    found = ngram_join.jaccard_components(documents).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert got == plain_components(rows_of_documents)
    assert len(found) == len(rows_of_documents) + 2
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_sketches_tell_long_sets_apart_and_let_similar_ones_pass(spark):
    """Also where the sketch of one set is twice as long as that of the other."""
    draw = np.random.default_rng(3)
    cases = []
    for n, m, shared in ((6000, 6000, 60), (1000, 1100, 30), (1000, 1100, 940), (1020, 1030, 930),
                         (6000, 6400, 5600), (9, 9, 8), (2040, 2500, 2040)):
        values = draw.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        cases.append((n, m, shared, [values[:n], values[n - shared:]]))
    sets = [np.unique(x) for *_, pair in cases for x in pair]
    lists = ngram_join._sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).to_pylist()
    frame = spark.createDataFrame(
        [(i, n, m, *lists[2 * i:2 * i + 2]) for i, (n, m, *_) in enumerate(cases)],
        "i int, n long, m long, u array<long>, v array<long>")
    passed = {r["i"] for r in frame.filter(ngram_join._similar_sketches(80)).collect()}
    swapped = frame.select("i", F.col("m").alias("n"), F.col("n").alias("m"),
                           F.col("v").alias("u"), F.col("u").alias("v"))
    assert passed == {r["i"] for r in swapped.filter(ngram_join._similar_sketches(80)).collect()}
    assert passed == {i for i, (n, m, shared, _) in enumerate(cases) if 100 * shared >= 80 * (n + m - shared)}


def test_near_copies_are_not_all_compared(spark, monkeypatch):
    """Forty near copies of a text meet in all their pairs, of which a few connect them."""
    chance = random.Random(8)
    base = prose(chance, 300)
    frame = spark.createDataFrame(
        [(i, changed(chance, base, 1)) for i in range(40)], "doc_id long, text string")
    compared, plain = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *rest: (
        compared.append(pairs.count()), plain(pairs, *rest))[1])
    found = ngram_join.jaccard_components(frame).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(compared) < 200


def test_one_document_of_each_component_stays(documents, rows_of_documents):
    kept = ngram_join.representatives(documents)
    assert kept.columns == documents.columns
    expected = {c for _, c in plain_components(rows_of_documents).values()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert ids.count(None) == 1


def test_components_without_a_key_of_their_own_keep_a_document(spark):
    chance = random.Random(21)
    texts = [prose(chance, 60) for _ in range(12)]
    rows = [(None, text) for text in texts[:5]] + [(7, text) for text in texts[5:9]]
    rows += [(None, texts[0]), (None, changed(chance, texts[1], 1)), (7, texts[5]), (3, texts[9]),
             (None, texts[9]), (4, texts[10]), (7, texts[10]), (None, ""), (None, None), (7, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.representatives(frame).collect()]
    near = {rows[1], rows[10]}
    assert len(near & set(kept)) == 1
    expected = [*rows[:1], *rows[2:9], (3, texts[9]), (4, texts[10]), *rows[-3:]]
    assert sorted(map(repr, kept)) == sorted(map(repr, [*expected, *(near & set(kept))]))


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f g", "k", 5, 6), (2, "a b c d e f g", "l", 7, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __key string, __row int, __Row_Hash int")
    kept = ngram_join.representatives(frame)
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [rows[0]]


def test_empty_tables(spark, documents):
    nothing = documents.limit(0)
    assert ngram_join.jaccard_components(nothing).count() == 0
    assert passages.repeated_passages(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert tiling.contaminated(documents, items).count() == 0
    assert tiling.contaminated(nothing, items).count() == 0


def test_connected_components(spark):
    chance = random.Random(5)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {n: n for edge in edges for n in edge}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
    for a, b in edges:
        assert found.get(a, a) == root[a] and found.get(b, b) == root[b]


# --- tiling -------------------------------------------------------------------
def plain_tiles(item, doc, least):
    """Greedy string tiling by comparing everything with everything."""
    used_item, used_doc, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and i + n not in used_item and j + n not in used_doc):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        used_item.update(range(i, i + n))
        used_doc.update(range(j, j + n))
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_those_of_the_plain_search(seed):
    chance = random.Random(seed)
    item = [chance.randrange(6) for _ in range(chance.randrange(5, 40))]
    doc = [chance.randrange(6) for _ in range(60)]
    doc[10:10] = item[len(item) // 2:]
    doc[40:40] = item[:len(item) // 2]
    got = tiling.greedy_tiles(item, doc, 4)
    expected = plain_tiles(item, doc, 4)
    assert sorted(n for *_, n in got)[::-1][:1] == sorted(n for *_, n in expected)[::-1][:1]
    for i, j, n in got:
        assert item[i:i + n] == doc[j:j + n] and n >= 4
    for side in (0, 1):
        places = [p for t in got for p in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))


def test_contaminated_documents(spark):
    chance = random.Random(9)
    items = [(i, prose(chance, 30)) for i in range(20)] + [(98, None), (99, "too short")]
    parts = items[2][1].split(" ")
    reordered = " ".join(parts[20:] + ["xx"] + parts[:10] + ["yy"] + parts[10:20])
    docs = [
        (1, prose(chance, 100), 1), (2, f"{prose(chance, 20)}, {shout(items[0][1])}! x", 1),
        (3, reordered, 1), (4, None, 1), (5, "", 1), (6, " ".join(parts[:12]), 1),
        (None, items[3][1], 1), (7, items[4][1], 1), (7, items[4][1], 1), (7, "another text", 1),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in tiling.contaminated(frame, bench).collect()}
    assert set(found) == {(2, 0), (3, 2), (None, 3), (7, 4)}
    assert found[3, 2]["n_tiles"] == 3 and found[3, 2]["coverage"] == 1.0
    assert found[2, 0]["spans"] == [(20, 30)]
    clean = tiling.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r["doc_id"]) + (r["text"] or "")[:3] for r in clean.collect()) == sorted(
        str(i) + (t or "")[:3] for i, t, _ in docs if (i, t) in {
            (1, docs[0][1]), (4, None), (5, ""), (6, docs[5][1]), (7, "another text")})


# --- compact windows ----------------------------------------------------------
def test_windows_are_those_of_the_cartesian_tree():
    import numpy as np

    chance = random.Random(1)
    for _ in range(60):
        texts = [[chance.randrange(1, 30) for _ in range(chance.randrange(1, 40))] for _ in range(3)]
        least = chance.randrange(2, 8)
        flat, ends = [], []
        for text in texts:
            flat += [*text, 0]
            ends.append(len(flat) - 1)
        got = set(zip(*(x.tolist() for x in passages.compact_windows(
            np.array(flat, np.uint64), np.array(ends), least))))
        expected, start = set(), 0
        for end in ends:
            for i in range(start, end):
                for j in range(i + least - 1, end):
                    low = min(range(i, j + 1), key=lambda p: (flat[p], p))
                    expected.add((i, low, j))
            start = end + 1
        # Every run lies in exactly one window, which has the same smallest place.
        for i, low, j in expected:
            assert sum(a <= i <= c <= j <= b for a, c, b in got) == 1
            assert any(a <= i and c == low and j <= b for a, c, b in got)


def test_every_repeated_passage_is_found(spark):
    chance = random.Random(11)
    shared = [prose(chance, n) for n in (50, 51, 70, 300)]
    texts = [prose(chance, 200) for _ in range(10)]
    texts += [f"{prose(chance, 30)} {s}\n{prose(chance, 30)}" for s in shared for _ in range(2)]
    texts += [f"{prose(chance, 5)} {shout(shared[2])} {prose(chance, 50)}" for _ in range(30)]
    texts += [changed(chance, shared[3], 6), texts[0], "short copy", "short copy", "", None]
    docs = [(i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, code string").repartition(4)
    holders = defaultdict(set)
    for i, text, _ in docs:
        w = words_of(text)
        for j in range(len(w) - 49):
            holders[tuple(w[j:j + 50])].add(i)
    expected = {i for ids in holders.values() if len(ids) > 1 for i in ids} - {10 + 8 + 30 + 1}
    found = passages.repeated_passages(frame).collect()
    whole = {i for ids in holders.values() if len(ids) > 1 for i in ids}
    assert expected <= {r["doc_id"] for r in found} | {r["other_doc_id"] for r in found}
    assert {r["doc_id"] for r in found} <= whole | {10 + 8 + 30}
    for r in found:
        assert r["n_words"] >= 50 and r["jaccard"] >= 0.8
        if r["jaccard"] == 1.0:
            a = words_of(texts[r["doc_id"]])[r["start"]:r["start"] + r["n_words"]]
            b = words_of(texts[r["other_doc_id"]])
            assert a == b[r["other_start"]:r["other_start"] + r["other_words"]]


def test_a_second_passage_of_two_texts_is_found(spark):
    # Two texts share two passages; a third one holds a part of the second, too short for
    # a passage, and in some of the cases has the smallest hash.
    chance = random.Random(17)
    docs, second = [], {}
    for case in range(0, 240, 3):
        first, other = prose(chance, 50), prose(chance, 50)
        part = " ".join(other.split(" ")[4:46])
        for i in (case, case + 1):
            start = 40 + i % 7
            docs.append((i, f"{prose(chance, start)} {first} {prose(chance, 90)} {other} "
                            f"{prose(chance, 40)}"))
            second[i] = start + 50 + 90
        docs.append((case + 2, f"{prose(chance, 60)} {part} {prose(chance, 60)}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = passages.repeated_passages(frame).collect()
    hit = {r["doc_id"] for r in found
           if r["doc_id"] in second and r["start"] <= second[r["doc_id"]] + 2
           and r["start"] + r["n_words"] >= second[r["doc_id"]] + 48}
    assert hit == set(second)


def edited(chance, text, places):
    words = text.split(" ")
    for place in places:
        words[place] = f"x{chance.randrange(10 ** 6)}"
    return " ".join(words)


def test_near_passages_are_found(spark):
    # One edit in 50 words: 41 of 51 shingles agree.
    chance = random.Random(23)
    docs, planted = [], {}
    for case in range(0, 400, 2):
        passage, at = prose(chance, 50), 30 + case % 20
        near = edited(chance, passage, [4 + case % 42])
        a, b = shingles(passage), shingles(near)
        assert 100 * len(a & b) >= 80 * len(a | b)
        for i, text in ((case, passage), (case + 1, near)):
            docs.append((i, f"{prose(chance, at)} {text} {prose(chance, 40)}"))
            planted[i] = case
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = passages.repeated_passages(frame).collect()
    assert {r["doc_id"] // 2 for r in found} == {case // 2 for case in planted.values()}
    assert all(r["doc_id"] // 2 == r["other_doc_id"] // 2 and r["jaccard"] >= 0.8 for r in found)


def test_near_passages_in_another_order_are_aligned():
    import numpy as np

    one, two = list(range(1000, 1100)), list(range(2000, 2100))
    near = [[v if i % 25 > 2 else v + 50_000 for i, v in enumerate(part)] for part in (one, two)]
    x, y = np.array(one + two), np.array([*near[1], *range(9000, 9100), *near[0]])
    found = passages.aligned(x, y, 50, 80)
    covered = {i for start, n, *_ in found for i in range(start, start + n - 4)}
    assert len(found) >= 2 and len(covered & set(range(100))) > 80
    assert len(covered & set(range(100, 200))) > 80


def test_only_shared_windows_become_cells(spark):
    """Before cells are made, windows tell what texts may share: few rows for a text."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400)) for _ in range(40)]
    part = texts[0].split()[100:180]
    texts[1] = " ".join(texts[1].split()[:50] + part + texts[1].split()[50:])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    named = frame.select(F.col("doc_id").alias("key"), "text", F.xxhash64("text").alias("code"))
    lows = passages._window_lows(named, 50)
    assert lows.count() < 40 * 400 // 2
    places = passages._several(lows).select(
        F.shiftrightunsigned("signature", 64 - passages.WINDOW_BITS).alias("place"))
    kept = passages._kept_cells(named, passages._marks(places, passages.WINDOW_BITS), 50)
    codes = {r["code"] for r in kept.select("code").distinct().collect()}
    assert codes == {r["code"] for r in named.filter("key < 2").select("code").collect()}
    found = {(r["doc_id"], r["start"], r["n_words"]) for r in passages.repeated_passages(frame).collect()}
    assert found == {(0, 100, 80), (1, 50, 80)}


def test_columns_of_several_sets_are_marked_in_few_bytes(spark):
    """Shared columns are all marked, others nearly never, in whichever task the sets are."""
    rng = np.random.default_rng(3)
    columns = [rng.integers(-2 ** 63, 2 ** 63, 200).tolist() for _ in range(60)]
    shared = [columns[i][0] for i in range(0, 60, 2)]
    for i in range(0, 60, 2):
        columns[i + 1][1] = columns[i][0]
    rows = [(bytes([i]) * 16, values) for i, values in enumerate(columns)]
    frame = spark.createDataFrame(rows, "node binary, columns array<long>").repartition(5)
    marks = ngram_join._shared_marks(frame)

    def marked(values):
        place = np.array(values, np.int64).view(np.uint64) >> np.uint64(64 - ngram_join.SHARED_BITS)
        return ngram_join._marked(marks, place.astype(np.int64))

    assert marked(shared).all()
    assert marked([v for values in columns for v in values]).sum() <= 2 * len(shared) + 2
    copies = spark.createDataFrame([rows[0], rows[0]], frame.schema).coalesce(1)
    assert not ngram_join._shared_marks(copies).any()
