"""Archives, tool calls and the pipeline."""

from __future__ import annotations

import gzip
import io
import json
import zlib

import pytest

import corpus_pipeline
from postpulse.llm import catalog, ngram_join, tool_calls, warc
from postpulse.llm.storage import stored
from postpulse.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def page(i, payload):
    return warc.response_record(str(i), f"http://x/{i} y", payload, warc.digest_of(payload))


def test_normaliser_round_trip():
    payloads = [b"", b"same", b"other\r\n\r\nWARC/1.1\r\n", b"same", bytes(range(256)) * 9000]
    records = [page(i, p) for i, p in enumerate(payloads)]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        out = io.BytesIO()
        index = warc.normalise_stream(io.BytesIO(packed), out, {1: "3"})
        data = out.getvalue()
        assert [e.offset for e in index] == [0, *[e.offset + e.length for e in index[:-1]]]
        assert index[-1].offset + index[-1].length == len(data)
        for i, entry in enumerate(index):
            member = zlib.decompress(data[entry.offset:entry.offset + entry.length], 31)
            if i != 1:
                assert member == records[i] and entry.record_type == "response"
        parsed = warc._parsed(data[index[1].offset:index[1].offset + index[1].length])
        assert parsed == ("1", 4, warc.digest_of(b"same"), "revisit", "3")
        # A normalised archive can be normalised again.
        again = io.BytesIO()
        warc.normalise_stream(io.BytesIO(data), again)
        assert gzip.decompress(again.getvalue()) == gzip.decompress(data)


def test_a_broken_archive_is_an_error():
    whole = gzip.compress(page(1, b"payload" * 1000))
    with pytest.raises(ValueError, match="inside a (record|gzip member)"):
        warc.normalise_stream(io.BytesIO(whole[:-40]), io.BytesIO())


def test_an_archive_cut_between_records_is_an_error():
    """The text ends with a whole record, but the gzip member does not end."""
    records = [page(i, b"payload %d" % i * 1000) for i in range(3)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    cut = packer.compress(b"".join(records)) + packer.flush(zlib.Z_SYNC_FLUSH)
    for data in (cut, gzip.compress(records[0]) + cut):
        with pytest.raises(ValueError, match="inside a gzip member"):
            warc.normalise_stream(io.BytesIO(data), io.BytesIO())
    assert warc.normalise_stream(io.BytesIO(b""), io.BytesIO()) == []


def test_pages_of_any_name(spark):
    names = ["none", "null", "id:x", "", "a b", "é%20\r\nX: y", None]
    rows = [(name, "u", f"text {i // 2}") for i, name in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = warc.archived(pages, scratch_path(spark, "warc")).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    want = []
    for i, name in enumerate(names):
        pair = names[i // 2 * 2:i // 2 * 2 + 2]
        last = max(pair, key=lambda n: (n is not None, (n or "").encode()))
        want.append((name, "response", None) if name == last else (name, "revisit", last))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("roll", [warc.ROLL_BYTES, 2000])
def test_pages_come_back(spark, roll):
    html = ["<p>é</p>", None, "", "dup", "dup", "dup", "x" * 100_000]
    rows = [(i, f"http://h/{i}", h, "x") for i, h in enumerate(html)]
    rows += [rows[6], (None, None, "dup", "x"), (None, "u\nu", "alone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    found = warc.archived(pages.repartition(3), scratch_path(spark, "warc"), roll=roll).collect()
    assert len(found) == len(rows)
    by_page = {r["page_id"]: r for r in found if r["page_id"] in range(6)}
    for i, h in enumerate(html[:6]):
        payload = (h or "").encode()
        last = {"dup": 5, "": 2, None: 2}.get(h, i)
        r = by_page[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.digest_of(payload))
        assert (r["record_type"], r["refers_to"]) == (
            ("response", None) if last == i else ("revisit", last))
    twice = sorted((r["record_type"], r["refers_to"]) for r in found if r["page_id"] == 6)
    assert twice == [("response", None), ("revisit", 6)]
    assert sorted((r["record_type"], r["refers_to"]) for r in found if r["page_id"] is None) == [
        ("response", None), ("revisit", 5)]
    assert warc.archived(pages.limit(0), scratch_path(spark, "warc")).count() == 0


# --- tool calls ---------------------------------------------------------------
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "stop": {}}


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def one(i, name="add", arguments=None, after=()):
    return {"id": i, "name": name, "arguments": {"a": 1} if arguments is None else arguments,
            "after": list(after)}


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


MESSAGES = [
    (1, 0, "user", "hello", "x"),
    (1, 1, "assistant", call(one("c", arguments={"b": 2.5, "a": 3}, after=["b"]), one("b", after=["a"]),
                             one("a")), "x"),
    (1, 2, "tool", result("a", "é \"q\"\n"), "x"), (1, 3, "tool", result("b"), "x"),
    (1, 4, "tool", result("b", "later"), "x"),
    (2, 0, "tool", result("z"), "x"), (2, 1, "assistant", call(one("z", after=["nowhere"])), "x"),
    (2, 2, "assistant", call(one("p", after=["q"]), one("q", after=["p"]), one("r", after=["q"])), "x"),
    (3, 0, "assistant", call(one("a", "add", {"a": "no", "extra": 1}), one(None, "stop", {}),
                             one("m", "add", {}), one("u", "who"), one("n", None)), "x"),
    (3, 1, "assistant", None, "x"), (3, 2, "assistant", "no JSON", "x"), (3, 3, None, "{}", "x"),
    (None, 0, "assistant", call(one("a")), "x"), (None, 1, "tool", result("a"), "x"),
    (4, None, "assistant", call(one("a"), one("a")), "x"),
]


@pytest.fixture(scope="module")
def linked(spark):
    frame = spark.createDataFrame(
        MESSAGES, "conv_id long, turn long, role string, text string, level string")
    rows = tool_calls.link_tool_calls(frame.repartition(3), SCHEMAS).collect()
    return rows, {(r["conv_id"], r["call_id"]): r for r in rows}


def test_calls_are_linked_and_ordered(linked):
    rows, by_call = linked
    assert len(rows) == 3 + 1 + 3 + 5 + 1 + 2
    assert [by_call[1, c]["level"] for c in "abc"] == [0, 1, 2]
    assert [by_call[1, c]["n_results"] for c in "abc"] == [1, 2, 0]
    assert by_call[1, "a"]["result_turn"] == 2 and by_call[1, "a"]["valid"]
    assert by_call[1, "b"]["errors"] == "several results"
    assert by_call[2, "z"]["errors"] == "needs an unknown call; result before call"
    assert [by_call[2, c]["level"] for c in "pqr"] == [None] * 3
    assert by_call[2, "r"]["errors"] == "needs itself"
    assert by_call[None, "a"]["n_results"] == 1 and by_call[4, "a"]["level"] == 0


def test_arguments_are_checked(linked):
    _, by_call = linked
    assert by_call[3, "a"]["errors"] == "a: no integer; extra: unknown"
    assert by_call[3, None]["errors"] == "no identifier"
    assert by_call[3, "m"]["errors"] == "a: missing"
    assert by_call[3, "u"]["errors"] == "unknown tool"
    assert not by_call[3, "n"]["valid"]


def test_messages_are_canonical(linked):
    _, by_call = linked
    assert by_call[1, "c"]["message"] == (
        '{"arguments":{"a":3,"b":2.5},"id":"c","name":"add","result":null}')
    plain = {"arguments": {"a": 1}, "id": "a", "name": "add", "result": "é \"q\"\n"}
    assert by_call[1, "a"]["message"] == json.dumps(
        plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_no_messages(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link_tool_calls(nothing, SCHEMAS).count() == 0
    assert tool_calls.link_tool_calls(
        tool_calls.as_tool_messages(nothing), tool_calls.CHAT_TOOLS).count() == 0


# --- pipeline -----------------------------------------------------------------
def test_stages_take_effect(spark):
    docs = ngram_join.table(spark, SF_DIR, "documents")
    names, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF_DIR), "stage")
        assert kept.columns == names
        now = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert now <= ids and now
        assert name == "personal data" or now != ids or name == "decontamination"
        docs, ids = kept, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_clashing_columns_pass_through_the_stages(spark):
    docs = ngram_join.table(spark, SF_DIR, "documents").selectExpr(
        "*", "1 AS kept", "2 AS node", "3 AS base", "4 AS n", "5 AS m", "6 AS `odd name`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), SF_DIR).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14))
