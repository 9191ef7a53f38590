"""WARC archives: write, normalise to one gzip member per record, index, read back.

Crawlers often leave archives that are one gzip stream from end to end, where no record
can be reached without inflating all before it. The normaliser inflates such a stream
once, piece by piece, writes every record as a member of its own and notes its place in
a sidecar index. On the way it turns records whose payload another one holds into
revisits. Which they are is decided by a join of digests, before, on a narrow table;
payloads never go through a shuffle.

Tasks write files of their own name into the shared folder and report them in a table;
only reported files are read, so a task that runs twice leaves no second copy.
"""

from __future__ import annotations

import base64
import csv
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.storage import stored, table
from postpulse.session import scratch_path

ROLL_BYTES = 256 << 20
PIECE = 1 << 20
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


# --- records ------------------------------------------------------------------
def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: object) -> str:
    """The name of a page in a record; a null has a name that no page has."""
    return "null" if page is None else f"id:{quote(str(page), safe='')}"


def _page_of(name: str) -> str | None:
    name = name.strip("<>").removeprefix(_PAGE)
    return None if name == "null" else unquote(name.removeprefix("id:"))


def _header(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = ["WARC/1.1"] + [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def response_record(page: str, url: str | None, payload: bytes, digest: str) -> bytes:
    """A response record whose block is an HTTP response with the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    address = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    header = _header([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{_PAGE}{page}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ], len(http) + len(payload))
    return b"".join((header, http, payload, b"\r\n\r\n"))


class Source:
    """Bytes of a gzip file of one or many members, inflated as they are read."""

    def __init__(self, stream):
        self.stream, self.inflater = stream, zlib.decompressobj(31)
        self.ready = bytearray()
        self.raw = b""
        self.open = False  # whether a member has begun and not ended

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                self.raw = self.inflater.unused_data
                self.inflater = zlib.decompressobj(31)
                self.open = False
            data = self.inflater.unconsumed_tail or self.raw or self.stream.read(PIECE)
            self.raw = b""
            self.open = self.open or bool(data)
            # Without further input, what the inflater still holds comes out.
            out = self.inflater.decompress(bytes(data), PIECE)
            if out:
                self.ready += out
                return True
            if not data:
                if self.open and not self.inflater.eof:
                    raise ValueError("archive ends inside a gzip member")
                return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        seen = 0
        while True:
            at = self.ready.find(mark, seen)
            if at >= 0:
                part = bytes(self.ready[:at + len(mark)])
                del self.ready[:at + len(mark)]
                return part
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                if self.ready:
                    raise ValueError("archive ends inside a record")
                return None

    def pieces(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.ready and not self._more():
                raise ValueError("archive ends inside a record")
            part = bytes(self.ready[:count])
            del self.ready[:len(part)]
            count -= len(part)
            yield part


def fields_of(header: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in header.decode().split("\r\n")[1:] if ":" in line)
    return {name.lower(): value.strip() for name, value in pairs}


# --- writing ------------------------------------------------------------------
def _own_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _open(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


class _Archive:
    """One monolithic gzip stream being written."""

    def __init__(self, uri: str):
        self.uri, self.size, self.count = uri, 0, 0
        system, path = _open(uri)
        self.out = system.open_output_stream(path, compression=None)
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)

    def add(self, record: bytes) -> int:
        self.out.write(self.packer.compress(record))
        self.size += len(record)
        self.count += 1
        return self.count - 1

    def close(self) -> None:
        self.out.write(self.packer.flush())
        self.out.close()


RECORDS = "archive string, ordinal long, page_id {}, payload_bytes long, payload_digest string"


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write every page as a response record into monolithic archives.

    Returns a row per record: ``archive``, ``ordinal`` there, ``page_id``,
    ``payload_bytes`` and ``payload_digest``. A null ``html`` is an empty payload.
    """
    _make_folder(folder)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive, parts = _own_name(), None, 0
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(c).to_pylist()
                                         for c in ("page_id", "url", "html"))):
                if archive is None:
                    archive = _Archive(f"{folder}/{name}-{parts}.warc.gz")
                    parts += 1
                payload = (html or "").encode()
                digest = digest_of(payload)
                at = archive.add(response_record(name_of(page), url, payload, digest))
                out.append((archive.uri, at, page, len(payload), digest))
                if archive.size >= roll:
                    archive.close()
                    archive = None
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), batch.schema.field("page_id").type, pa.int64(),
                     pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"])
        if archive is not None:
            archive.close()

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(rows, RECORDS.format(kind))


def _make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


# --- revisits -----------------------------------------------------------------
def revisits(records: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``archive``, ``ordinal`` and ``refers_to`` of the records that revisit another.

    Of equal payloads of at least ``least`` bytes, the record with the largest
    ``page_id`` is the response; of repeated pages one of them.
    """
    large = records.filter(F.col("payload_bytes") >= least)
    best = large.groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "archive", "ordinal")).alias("best"))
    return large.join(best, "payload_digest").filter(
        (F.col("archive") != F.col("best.archive")) | (F.col("ordinal") != F.col("best.ordinal"))
    ).select("archive", "ordinal", F.col("best.page_id").cast("string").alias("refers_to"))


# --- normalising --------------------------------------------------------------
class Entry(NamedTuple):
    """A line of the sidecar index."""

    offset: int
    length: int
    record_type: str
    record_id: str
    digest: str


class _Members:
    """Gzip members being written one after another, with their places."""

    def __init__(self, out):
        self.out, self.at, self.index = out, 0, []

    def add(self, pieces: Iterator[bytes], kind: str, record: str, digest: str) -> None:
        packer, start = zlib.compressobj(6, zlib.DEFLATED, 31), self.at
        for piece in pieces:
            self._write(packer.compress(piece))
        self._write(packer.flush())
        self.index.append(Entry(start, self.at - start, kind, record, digest))

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)


def _revisit(fields: dict[str, str], http: bytes, refers_to: str | None) -> bytes:
    target = None if refers_to is None else f"<{_PAGE}{name_of(refers_to)}>"
    header = _header([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", fields["warc-record-id"]),
        ("WARC-Date", fields["warc-date"]), ("WARC-Target-URI", fields.get("warc-target-uri")),
        ("WARC-Payload-Digest", fields.get("warc-payload-digest")), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", target), ("Content-Type", "application/http;msgtype=response"),
    ], len(http))
    return header + http + b"\r\n\r\n"


def normalise_stream(stream, out, turned: dict[int, str | None] | None = None) -> list[Entry]:
    """Rewrite a gzip WARC stream record by record; returns the index.

    ``turned`` maps the places of records to become revisits to what they refer to.
    The stream is inflated once and never held whole; neither is a record.
    """
    source, members, ordinal = Source(stream), _Members(out), 0
    turned = turned or {}
    while (header := source.until(b"\r\n\r\n")) is not None:
        fields = fields_of(header)
        length = int(fields["content-length"])
        record, digest = fields["warc-record-id"], fields.get("warc-payload-digest", "")
        if ordinal in turned:
            http = source.until(b"\r\n\r\n")
            for _ in source.pieces(length - len(http)):
                pass
            source.until(b"\r\n\r\n")
            whole = _revisit(fields, http, turned[ordinal])
            members.add(iter([whole]), "revisit", record, digest)
        else:
            def block(head: bytes = header, count: int = length) -> Iterator[bytes]:
                yield head
                yield from source.pieces(count)
                yield from source.pieces(4)

            members.add(block(), fields["warc-type"], record, digest)
        ordinal += 1
    return members.index


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise archives (``archive``, ``turned``: array of (ordinal, refers_to)).

    Returns ``archive`` (the new file), ``index`` (its sidecar) and ``records``.
    """
    _make_folder(folder)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for uri, turned in zip(frame["archive"], frame["turned"]):
                target = f"{folder}/{_own_name()}.warc.gz"
                system, path = _open(uri)
                there, new = _open(target)
                with system.open_input_stream(path, compression=None) as stream, \
                        there.open_output_stream(new, compression=None) as out:
                    index = normalise_stream(
                        stream, out, {t["ordinal"]: t["refers_to"] for t in turned})
                lines = io.StringIO()
                csv.writer(lines).writerows([Entry._fields, *index])
                with there.open_output_stream(f"{new}.idx", compression=None) as out:
                    out.write(lines.getvalue().encode())
                done.append((target, f"{target}.idx", len(index)))
            yield pd.DataFrame(done, columns=["archive", "index", "records"])

    return archives.mapInPandas(rows, "archive string, index string, records long")


# --- reading ------------------------------------------------------------------
def read_index(uri: str) -> list[Entry]:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as stream:
        lines = csv.reader(io.StringIO(stream.read().decode()))
        next(lines)
        return [Entry(int(a), int(b), *rest) for a, b, *rest in lines]


def _parsed(member: bytes) -> tuple:
    record = zlib.decompress(member, 31)
    header, rest = record.split(b"\r\n\r\n", 1)
    fields = fields_of(header)
    block = rest[:int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    page = _page_of(fields["warc-record-id"])
    size, digest = int(fields_of(http)["content-length"]), fields["warc-payload-digest"][5:]
    if fields["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {page} does not match its digest")
    refers = fields.get("warc-refers-to")
    return (page, size, digest, fields["warc-type"],
            None if refers is None else _page_of(refers))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives (``archive``, ``index``), each fetched by its
    place in the index and checked against its digest."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for frame in frames:
            for uri, index in zip(frame["archive"], frame["index"]):
                system, path = _open(uri)
                found = []
                with system.open_input_file(path) as file:
                    for entry in read_index(index):
                        found.append(_parsed(file.read_at(entry.length, entry.offset)))
                        if len(found) == 1000:
                            yield pd.DataFrame(found, columns=names)
                            found = []
                yield pd.DataFrame(found, columns=names)

    return archives.select("archive", "index").mapInPandas(
        rows, "page_id string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to string")


def archived(pages: DataFrame, folder: str, least: int = MIN_REVISIT_BYTES,
             roll: int = ROLL_BYTES) -> DataFrame:
    """Write pages to archives below ``folder``, normalise them and read them back.

    A row per page: ``page_id``, ``payload_bytes``, ``payload_digest`` (base32 SHA-1),
    ``record_type`` and ``refers_to``. Null and empty pages are empty payloads; a null
    ``page_id`` stays null and is the last choice for a response; repeated pages are
    records of their own; other columns are ignored.
    """
    records = stored(write_archives(pages, f"{folder}/crawl", roll), "records")
    turned = revisits(records, least).groupBy("archive").agg(
        F.collect_list(F.struct("ordinal", "refers_to")).alias("turned"))
    files = records.select("archive").distinct()
    spread = max(1, 2 * files.count())
    none = F.array().cast("array<struct<ordinal:bigint,refers_to:string>>")
    # The lists are as long as an archive has records, which its size bounds.
    work = files.join(turned, "archive", "left").withColumn("turned", F.coalesce("turned", none))
    new = stored(normalise(work.repartition(spread, "archive"), f"{folder}/normal"), "archives")
    found = read_archives(new.repartition(spread, "archive"))
    kind = dict(pages.dtypes)["page_id"]

    def number(name: str):
        return F.col(name).cast(kind).alias(name)

    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type",
                        number("refers_to"))


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
