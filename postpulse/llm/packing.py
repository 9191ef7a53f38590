"""Vector bin packing of examples into training sequences.

A sequence has room for ``tokens`` ids, ``segments`` pieces and ``loss`` ids that bear
loss. What a piece needs and what is left in a sequence are vectors of three shares;
the piece with the largest dot product of both goes in next, so that pieces are
preferred which need most of what there is most of. When nothing fits any more, the
largest waiting piece is cut to fill the rest.

Every task packs the documents it reads, with a bounded number of pieces waiting, so
there is no shuffle and hot sources do not matter. A sequence that would stay short is
cut back to the largest power of two, which needs no padding; what is cut off waits
for the next sequence. So nothing is padded, and a task ends with a few short sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from postpulse.llm import words as W
from postpulse.llm.storage import table
from postpulse.llm.tokens import byte_pair_ids

END_ID = 0
WAITING = 1024
TASK_SHIFT = 33


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


@dataclass
class Example:
    """``ids`` of a document; those before ``context`` bear no loss."""

    key: object
    ids: np.ndarray
    context: int


@dataclass
class Piece:
    example: Example
    start: int
    length: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.example.context))

    def split(self, length: int) -> tuple[Piece, Piece]:
        return (Piece(self.example, self.start, length),
                Piece(self.example, self.start + length, self.length - length))

    def prefix_within(self, tokens: int, loss: int) -> int:
        """The longest prefix with at most so many ids and so many that bear loss."""
        free = max(0, self.example.context - self.start)
        return min(self.length, tokens, free + loss)


class Packer:
    def __init__(self, limits: Limits):
        self.limits = limits
        self.waiting: list[Piece] = []

    def add(self, example: Example) -> Iterator[list[Piece]]:
        """Take a document; yields the sequences that are ready."""
        rest = Piece(example, 0, len(example.ids))
        while rest.length:
            piece, rest = rest.split(rest.prefix_within(self.limits.tokens, self.limits.loss))
            if piece.length == self.limits.tokens:
                yield [piece]
            else:
                self.waiting.append(piece)
        if len(self.waiting) >= 2 * WAITING:
            yield from self.pack(WAITING)

    def pack(self, leave: int = 0) -> Iterator[list[Piece]]:
        """Fill sequences until at most ``leave`` pieces wait."""
        while len(self.waiting) > leave:
            needs = np.array([(p.length, 1, p.loss) for p in self.waiting], np.float64)
            needs /= (self.limits.tokens, self.limits.segments, self.limits.loss)
            free = np.ones(len(needs), bool)
            added: list[Piece] = []
            while free.sum() + len(added) > leave and free.any():
                sequence = self._fill(needs, free, added)
                added += self._shorten(sequence)
                yield sequence
            self.waiting = [p for p, is_free in zip(self.waiting, free) if is_free] + added

    def _fill(self, needs: np.ndarray, free: np.ndarray, added: list[Piece]) -> list[Piece]:
        limits, sequence = self.limits, []
        left = np.ones(3)
        while len(sequence) < limits.segments:
            fits = free & (needs <= left + 1e-9).all(axis=1)
            if fits.any():
                best = int(np.argmax(np.where(fits, needs @ left, -1)))
                free[best] = False
                sequence.append(self.waiting[best])
                left = left - needs[best]
                continue
            room = limits.tokens - sum(p.length for p in sequence)
            loss = limits.loss - sum(p.loss for p in sequence)
            if not room or not free.any():
                break
            longest = int(np.argmax(np.where(free, needs[:, 0], -1)))
            length = self.waiting[longest].prefix_within(room, loss)
            if not length:
                break
            free[longest] = False
            piece, rest = self.waiting[longest].split(length)
            sequence.append(piece)
            added.append(rest)
            left = left - np.array([piece.length / limits.tokens, 1 / limits.segments,
                                    piece.loss / limits.loss])
        return sequence

    def _shorten(self, sequence: list[Piece]) -> list[Piece]:
        """Cut a short sequence to a power of two; returns what was cut off."""
        total = sum(piece.length for piece in sequence)
        if total == self.limits.tokens:
            return []
        over, cut = total - (1 << (total.bit_length() - 1)), []
        while over:
            last = sequence.pop()
            taken = min(over, last.length)
            if taken < last.length:
                kept, last = last.split(last.length - taken)
                sequence.append(kept)
            cut.append(last)
            over -= taken
        return cut


PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", limits: Limits = Limits(),
         context: str | None = None) -> DataFrame:
    """Pieces of packed sequences: ``key``, ``start`` and ``length`` in the document's
    ids, their CRC-32, the document's ids in all, ``sequence_id``, ``offset`` there and
    ``loss_tokens``.

    A document's ids are those of ``text`` by the byte-level BPE file ``tokenizer`` and
    an end id of 0. With ``context`` (a text column) its ids come first and bear no
    loss. Null and empty texts are the end id alone; documents longer than a sequence
    are cut. Repeated rows and null keys are documents like others; other columns are
    ignored. Sequences never hold pieces of two tasks.
    """
    columns = [key, "text"] + ([context] if context else [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        number = TaskContext.get().partitionId() << TASK_SHIFT

        def out(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            keys, table = [], []
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    ids = piece.example.ids
                    part = ids[piece.start:piece.start + piece.length].astype("<u4")
                    keys.append(piece.example.key)
                    table.append((piece.start, piece.length, zlib.crc32(part.tobytes()),
                                  len(ids), number, offset, piece.loss))
                    offset += piece.length
                number += 1
            values = np.array(table, np.int64).reshape(-1, 7)
            names = [part.split(" ")[0] for part in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), *(pa.array(values[:, i]) for i in range(7))],
                names=[key, *names])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(key).type
            for chunk in W.chunks(batch):
                ids, offsets = byte_pair_ids(chunk.column("text"), tokenizer)
                before, starts = (byte_pair_ids(chunk.column(context), tokenizer) if context
                                  else (ids[:0], np.zeros(chunk.num_rows + 1, np.int64)))
                ready = []
                for t, name in enumerate(chunk.column(key).to_pylist()):
                    own = before[starts[t]:starts[t + 1]]
                    whole = np.concatenate((
                        own, ids[offsets[t]:offsets[t + 1]], np.array([END_ID], np.uint32)))
                    ready += packer.add(Example(name, whole, len(own)))
                yield out(ready)
        yield out(list(packer.pack()))

    kind = dict(docs.dtypes)[key]
    return docs.select(*columns).mapInArrow(rows, f"{key} {kind}, {PIECES}")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
