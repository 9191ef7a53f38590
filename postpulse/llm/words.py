"""Words and word hashes of many texts at once, on their UTF-8 bytes.

The word rules of the operators split at ASCII bytes only, so a table of 256 flags
decides for every byte whether it belongs to a word, and numpy finds all words of a
batch without a loop over them. Bytes outside ASCII always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ALL = np.arange(256)

# The bytes that separate words.
SPACES = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
# Words of lowered texts, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, found before A-Z are lowered.
NOT_ALPHANUMERIC = (
    (_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x40)) | ((_ALL >= 0x5B) & (_ALL <= 0x60))
    | ((_ALL >= 0x7B) & (_ALL <= 0x7F))
)

CHUNK_BYTES = 2 << 20


def _mixed(seed: int, count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U64(27))) * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


_LOWER = _ALL + 32 * ((_ALL >= 0x41) & (_ALL <= 0x5A))
BYTE_CODES = _mixed(7, 256)
_BASE = U64(0xD6E8FEB86659FD93)
_PLACES = _mixed(11, 64) | U64(1)


@dataclass
class Words:
    """All words of a batch: ``data[starts[i]:ends[i]]`` is word i.

    Text t has the words ``first[t]`` to ``first[t + 1] - 1``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode()

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; nulls are empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, separators: np.ndarray) -> Words:
    data, offsets = text_bytes(texts)
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray
                ) -> np.ndarray:
    """A 64-bit hash of every span ``data[start:start + length]``; spans are in order.

    ``codes`` gives a number for each byte, and 0 for bytes between the spans.
    """
    if not len(starts):
        return np.zeros(0, U64)
    # A span's sum ends where the next span starts, so what lies between must add 0.
    reach = np.diff(np.concatenate((starts, [len(data)])))
    powers = np.ones(int(reach.max()) + 1, U64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _BASE, U64))
    place = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, reach)
    sums = np.add.reduceat(codes[data[starts[0]:]] * powers[place], starts - starts[0])
    return mix(sums ^ (lengths.astype(U64) * U64(0xA0761D6478BD642F)))


def word_hashes(words: Words, separators: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; with ``fold`` the letters A-Z count as lower case."""
    codes = np.where(separators, U64(0), BYTE_CODES[_LOWER] if fold else BYTE_CODES)
    return span_hashes(words.data, words.starts, words.ends - words.starts, codes)


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` hashes, whatever text they belong to."""
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, U64)
    for j in range(width):
        total += hashes[j:j + count] * _PLACES[j]
    return mix(total + U64(width))


def shingle_hashes(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts and their offsets by text.

    A text with fewer than ``width`` words is one shingle, one without words has none.
    """
    counts = np.diff(words.first)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - words.first[:-1], sizes)
    full = sequence_hashes(hashes, width)
    short = (counts > 0) & (counts < width)
    result = np.zeros(offsets[-1], U64)
    regular = np.repeat(~short, sizes)
    result[regular] = full[places[regular]]
    for t in np.flatnonzero(short):
        n = int(counts[t])
        own = hashes[words.first[t]:words.first[t] + n]
        result[offsets[t]] = sequence_hashes(own, n)[0]
    return result, offsets


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text is one slice."""
    sizes = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
