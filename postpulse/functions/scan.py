"""Words of many texts at once, found by numpy on their code points.

A table has the class of every code point whose class and lower case are the same in all
versions of Unicode since 3.2, and a text of only these is cut into words without a regex.
A text with any other gives no result here, and callers cut it by the patterns that define
the words (``constants``), so results do not depend on which way a text goes.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Classes of code points.
APART, WORD, QUOTE, UNKNOWN = range(4)
# Behind the first plane only pictures are known, which are no letters in any version.
PICTURES = (0x1F300, 0x1FB00)
LIMIT = 0x20000
# Bytes scanned at once, and counted at once: more are counted to fewer rows.
CHUNK_BYTES = 512 << 10
COUNTED_BYTES = 16 << 20
_KEYS = 1 << 16


def _class_of(char: str) -> int:
    kind = unicodedata.category(char)
    if kind != unicodedata.ucd_3_2_0.category(char) or kind in ("Cn", "Cs") or len(char.lower()) != 1:
        return UNKNOWN
    # The lower case of a sigma depends on where it stands.
    if char == "Σ":
        return UNKNOWN
    return WORD if kind[0] in "LN" or char == "_" else QUOTE if char == "'" else APART


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case by code point; the last entry stands for all from ``LIMIT`` on."""
    classes = np.full(LIMIT + 1, UNKNOWN, np.uint8)
    lower = np.arange(LIMIT + 1, dtype=np.uint32)
    for code in range(0x10000):
        char = chr(code)
        classes[code] = _class_of(char)
        if classes[code] == WORD:
            lower[code] = ord(char.lower())
    classes[PICTURES[0]:PICTURES[1]] = APART
    return classes, lower


@dataclass
class Scan:
    """Words of a chunk: word i is ``codes[starts[i]:ends[i]]``, of ``text`` as well.

    Text t has the words ``first[t]`` to ``first[t + 1] - 1``; those of texts that are not
    ``known`` mean nothing.
    """

    text: str
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    known: np.ndarray


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices with about ``most`` bytes and where they start; a longer text is one slice."""
    if not len(texts):
        return
    sizes = _bytes(texts)[1]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, texts.slice(start, stop - start)
        start = stop


def scan(texts: pa.Array, quotes: bool) -> Scan:
    """Runs of letters, numbers and underscore; with ``quotes`` also of quotes behind the first."""
    data, offsets = _bytes(texts)
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        none = np.zeros(0, np.int64)
        return Scan("", none, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), bool))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) < len(data):
        # From bytes to code points.
        sizes = pc.utf8_length(texts.fill_null("")).to_numpy()
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    if codes.max(initial=0) >= LIMIT:
        codes = np.minimum(codes, LIMIT)
    classes = np.take(tables()[0], codes, mode="clip")
    odd = np.searchsorted(np.flatnonzero(classes == UNKNOWN), offsets)
    inside = (classes == WORD) | (classes == QUOTE) if quotes else classes == WORD
    # Where runs begin and end; one that reaches the end of a text ends there.
    edges = np.zeros(len(codes) + 1, bool)
    edges[0], edges[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=edges[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(codes))]
    joined = np.unique(cut[inside[cut] & inside[cut - 1]])
    places = np.flatnonzero(edges)
    starts, ends = places[0::2], places[1::2]
    if len(joined):
        starts, ends = np.sort(np.append(starts, joined)), np.sort(np.append(ends, joined))
    if quotes:
        quoted = classes[starts] == QUOTE
        if quoted.any():
            letters = np.append(np.flatnonzero(classes == WORD), len(codes))
            starts = starts.copy()
            starts[quoted] = letters[np.searchsorted(letters, starts[quoted])]
            starts, ends = starts[starts < ends], ends[starts < ends]
    return Scan(text, codes, starts, ends, np.searchsorted(starts, offsets), np.diff(odd) == 0)


# --- entries ------------------------------------------------------------------
def _key(first: np.ndarray, second: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (first * 40503 + second * 2654435 + last * 97 + size * 7919) % _KEYS


def keys_of(words: Collection[str]) -> np.ndarray:
    """Which keys (of first, second and last letter and length) the words have."""
    open_ = np.zeros(_KEYS, bool)
    if words:
        letters = np.array([[ord(w[0]), ord(w[min(1, len(w) - 1)]), ord(w[-1]), len(w)] for w in words], np.int64)
        open_[_key(*letters.T)] = True
    return open_


def candidates(found: Scan, keys: np.ndarray) -> np.ndarray:
    """The words that have one of the keys, in lower case."""
    lower = tables()[1]
    starts, ends = found.starts, found.ends
    first, second, last = (lower[found.codes[at]].astype(np.int64) for at in (
        starts, np.minimum(starts + 1, ends - 1), ends - 1))
    return np.flatnonzero(keys[_key(first, second, last, ends - starts)])


# --- counts -------------------------------------------------------------------
def counted_words(found: Scan) -> Scan:
    """Words without a closing ``'s``, and no bare numbers (``COUNTED_WORD_PATTERN``)."""
    codes, starts, ends = found.codes, found.starts, found.ends.copy()
    long = np.flatnonzero(ends - starts > 2)
    last, before = codes[ends[long] - 1], codes[ends[long] - 2]
    ends[long[((last == 0x73) | (last == 0x53)) & (before == 0x27)]] -= 2
    begins = codes[starts]
    number = np.flatnonzero((begins >= 0x30) & (begins <= 0x39))
    text = found.text
    bare = [i for i, a, b in zip(number.tolist(), starts[number].tolist(), ends[number].tolist())
            if text[a:b].isdecimal() and text[a:b].isascii()]
    kept = np.ones(len(starts), bool)
    kept[bare] = False
    before = np.concatenate(([0], np.cumsum(kept)))
    return Scan(text, codes, starts[kept], ends[kept], before[found.first], found.known)


def encoded(found: Scan) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, and the lower-case words by number."""
    if not len(found.starts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    sizes = found.ends - found.starts
    steps = np.zeros(len(found.codes) + 1, np.int8)
    steps[found.starts] = 1
    steps[found.ends] -= 1
    letters = tables()[1][found.codes[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]]
    data = letters.tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if len(data) > len(letters):
        width = 1 + sum((letters >= least).astype(np.int8) for least in (0x80, 0x800, 0x10000))
        offsets = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[offsets]
    words = pa.Array.from_buffers(pa.large_string(), len(sizes), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    numbered = words.dictionary_encode()
    return numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.cast(pa.string())


def groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every row, the same only for equal values, and a row of every number."""
    if not columns:
        return np.zeros(rows, np.int64), np.zeros(min(rows, 1), np.int64)
    numbers, owners = {}, []
    of = np.zeros(rows, np.int64)
    for i, values in enumerate(zip(*(column.to_pylist() for column in columns))):
        values = repr(values)
        if values not in numbers:
            numbers[values] = len(owners)
            owners.append(i)
        of[i] = numbers[values]
    return of, np.array(owners, np.int64)


def counts(texts: pa.Array, by: list[pa.Array], pairs: bool) -> tuple[list[pa.Array], np.ndarray]:
    """Counts of the words of known texts, and the places of the other texts.

    Counts are columns: ``by``, first word, with ``pairs`` the word that follows it in its
    text (null for the last one), and how often.
    """
    found = counted_words(scan(texts, True))
    group, owners = groups(by, len(texts))
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    numbers, words = encoded(found)
    size = len(words) + 1
    code = group[text] * size + numbers
    if pairs:
        following = np.full(len(numbers), len(words))
        following[:-1] = np.where(text[1:] == text[:-1], numbers[1:], len(words))
        code = code * size + following
    code, n = np.unique(code[found.known[text]], return_counts=True)
    second = []
    if pairs:
        code, after = np.divmod(code, size)
        second = [words.take(pa.array(after, pa.int64(), mask=after == len(words)))]
    code, first = np.divmod(code, size)
    at = pa.array(owners[code] if len(code) else code, pa.int64())
    return ([column.take(at) for column in by] + [words.take(pa.array(first, pa.int64()))] + second
            + [pa.array(n, pa.int64())], np.flatnonzero(~found.known))
