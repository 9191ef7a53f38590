"""Token ids of many texts by public vocabularies, each distinct piece encoded once.

A text is cut into pieces whose ids do not depend on what is around them. The pieces of
a batch are told apart by 64-bit hashes, distinct ones are encoded, and the ids of the
texts are put together by numpy. A worker remembers the pieces it has seen, up to a
bounded number, for the batches and tasks that follow.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from postpulse.llm import words as W

MAX_REMEMBERED = 400_000

# First bytes of the characters that can be white space outside ASCII, and white space
# and controls of ASCII: a space before one of them does not start a piece.
_NO_START = np.isin(np.arange(256), [*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3])


class Remembered:
    """Ids by piece; ``encode`` gives the ids of one piece."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)

    def _add(self, values: list[int]) -> int:
        at = len(self.known)
        if at + 1 >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        start = self.ends[at]
        while start + len(values) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[start:start + len(values)] = values
        self.ends[at + 1] = start + len(values)
        return at

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               hashes: np.ndarray) -> np.ndarray:
        """The number of every piece in the memory; new pieces are encoded."""
        codes, distinct = pd.factorize(hashes)
        if len(self.known) + len(distinct) > MAX_REMEMBERED:
            self.clear()
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        numbers = np.empty(len(distinct), np.int64)
        known = self.known
        for i, name in enumerate(distinct.tolist()):
            at = known.get(name)
            if at is None:
                j = first[i]
                piece = data[starts[j]:ends[j]].tobytes().decode()
                known[name] = at = self._add(self.encode(piece))
            numbers[i] = at
        return numbers[codes]

    def lengths(self, places: np.ndarray) -> np.ndarray:
        return self.ends[places + 1] - self.ends[places]

    def spread(self, places: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after another."""
        sizes = self.lengths(places)
        total = int(sizes.sum())
        shift = np.repeat(self.ends[places] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[np.arange(total) + shift]


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


@functools.lru_cache(maxsize=2)
def byte_pair_encoder(path: str) -> tuple[Remembered, list[str]]:
    """Encoder of a byte-level BPE file, and the strings that it reads as special."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        saved = json.load(file)
    letters = _byte_letters()
    special = {token["content"]: token["id"] for token in saved["added_tokens"]}
    vocabulary = {
        bytes(letters[c] for c in token): at
        for token, at in saved["model"]["vocab"].items() if token not in special
    }
    merged = [pair if isinstance(pair, list) else pair.split(" ")
              for pair in saved["model"]["merges"]]
    if any(saved["model"]["vocab"]["".join(pair)] != 256 + i for i, pair in enumerate(merged)):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    coder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN,
                              mergeable_ranks=vocabulary, special_tokens={})
    return Remembered(coder.encode_ordinary), sorted(special)


@functools.lru_cache(maxsize=2)
def _whole_text_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def sentence_pieces(path: str) -> tuple[Remembered, np.ndarray]:
    """Encoder of single words, and which ids stand for single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return Remembered(lambda word: model.encode(word, num_threads=1)), single


def byte_pair_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and the offset of each text.

    The same ids as the vocabulary's own library gives without added special tokens:
    its pattern always cuts before a space that visible text follows, so what lies
    between such spaces is encoded on its own. Texts that hold a special token's string
    are left to the library. Null texts have no ids.
    """
    memory, special = byte_pair_encoder(path)
    data, offsets = W.text_bytes(texts)
    starts_here = np.zeros(len(data), bool)
    starts_here[:-1] = (data[:-1] == 0x20) & ~_NO_START[data[1:]]
    filled = offsets[:-1] < offsets[1:]
    # A space at the end of a text is not followed by the next text's first letter.
    starts_here[offsets[1:][filled] - 1] = False
    starts_here[offsets[:-1][filled]] = True
    starts = np.flatnonzero(starts_here)
    ends = np.append(starts[1:], len(data))
    hashes = W.span_hashes(data, starts, ends - starts, W.BYTE_CODES)
    places = memory.places(data, starts, ends, hashes)
    ids = memory.spread(places)
    by_piece = np.concatenate(([0], np.cumsum(memory.lengths(places))))
    result = by_piece[np.searchsorted(starts, offsets)]
    odd = [t for t, text in enumerate(texts.to_pylist())
           if text and any(name in text for name in special)]
    if not odd:
        return ids, result
    parts = [ids[result[t]:result[t + 1]] for t in range(len(texts))]
    for t in odd:
        whole = _whole_text_encoder(path).encode(texts[t].as_py(), add_special_tokens=False)
        parts[t] = np.array(whole.ids, np.uint32)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
