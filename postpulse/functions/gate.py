"""A gate in the row: which values a dictionary may have, tested by expression.

The checksums of a dictionary's values set bits of a bitmap with 16 bits per value, which is
part of the expression. A value whose bit is not set is not in the dictionary, so it needs
no row and no join of its own. A set bit only lets a value through; the join decides. Up to
``FEW`` values stand in the expression themselves, as a set, which is asked faster. From
``MAX_BITS / 16`` values on the bitmap does not grow any more, and more values pass it in
vain, with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_VALUE = 16
MAX_BITS = 1 << 22
FEW = 1000
_WORD = 64


def checksum(value: Column) -> Column:
    """The number that ``zlib.crc32`` gives for the value's bytes."""
    return F.crc32(value.cast("binary"))


def listed(values: Collection, kind: str, separator: str = ",") -> Column:
    """An array that is part of the expression, however many values it has.

    It is made of one text, which is split and cast once, while the plan is optimised.
    """
    return F.split(F.lit(separator.join(map(str, values))), separator).cast(f"array<{kind}>")


@dataclass(frozen=True)
class Gate:
    """``bitmap`` is an array of longs that holds ``bits`` bits; few ``values`` need none."""

    bits: int
    bitmap: Column | None = None
    values: tuple[str, ...] | None = None

    def opens(self, value: Column) -> Column:
        """Whether the dictionary may have the value; never false for one that it has."""
        if self.values is not None:
            return value.isin(list(self.values))
        slot = checksum(value) % self.bits
        return F.getbit(F.get(self.bitmap, F.shiftright(slot, 6).cast("int")),
                        (slot % _WORD).cast("int")) == 1

    def places(self, words: Column) -> Column:
        """Where the words stand that the gate opens for, from 0; null without words."""
        every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
        return F.filter(every, lambda i: self.opens(F.get(words, i)))


def _size(values: int) -> int:
    bits = _WORD
    while bits < min(MAX_BITS, BITS_PER_VALUE * values):
        bits *= 2
    return bits


def gate(values: DataFrame, column: str) -> Gate:
    """The gate of the distinct values of a column.

    The driver gets at most ``MAX_BITS / 64`` rows, each 64 bits of the bitmap, or few values.
    """
    few = values.select(column).dropna().distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        return Gate(_size(len(few)), values=tuple(sorted(row[0] for row in few)))
    known = values.select(checksum(F.col(column)).alias("sum")).distinct()
    bits = _size(known.count())
    slots = known.select((F.col("sum") % bits).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(slot % {_WORD} AS int))")).alias("set"))
    filled = [0] * (bits // _WORD)
    for row in words.collect():
        filled[row["word"]] = row["set"]
    return Gate(bits, listed(filled, "bigint"))


def gate_of(values: Collection[str]) -> Gate:
    """The gate of values that are part of the program."""
    if len(values) <= FEW:
        return Gate(_size(len(values)), values=tuple(sorted(values)))
    bits = _size(len(values))
    filled = [0] * (bits // _WORD)
    for value in values:
        slot = zlib.crc32(value.encode()) % bits
        filled[slot // _WORD] |= 1 << slot % _WORD
    signed = [word - (1 << _WORD) if word >> _WORD - 1 else word for word in filled]
    return Gate(bits, listed(signed, "bigint"))
