"""Placement by a lookup table that shards fill by permutation.

Every shard has its own order of the slots of a table of prime size, an arithmetic
sequence whose start and step come from hashes of its name. Shards take turns: each
claims the first slot in its order that is free, until none is. A key's slot is its hash
modulo the table size. When a shard goes, most keys stay where they are. The table has
one row per slot whatever the data, so it is broadcast, and placing a row is one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.storage import fresh, table

SLOTS = 65_537
SHARDS = 64


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt).digest(), "big")


def fill_table(shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS) -> list[str]:
    """The shard of every slot. A mapping gives shards weights; one of half the largest
    weight takes every second turn."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    weights = shards if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    names = sorted(name for name, weight in weights.items() if weight > 0)
    if not names:
        raise ValueError("no shard has a weight")
    heaviest = max(weights[name] for name in names)
    place = {name: _number(name, b"start") % slots for name in names}
    step = {name: _number(name, b"step") % (slots - 1) + 1 for name in names}
    due = dict.fromkeys(names, 0.0)
    owner: list[str | None] = [None] * slots
    free = slots
    while True:
        for name in names:
            due[name] += weights[name] / heaviest
            if due[name] < 1 - 1e-9:
                continue
            due[name] -= 1
            while owner[place[name]] is not None:
                place[name] = (place[name] + step[name]) % slots
            owner[place[name]] = name
            free -= 1
            if not free:
                return owner


def slot_of(keys: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(docs: DataFrame, owners: Sequence[str], keys: Sequence[str] = ("doc_id",),
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Add ``slot`` and ``shard`` to every row, from ``owners`` as ``fill_table`` gives.

    Rows with equal keys share a shard; null keys hash like any other value. Columns of
    these names are replaced.
    """
    spark = docs.sparkSession
    of, at, owner = fresh(docs.columns, "__of", "__slot", "__shard")
    rows = spark.createDataFrame(list(enumerate(owners)), f"{at} int, {owner} string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (slot.lower(), shard.lower())]
    # One row per slot: the size is fixed, whatever the data.
    placed = docs.withColumn(of, slot_of(keys, len(owners))).join(
        F.broadcast(rows), F.col(of) == F.col(at))
    return placed.select(*kept, F.col(of).alias(slot), F.col(owner).alias(shard))


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = fill_table([f"shard-{i:03d}" for i in range(SHARDS)])
    return place(table(spark, sf_dir, "documents").select("doc_id"), owners)
