"""Placement on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import without

SLOTS_PER_SHARD = 100
SLOTS_OF_LIGHTEST = 10
MAX_SLOTS = 1 << 22
ADDED = ["shard_slot", "shard"]


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def least_slots(shards: dict[str, int] | list[str]) -> int:
    """Slots that give each shard about SLOTS_PER_SHARD, and the lightest one SLOTS_OF_LIGHTEST of its own."""
    weights = list(shards.values()) if isinstance(shards, dict) else [1] * len(shards)
    return max(SLOTS_PER_SHARD * len(weights), -(-SLOTS_OF_LIGHTEST * sum(weights) // min(weights)))


def fill_table(shards: dict[str, int] | list[str], slots: int) -> list[str]:
    """The shard of each slot: shards take turns and claim the next free slot of their own preference order, a
    permutation of the slots with a start and a stride hashed from the name.

    A round adds a shard's weight to its credit; a turn costs the greatest weight. So the heaviest shard has a turn every
    round, and the others have theirs as often as their share asks, however unequal the weights are. slots must be prime,
    so every stride visits all slots, and enough for the lightest shard's share to be one slot.
    """
    weights = dict.fromkeys(shards, 1) if not isinstance(shards, dict) else shards
    if not weights or min(weights.values()) < 1:
        raise ValueError("at least one shard is needed, and weights from 1")
    if slots != next_prime(slots) or slots * min(weights.values()) < sum(weights.values()):
        raise ValueError("slots must be a prime, and enough for the lightest shard to have one")
    at = {name: _number(f"start {name}") % slots for name in weights}
    stride = {name: _number(f"stride {name}") % (slots - 1) + 1 for name in weights} if slots > 2 else dict.fromkeys(weights, 1)
    table: list[str | None] = [None] * slots
    free, most, credit = slots, max(weights.values()), dict.fromkeys(weights, 0)
    while free:
        for name, weight in weights.items():
            credit[name] += weight
            if credit[name] >= most and free:
                credit[name] -= most
                while table[at[name]] is not None:
                    at[name] = (at[name] + stride[name]) % slots
                table[at[name]] = name
                free -= 1
    return table  # type: ignore[return-value]


def slot_of(key, slots: int):
    """Slot of a key column: 32 bits of its MD5 as text, modulo the slots; null counts as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: dict[str, int] | list[str], slots: int | None = None) -> DataFrame:
    """Add shard_slot (long) and shard (string) to every row by a broadcast lookup; DataFrame functions only, no shuffle.

    The table has about 100 slots a shard unless given, more if weights are very unequal (least_slots), so its size
    depends on the shards alone; beyond MAX_SLOTS it is no table to broadcast, and an error.
    Balance comes from the key: with a key that is unique per row (doc_id) a hot source or group of copies spreads
    evenly, and equal keys share a shard. Null keys share one slot. An empty table stays empty. Adding or removing a
    shard moves few keys of the others. Input columns named like the added ones give way.
    """
    df = without(df, ADDED)
    slots = slots or next_prime(least_slots(shards))
    if slots > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} slots")
    listed = F.from_json(F.lit(json.dumps(fill_table(shards, slots))), "array<string>")
    table = df.sparkSession.range(1).select(F.posexplode(listed).alias("_slot", "shard"))
    keyed = df.withColumn("shard_slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table), F.col("shard_slot") == F.col("_slot").cast("long")).drop("_slot")
