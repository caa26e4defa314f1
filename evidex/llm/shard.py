"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, its order of preference. The
shards take turns, each claiming its first free slot, until the table is full; shard loads over
slots differ by one at most, and when a shard joins or leaves few slots change hands. A document
goes to the shard of the slot that its id hashes to: one lookup. The table is as large as its
prime, whatever the documents, so its broadcast is bounded.

Defined cases: a null id hashes as the text 'null'; repeated ids share a shard; text is not read;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot."""
    if not _is_prime(slots) or len(set(names)) != len(names) or not 0 < len(names) <= slots:
        raise ValueError("slots must be prime, names distinct and no more than slots")
    offset, skip = [], []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        offset.append(int.from_bytes(digest[:8], "big") % slots)
        skip.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    table, turn, left = [-1] * slots, 0, slots
    at = offset[:]
    while left:
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + skip[turn]) % slots
        table[at[turn]] = turn
        left -= 1
        turn = (turn + 1) % len(names)
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """First 15 hex digits of the key's SHA-256, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced."""
    names = names or [f"shard-{i:05d}" for i in range(SHARDS)]
    spark = docs.sparkSession
    numbers = fill_table(names, slots)
    table = spark.createDataFrame(
        [(i, names[s]) for i, s in enumerate(numbers)], "slot int, shard string"
    )
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col("doc_id"), slots))
    return keyed.join(F.broadcast(table), "slot").select(*docs.drop("slot", "shard").columns, "slot", "shard")
