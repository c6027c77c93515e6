"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an
offset and a step from hashes of its name). Shards take turns; each claims the next
free slot it prefers, until no slot is free. So slots are spread evenly to within one,
and when a shard joins or leaves, few slots change hands. A row's slot is a hash of its
key modulo the size, and the table, whose size is fixed, is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, at least a hundred times the number of shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the place in ``shards`` of the shard that claimed it.

    Raises ValueError for no shards, repeated names, or a size that is no prime or too small.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(slots) or slots < 100 * len(shards):
        raise ValueError("the number of slots must be a prime of at least 100 per shard")
    # Turns follow the names, so the order in which shards are listed does not matter.
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    steps = np.arange(slots, dtype=np.int64)
    wishes = []
    for i in order:
        name = shards[i].encode()
        offset = xxhash.xxh64_intdigest(name, seed=1) % slots
        step = xxhash.xxh64_intdigest(name, seed=2) % (slots - 1) + 1
        wishes.append(iter(((offset + step * steps) % slots).tolist()))
    table = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for i, wish in zip(order, wishes, strict=True):
            table[next(s for s in wish if table[s] < 0)] = i
            free -= 1
            if not free:
                break
    return table


def slot(keys: Sequence[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, the name of the shard its key belongs to.

    Defined cases: rows with equal keys, repeated rows too, share a shard; a null in a key
    is skipped by the hash, so keys of nulls alone share one slot; columns ``slot`` and
    ``shard`` of the input are replaced; an empty table gives no rows.
    """
    table = lookup_table(shards, slots)
    rows = [(i, shards[s]) for i, s in enumerate(table.tolist())]
    # A table of fixed size: ``slots`` rows, whatever the data.
    known = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    placed = df.drop("shard").withColumn("slot", slot(keys, slots))
    return placed.join(F.broadcast(known), "slot").select(*placed.columns, "shard")
