"""Shard placement with a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (offset and
skip from two hashes of its name); shards take turns claiming their next free slot
until the table is full.  A key is placed by one table lookup, so placement costs the
same for any number of shards, shards differ by at most one slot, and removing a shard
moves few keys besides its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: Slots.  Prime, and over a hundred times the shards placed by default.
TABLE_SIZE = 8191


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The slot -> shard-number table.

    ``size`` must be prime and at least the number of shards; names must be distinct.
    No shards is an error, one shard owns every slot.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not _prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    seed = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = np.array([int.from_bytes(d[:8], "big") % size for d in seed])
    skip = np.array([int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in seed])
    table, turn, free = np.full(size, -1, np.int32), np.zeros(len(shards), np.int64), size
    while free:
        for k in range(len(shards)):
            while table[slot := (offset[k] + turn[k] * skip[k]) % size] >= 0:
                turn[k] += 1
            table[slot] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its parts joined by U+001F, modulo the size.

    Null parts hash as the string ``\\N``, so null keys share one defined slot.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``keys`` of every row plus ``slot`` and ``shard``.

    Repeated rows stay and land together; an empty table gives an empty result; other
    columns are not read, so they cannot clash, and if a key has the name of a result,
    that result gets underscores behind its name.  The table is a literal of ``size``
    small integers in the plan: its bound is the parameter, whatever the data.
    Nothing is shuffled and no key group is ever gathered.
    """
    names = F.array(*[F.lit(s) for s in shards])
    table = F.from_json(F.lit("[" + ",".join(map(str, lookup_table(shards, size))) + "]"), "array<int>")
    given = df.select(*keys)
    slot, shard = fresh("slot", given), fresh("shard", given)
    slotted = given.select("*", slot_of(*[F.col(k) for k in keys], size=size).alias(slot))
    return slotted.select("*", F.get(names, F.get(table, F.col(slot))).alias(shard))


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write whole rows under ``path/shard=<name>/``, with all their columns.

    Where ``df`` has a column ``shard``, the folders get underscores behind that name.
    Repeated rows stay, null keys share one shard, an empty table writes no rows.  Rows are dealt by shard and a hash of the key, so one shard is written by up to
    ``files_per_shard`` tasks and a shard that grows is split rather than gathered.
    """
    names = F.array(*[F.lit(s) for s in shards])
    table = F.from_json(F.lit("[" + ",".join(map(str, lookup_table(shards, size))) + "]"), "array<int>")
    shard = F.get(names, F.get(table, slot_of(*[F.col(k) for k in keys], size=size)))
    name = fresh("shard", df)
    dealt = df.select("*", shard.alias(name))
    part = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(files_per_shard))
    dealt.repartition(len(shards) * files_per_shard, F.col(name), part).write.partitionBy(name).parquet(path)
