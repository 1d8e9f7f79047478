"""Placement by a permutation-filled lookup table (operator 5).

Every shard has its own order of preference over the slots of a prime-sized
table: an offset and a step from hashes of its name. The shards take turns, each
claiming the first free slot in its order, until the table is full; so each gets
the same number of slots up to one, and a change of shards moves few of the
others' slots. A key's slot is its hash modulo the table size, and the table,
whose size is a parameter, is broadcast for constant-time lookup.

Placement needs no shuffle: a key that holds a third of the rows costs nothing
extra. Rows without a key are placed by their text. Repeated rows go to the
same shard; extra columns are carried as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime table size: the bound of what is broadcast (16 bytes a slot).
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{use}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that holds each slot."""
    if not _is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("the size must be a prime, and the shards distinct and no more than it")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    place = [_hash(shards[i], "offset") % size for i in order]
    step = [_hash(shards[i], "step") % (size - 1) + 1 for i in order]
    table = np.full(size, -1, np.int64)
    left = size
    while left:
        for k, shard in enumerate(order):
            while table[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % size
            table[place[k]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, otherwise: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a row: its key's hash, or ``otherwise``'s where the key is null."""
    value = F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.coalesce(otherwise.cast("string"), F.lit(""))))
    return F.pmod(F.xxhash64(value), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, key: str = "doc_id", text: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """``doc`` (the row) with its ``slot`` and ``shard``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    by_name = {c.lower(): n for n, c in reversed(list(zip(names, docs.columns, strict=True)))}
    rows = docs.toDF(*names)
    rows = rows.select(F.struct(*names).alias("doc"), slot_of(F.col(by_name[key.lower()]), F.col(by_name[text.lower()]), size).alias("slot"))
    table = lookup_table(shards, size).tolist()
    slots = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    return rows.join(F.broadcast(slots), "slot").select("doc", "slot", "shard")


def load_by_shard(placed: DataFrame) -> DataFrame:
    """Rows and distinct slots of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"))


def moved_share(before: tuple[str, ...], after: tuple[str, ...], size: int = TABLE_SIZE) -> float:
    """Share of slots whose shard changes between two sets of shards."""
    a, b = lookup_table(before, size), lookup_table(after, size)
    return float(np.mean(np.array(before, object)[a] != np.array(after, object)[b]))
