"""Placement of keys on shards by a permutation-filled lookup table.

Shards take turns in claiming slots of a prime-sized table, each in its own
preference order (``offset + turn * skip``), until every slot is taken. A key
hashes to a slot, and the slot names the shard. Shards get within one turn of
each other in slots, and when a shard joins or leaves few other slots move.
The table has ``table_size`` entries whatever the data hold, so broadcasting it
is bounded by that parameter, and a lookup is one probe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.tables import free_name

TABLE_SIZE = 65537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """For every slot the place of its shard in ``shards``."""
    if table_size < 3 or any(table_size % d == 0 for d in range(2, int(table_size ** 0.5) + 1)):
        raise ValueError("table_size must be a prime")
    if not 0 < len(set(shards)) == len(shards) <= table_size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    at = [_number(f"{name}/offset") % table_size for name in shards]
    skip = [_number(f"{name}/skip") % (table_size - 1) + 1 for name in shards]
    owner, left = [-1] * table_size, table_size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % table_size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """Slot of a key: its MD5 modulo the table; null counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % table_size).cast("int")


def place(df: DataFrame, key: Column, shards: Sequence[str], table_size: int = TABLE_SIZE,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Equal keys meet on one shard. If one key may hold a large share of the
    rows, pass a salted key (``F.concat(key, F.lit("#"), salt)``). A null key has the slot
    of the empty string. Columns named like the two new ones are kept under a
    leading underscore; an empty table gives an empty table.
    """
    for name in (slot, shard):
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, name))
    names = F.array(*[F.lit(s) for s in shards])
    owners = df.sparkSession.range(1).select(F.posexplode(F.split(
        F.lit(",".join(map(str, lookup_table(shards, table_size)))), ",")).alias(slot, "_owner"))
    owners = owners.select(slot, F.element_at(names, F.col("_owner").cast("int") + 1).alias(shard))
    placed = df.withColumn(slot, slot_of(key, table_size))
    return placed.join(F.broadcast(owners), slot).select(*df.columns, slot, shard)


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 1) -> None:
    """Write one folder per shard, each by ``files_per_shard`` tasks so that no task holds a whole large shard."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    name = free_name(placed, "_spread")
    out = placed.withColumn(name, spread)
    shards = out.select(shard).distinct().count()
    out.repartition(max(1, shards * files_per_shard), shard, name).drop(name).write.partitionBy(shard).parquet(path)
