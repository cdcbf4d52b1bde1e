"""Placement of documents on shards by a permutation-filled lookup table.

Each shard lists all slots of a prime-sized table in an order of its own.  The shards
take turns; at its turn a shard claims the first slot of its list that is still free.
The full table gives each shard as many slots as any other, give or take one, and a
shard that leaves changes few slots of the rest.  A document's slot is its key's hash
modulo the table size, so that placing one is a single look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.frames import _quoted, hidden

SHARDS = tuple(f"shard-{n:02d}" for n in range(64))
SLOTS = 6553
MOST_SLOTS = 65537  # bounds the broadcast table


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The number of the shard that holds each slot.

    Works on the shards' names only; its size does not depend on the data.
    """
    if not shards or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError("the table needs shards, and a slot for each, within the bound")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    place = [_hash(f"{name}|offset") % slots for name in shards]
    step = [_hash(f"{name}|skip") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    claimed = 0
    while True:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            claimed += 1
            if claimed == slots:
                return table


def lookup(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The table as ``slot, shard``, made from one literal."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*(F.lit(name) for name in shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        "slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")
    )


def slot(key: Column, slots: int) -> Column:
    """The slot of a key; a null key is placed like an empty one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(
    df: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """One row per row of ``df``: its key, ``slot`` and ``shard``.

    Equal keys go to the same shard; a null key is placed like an empty string.  Texts
    and other columns are not read.  An empty table gives an empty result.  No shuffle.
    """
    table = F.broadcast(lookup(df.sparkSession, shards, slots))
    placed = df.select(
        F.col(_quoted(key_col)).alias("__key"), slot(F.col(_quoted(key_col)), slots).alias("slot")
    )
    return placed.join(table, "slot").select(F.col("__key").alias(key_col), "slot", "shard")


def write_shards(
    df: DataFrame,
    path: str,
    key_col: str = "doc_id",
    shards: Sequence[str] = SHARDS,
    slots: int = SLOTS,
) -> None:
    """Write all columns of ``df`` as Parquet, a folder ``shard=...`` for each shard.

    Rows are rebalanced by shard, so that a shard with many rows is written by several
    tasks and a small one by few files.  ``df`` must not have a column ``shard``.
    """
    table = lookup(df.sparkSession, shards, slots).withColumnRenamed("slot", "__slot")
    own, key = hidden(df, key_col)
    placed = own.withColumn("__slot", slot(F.col(key), slots)).join(F.broadcast(table), "__slot")
    placed = placed.select(*own.columns, "shard").toDF(*df.columns, "shard")
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
