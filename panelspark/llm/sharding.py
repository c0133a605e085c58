"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells; every shard owns `replicas` virtual nodes on it. A
key (document id and text checksum) hashes to a cell and belongs to the next
virtual node clockwise. No shard takes more than its bound: with load_factor 1
the bounds are n // shards or one more, so counts differ by one at most (law
'rows'). Keys that find a shard full continue clockwise to the next distinct
shard, so only overflowing keys leave their own arc.

Only the count of each cell decides how many of its keys go where, so the walk
runs on the driver over 65,536 counts at most, whatever the size of the table.
A row then needs its rank within its cell (about n / 65,536 rows; a window over
hashed keys, so no hot group) and a join with the placements by cell.

Null text counts as empty (size 1, checksum 0); a null id is a key like any
other. Repeated rows get slots of their own; which of two equal rows gets which
is arbitrary and makes no difference. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import cut

SHARDS, REPLICAS, CELLS = 8, 128, 1 << 16


def ring(shards: int, replicas: int = REPLICAS) -> np.ndarray:
    """For each cell the shards in the order in which a key walks past them."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{r}") >> 48, xxhash.xxh64_intdigest(f"{s}/{r}", seed=1), s) for s in range(shards) for r in range(replicas))
    cells, owners = np.array([n[0] for n in nodes]), [n[2] for n in nodes]
    walks, upcoming = np.empty((len(nodes), shards), dtype=np.int64), list(range(shards))
    for i in reversed(range(2 * len(nodes))):  # from behind: the owner here moves to the front of the walk
        s = owners[i % len(nodes)]
        upcoming.remove(s)
        upcoming.insert(0, s)
        walks[i % len(nodes)] = upcoming
    return walks[np.searchsorted(cells, np.arange(CELLS)) % len(nodes)]


def place(counts: np.ndarray, shards: int, load_factor: float = 1.0, replicas: int = REPLICAS) -> pd.DataFrame:
    """(cell, shard, lo, hi, slot0): ranks lo to hi-1 of a cell go to shard, from slot0 on. counts: keys by cell."""
    n, walks = int(counts.sum()), ring(shards, replicas)
    if load_factor <= 1:
        room = np.array([n // shards + (s < n % shards) for s in range(shards)])
    else:
        room = np.full(shards, int(np.ceil(load_factor * n / shards)))
    left, done, filled, out = counts.copy(), np.zeros_like(counts), np.zeros(shards, dtype=np.int64), []
    for step in range(shards):
        for s in range(shards):
            own = np.flatnonzero((walks[:, step] == s) & (left > 0))
            asked = left[own]
            before = np.cumsum(asked) - asked
            got = np.clip(room[s] - filled[s] - before, 0, asked)
            own, got, before = own[got > 0], got[got > 0], before[got > 0]
            out.append(pd.DataFrame({"cell": own, "shard": s, "lo": done[own], "hi": done[own] + got, "slot0": filled[s] + before}))
            left[own] -= got
            done[own] += got
            filled[s] += got.sum()
    return pd.concat(out, ignore_index=True).astype("int64")


def shard(df: DataFrame, shards: int = SHARDS, load_factor: float = 1.0, replicas: int = REPLICAS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot (from 0, gapless in each shard) of every row."""
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    rows = cut(rows.withColumn("h", F.xxhash64("key", "text_crc32")).withColumn("cell", F.expr("shiftrightunsigned(h, 48)")), "shard_keys")
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in rows.groupBy("cell").count().collect():  # CELLS rows at most
        counts[r["cell"]] = r["count"]
    fields = "cell bigint, shard bigint, lo bigint, hi bigint, slot0 bigint"
    table = place(counts, shards, load_factor, replicas)
    places = spark.createDataFrame(table, fields) if len(table) else spark.createDataFrame([], fields)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "key", "size")) - 1
    # The placements have CELLS * shards rows at most; they meet the ranked rows where the window left them.
    placed = rows.withColumn("rank", rank).join(places, "cell").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
