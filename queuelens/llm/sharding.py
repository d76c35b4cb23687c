"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from queuelens.llm.common import group_slots, settle, utf8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jump ahead until the next jump leaves the range."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            s = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            state[moving] = s
            draw = ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead = np.floor((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            inside = ahead < shards
            moving = moving[inside]
            shard[moving] = ahead[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to shards-1 of any key column; equal keys share one, null is a key too."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype("int32"))

    return place(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its gapless slot there and its shard among one more.

    Law ``key``: only the key and the shard count decide, so going to
    ``shards + 1`` moves rows into the new shard alone. A null key goes where
    its hash says; a null text has size 1 and the checksum of no bytes;
    repeated rows each get a slot; an empty table gives no rows. Only the two
    named columns are read, so further columns cannot clash.
    """
    body = utf8(text)
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"))
    return (group_slots(settle(rows), "shard", "slot")
            .select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
