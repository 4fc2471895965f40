"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, read, running_starts, texts

SHARDS = 24


def distance(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """Exponential draw of a key for a shard; the shard with the smallest draw owns the key.

    53 bits of the hash give a number in (0, 1); -ln of it over the weight is smallest
    for a shard with a chance in proportion to its weight, whatever other shards exist.
    """
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def owner(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """Number of the shard that owns a key. A shard of weight 0 owns nothing."""
    draws = [F.struct(distance(keys, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("a shard of positive weight is needed")
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else draws[0]["shard"]


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard of every row by its key, its slot there, and its shard with one more shard.

    Only the key and the weights decide, so equal keys share a shard and a new shard
    takes rows only into itself. Slots are gapless from 0 within a shard, by input
    partition, then key. Null text counts as empty, a null key is a key of its own,
    repeated rows each get a slot, an empty table gives no rows.
    """
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))]
    data = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    grown = [*weights, grown_weight]
    rows = texts(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        owner(keys, weights).alias("shard"),
        owner(keys, grown).alias("grown_shard"),
    )
    # fixed rows and partitions: a slot must not change if a task runs again
    rows = cut(rows).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1))
    rows = running_starts(rows, ["shard"], "part", ["doc_id", "text_crc32", "size"], "one", "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents by key."""
    return shard_documents(read(spark, sf_dir, "documents"))
