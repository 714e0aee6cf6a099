"""Sharding by rendezvous hashing.

Each record key scores every shard with a hash of (key, shard) and goes to the shard with the highest score,
so adding a shard moves only the records that the new shard wins. A shard of weight w wins a share in
proportion to w: the score is ``ln(u) / w`` for a hash u in (0, 1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that make u; 13 digits are 52 bits and exact in a double.
DIGITS = 13


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins ``key``; ties go to the lower shard number, null keys hash as the empty string."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and at least one")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def unit(shard: int) -> Column:
        digest = F.md5(F.concat(text, F.lit(f":{shard}")))
        return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)

    scores = [F.struct((F.log(unit(i)) / F.lit(float(w))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8,
          rows_per_bucket: int = 10_000) -> DataFrame:
    """Give every record a shard and a gapless slot in it.

    Returns key, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, shard, slot and
    grown_shard, the shard under one more shard of the mean weight. An empty table gives an empty result; equal
    records and repeated keys share a shard and get slots of their own; extra columns are ignored.

    Slots are numbered in two steps, so that no task holds a shard: rows are numbered within small key buckets
    of a shard, and bucket offsets come from a running sum over bucket counts.
    """
    grown = [*weights, sum(weights) / len(weights)]
    body = F.col(text)
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    buckets = max(1, -(-df.select(key).count() // (rows_per_bucket * len(weights))))
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("offset") + F.col("rank")).alias("slot"), "grown_shard")
    )
