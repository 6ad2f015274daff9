"""Sharding by jump consistent hashing, in Spark expressions only.

The key's pseudo-random sequence is xxhash64(key, step). From bucket b the key jumps to floor((b + 1) / u), u uniform
in (0, 1]; the last bucket below the number of shards holds it. A jump never depends on the number of shards, so an
appended shard takes a key or leaves it where it was: no ring table, and only 1/(n+1) of the rows move.

Defined cases: a null key is a key like any other; repeated rows share a shard and take slots of their own; an empty
table gives no rows; columns beside the key and the text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import partitions, pick


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of key among shards (int). Each step jumps forward, so shards steps always suffice; beyond 64 shards the
    expected ln(shards) steps with a wide margin do (a key needing more has a chance below 1e-30)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    steps = min(shards, 64 + 8 * math.ceil(math.log(shards + 1)))
    state = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("next"))

    def jump(s: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 11).cast("double") + 1) / F.lit(float(1 << 53))
        go = s["next"] < shards
        return F.struct(
            F.when(go, s["next"]).otherwise(s["held"]).alias("held"),
            F.when(go, F.floor(F.least((s["next"] + 1) / u, F.lit(float(1 << 62))))).otherwise(s["next"]).cast("long").alias("next"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump, lambda s: s["held"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, the shard after one more is appended, and a gapless slot in its shard.

    Slots are numbered in two levels: rows are ranked in (shard, lane) groups, lanes being hashed pieces of a shard that
    grow in number with the input, and a small table of lane sizes gives each lane its first slot. No task sees a
    whole shard.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = pick(docs, key, text).toDF("doc_id", "text").select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    lanes = max(16, 4 * partitions(docs))
    # A key's repeated rows may be many: the row's own digest spreads those that differ, a rank orders the rest.
    slim = slim.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(lanes)).cast("int"))
    counts = slim.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")))
    # At most shards * lanes rows, so its size is known; the join itself is left to the planner's own size check.
    return ranked.join(first, ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
    )
