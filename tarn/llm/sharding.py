"""Jump consistent hashing: rows go to shards by a stable key, without a ring table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import text_or_empty

#: Slots are numbered in so many chunks a shard, so that no shard is one task.
CHUNKS = 4096


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of key among 0 .. shards-1.

    From shard b the next jump goes to floor((b + 1) * 2^31 / r), r in 1 .. 2^31 drawn by hashing
    (key, b); the last landing below `shards` is the answer. A jump depends on the key and on b
    only, so one more shard takes rows from the others and moves none between them. At most
    `shards` jumps happen, and about ln(shards) on average; beyond 64 shards the number unrolled is
    32 + 16 ln(shards), which a key exceeds with a probability below 10^-40. Keys that are null
    share one shard.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    steps = shards if shards <= 64 else 32 + int(16 * math.log(shards))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(state: Column, _: Column) -> Column:
        inside = state["j"] < shards
        b = F.when(inside, state["j"]).otherwise(state["b"])
        r = F.shiftrightunsigned(F.xxhash64(key, state["j"]), 33) + 1
        j = F.floor((state["j"] + 1) * F.lit(2.0**31) / r)
        return F.struct(b.alias("b"), F.when(inside, j).otherwise(state["j"]).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump, lambda s: s["b"].cast("int"))


def assign_shards(rows: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """rows with size, text_crc32, law, shard, slot and grown_shard (the shard among one more).

    Slots number each shard's rows from 0 without gaps, in the order of (hash chunk of the key, key,
    checksum, size). Chunks are counted first from the key column alone; a row's slot is its chunk's
    offset plus its rank in the chunk, so no shard is ever sorted in one task. keep: the columns that
    stay (all by default).

    Null text: size 1, checksum 0. Null keys are one stable key. Repeated rows each get a slot.
    Columns of rows that clash with the added ones are replaced. Empty input gives no rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in added]
    chunk = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(CHUNKS)).cast("int")
    counted = (
        rows.select(jump_shard(F.col(key), shards).alias("__shard"), chunk.alias("__chunk"))
        .groupBy("__shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    )
    before = Window.partitionBy("__shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("__shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    sized = rows.select(
        *kept,
        F.col(key).alias("__key"),
        (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("__shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
        chunk.alias("__chunk"),
    )
    order = Window.partitionBy("__shard", "__chunk").orderBy("__key", "text_crc32", "size")
    return (
        sized.join(offsets.hint("shuffle_merge"), ["__shard", "__chunk"])
        .withColumn("slot", (F.col("__offset") + F.row_number().over(order) - 1).cast("long"))
        .select(*kept, "size", "text_crc32", "law", F.col("__shard").alias("shard"), "slot", "grown_shard")
    )
