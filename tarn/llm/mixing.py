"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled into one stream of words and cut into blocks of equal length.
The van der Corput points of a full period (the bit reversals of 0 .. 2^m - 1) run through the
cumulative slot quotas of the sources: the point's interval names the slot's source, and the slot's
rank among its source's slots names the block. Over a full period every interval gets exactly as
many points as it is long, so quotas are met without any error, and every stretch of the schedule is
close to the target shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import WORD, materialise, text_or_empty

#: The weights of the sources in code point order, repeating, and the mix's share of all sizes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block.
BLOCK = 1024
#: Running sums are made in so many chunks a source.
CHUNK_HEX = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: the empty string stands for the null source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: key, source_size, target.

    sized: key, size. Weights go to sources in code point order, null last. A target stops at `most`
    times its source's size and the excess is reshared by weight until none is above: in the order of
    cap / weight the stopped sources come first, so one pass of running sums finds the level.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("key") == "", "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.select("key", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * most).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "key")
    everything = Window.partitionBy(F.lit(1))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = sources.select(
        "*",
        (
            (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    free = F.col("w") * F.col("level") < F.col("cap")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("cap") / F.col("w"))).over(everything)
    return levels.select(
        "key", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * level), F.col("cap").cast("double")).alias("target")
    )


def reversed_bits(x: Column, bits: Column) -> Column:
    """The lowest `bits` bits of x, reversed."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.when(bits <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", x, F.lit(64) - bits))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot, key, rank, block, pass, words.

    A source of T words to take from a stream of n words gives T div n whole passes over its blocks
    and one slot for each block, the last cut short, of the rest.
    """
    t = targets.select("key", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("take")).filter("take > 0")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    t = t.select(
        "*",
        blocks.alias("blocks"),
        F.expr("take div source_size").alias("passes"),
        (F.col("take") % F.col("source_size")).alias("rest"),
    ).withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.coalesce(F.sum("quota").over(running), F.lit(0)).alias("low"),
        F.ceil(F.log2(F.sum("quota").over(Window.partitionBy(F.lit(1))).cast("double"))).cast("int").alias("bits"),
    )
    step = 1 << 16
    points = (
        t.select("*", F.explode(F.expr(f"sequence(0L, (quota - 1) div {step}L)")).alias("part"))
        .repartition("key", "part")
        .select("*", F.explode(F.expr(f"sequence(part * {step}L, least(quota, (part + 1L) * {step}L) - 1L)")).alias("u"))
    )
    slot = reversed_bits(F.col("low") + F.col("u"), F.col("bits"))
    slots = points.select("key", "source_size", "blocks", "passes", "rest", slot.alias("slot"), F.col("bits"))
    # A stretch of the schedule holds each source's share of it, so chunks of a source are of one size.
    slots = slots.withColumn("stretch", F.expr("shiftright(slot, greatest(bits - 10, 0))"))
    counts = slots.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = slots.hint("shuffle_merge").join(counts.select("key", "stretch", offset.alias("offset")), ["key", "stretch"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(Window.partitionBy("key", "stretch").orderBy("slot")) - 1
    )
    b, left = F.col("rank") % F.col("blocks"), F.when(F.expr("rank div blocks") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return ranked.select("slot", "key", "rank", b.alias("block"), F.expr("rank div blocks").alias("pass"), F.least(F.lit(block), left - b * block).alias("words"))


def placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with source_size, target and start, the position of its first word in its source's
    shuffled stream. The shuffle is the order of md5(doc_id), or of the text's where there is no id."""
    chunk = F.substring("shuffle", 1, CHUNK_HEX)
    sums = sized.groupBy("key", chunk.alias("chunk")).agg(F.sum("size").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = sums.select("key", "chunk", offset.alias("offset")).join(targets, "key")
    inside = Window.partitionBy("key", "chunk").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("chunk", chunk)
        .join(chunks.hint("shuffle_merge"), ["key", "chunk"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes of it), slots (for each
    pass over its source that takes words of it, the first slot of the schedule that does).

    Null text has size 0 and is never taken; null sources are one source, the last; rows without an id are
    shuffled by their text. Repeated rows are separate documents with neighbouring places; which of two
    equal rows comes first changes nothing. Empty input gives no rows. Extra columns are ignored.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    sized = materialise(
        docs.select(
            "doc_id",
            source_key(source).alias("key"),
            word_count(text_or_empty()).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))).alias("shuffle"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, share)
    used = schedule(targets, block).groupBy("key", "block").agg(F.collect_list(F.struct("slot", "pass", "words")).alias("uses"))
    rows = placed(sized, targets)
    row = F.struct("doc_id", "size", "source_size", "target").alias("row")
    pieces = rows.filter("size > 0").select(
        row, "key", "start", "shuffle", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1L) div {block}L)")).alias("block")
    )
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.col("start") + F.col("row.size") - F.col("block") * block
    words = lambda use: F.greatest(F.least(high, use["words"]) - low, F.lit(0))
    got = F.aggregate("uses", F.lit(0).cast("long"), lambda acc, use: acc + words(use))

    def first(k: int) -> Column:
        return F.array_min(F.transform(F.filter("uses", lambda use: (use["pass"] == k) & (words(use) > 0)), lambda use: use["slot"]))

    taken = (
        pieces.join(used.hint("shuffle_merge"), ["key", "block"], "left")
        .groupBy("row", "key", "start").agg(F.sum(F.coalesce(got, F.lit(0))).alias("taken"), F.array_compact(F.array(*[F.min(first(k)) for k in range(MOST + 1)])).alias("slots"))
        .select("row.*", F.col("taken").cast("long").alias("taken"), "slots")
    )
    nothing = rows.filter("size = 0").select(row).select("row.*", F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"))
    return taken.unionByName(nothing)


def mixed(docs: DataFrame, block: int = BLOCK, position: str | None = None) -> DataFrame:
    """docs, all columns, each as often as the mix takes it to the nearest whole copy (0, 1 or 2 times).

    position: the name of one more column, the copy's slot; rows in its order are mixed evenly throughout. Only the
    document at the end of a source's last, partial pass is taken in part. Rows equal in id and size share their
    copies by rank, in the order of a hash of their columns.
    """
    size = word_count(text_or_empty())
    alike = Window.partitionBy("__id", "__none", "__size")
    name = lambda: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none")]
    keys = ["__id", "__none", "__size", "__rank"]
    taken = mix(docs, block).select(*name(), F.col("size").alias("__size"), "taken", F.col("slots").alias("__slots"))
    copies = F.when(F.col("__size") > 0, F.expr("(2 * taken + __size) div (2 * __size)")).otherwise(0)
    taken = taken.withColumn("__rank", F.row_number().over(alike.orderBy("taken", "__slots")))
    taken = taken.select(*keys, "__slots", copies.cast("int").alias("__copies")).filter("__copies > 0")
    rows = docs.select(*docs.columns, *name(), size.alias("__size"), F.xxhash64(*docs.columns).alias("__row"))
    rows = rows.withColumn("__rank", F.row_number().over(alike.orderBy("__row")))
    out = rows.join(taken.hint("shuffle_merge"), keys).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.select(*docs.columns, *([F.get("__slots", F.col("__copy")).alias(position)] if position else []))
