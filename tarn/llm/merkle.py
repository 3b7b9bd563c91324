"""A Merkle manifest of a table: a leaf for each row, a tree for each language, one root over all.

Levels are collapsed by higher-order functions on arrays. A run's nodes are dealt, in order, into blocks of BLOCK; a
block's array is folded level by level (`sequence`, `transform`, `slice`, `aggregate`) until one node is left, which is
a node of the next, BLOCK times smaller, table; that table is collapsed likewise, until each run has one node. BLOCK is
a power of two, so a block's node is the tree's own node of that level. Proofs are handed down the same tables: a
block's siblings above it are joined to the block, not to its leaves.

A row's place in its run is the sum of what comes before it: rows are sorted in ranges of (run, order), ranges are
counted, and a window adds up the counts only. So no task holds a run, however many rows one language has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialise

#: Nodes of a block, a power of two.
BLOCK = 256
#: One row in so many, by checksum of its id, is tampered with.
TAMPERED = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ordered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (run, columns) with `at`, the place of each row in its run by the order columns, from 0. Ties between
    rows that are equal in all of them are broken by where they were read."""
    rows = nodes.withColumn("read_", F.monotonically_increasing_id())
    keys = ["run", *order, "read_"]
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id()).drop("read_")
    rows = materialise(rows.withColumn("range_", F.shiftright("row_", 33)), "ordered")
    counts = rows.groupBy("run", "range_").agg(F.count(F.lit(1)).alias("n_"), F.min("row_").alias("first_"))
    before = Window.partitionBy("run").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("run", "range_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("start_"))
    return rows.join(starts, ["run", "range_"]).withColumn("at", F.col("row_") + F.col("start_")).drop("row_", "range_", "start_")


def collapsed(level: Column) -> Column:
    """The next level of an array of nodes: the digest of every two consecutive ones, or of the last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.array_join(F.slice(level, 2 * i + 1, F.lit(2)), ""), 256))


def tree(leaves: Column, depth: Column) -> Column:
    """All levels of an array of nodes, `depth` of them above the array itself."""
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), lambda levels, _: F.concat(levels, F.array(collapsed(F.element_at(levels, -1)))))


def siblings(levels: Column, at: Column, depth: Column) -> Column:
    """Of the node at a place (from 0) of the lowest level: what stands left and right of its ancestors, per level."""

    def step(j: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(2), j)).cast("int")
        level = F.element_at(levels, j + 1)
        left = F.when(place % 2 == 1, F.get(level, place - 1))
        right = F.when(place % 2 == 0, F.get(level, place + 1))
        return F.struct(F.coalesce(left, F.lit("")).alias("l"), F.coalesce(right, F.lit("")).alias("r"))

    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, step)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda low, x: digest(x["l"], low, x["r"]))


def blocks(nodes: DataFrame, block: int) -> DataFrame:
    """run, block, levels, depth, nodes (array of at, node and other columns by place): whole blocks of nodes (run, at, node, ...)."""
    rest = [c for c in nodes.columns if c not in ("run", "at")]
    members = F.array_sort(F.collect_list(F.struct((F.col("at") % block).cast("int").alias("at"), *rest))).alias("nodes")
    dealt = nodes.groupBy("run", F.floor(F.col("at") / block).cast("long").alias("block")).agg(members)
    runs = dealt.groupBy("run").agg(F.max("block").alias("last"))
    height = (block - 1).bit_length()
    alone = F.ceil(F.log2(F.size("nodes"))).cast("int")
    depth = F.when(F.col("last") > 0, F.lit(height)).otherwise(alone)
    rows = dealt.join(runs, "run").withColumn("depth", depth)
    return materialise(rows.withColumn("levels", tree(F.transform("nodes", lambda x: x["node"]), F.col("depth"))).drop("last"), "blocks")


def climbed(nodes: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The tables of blocks of nodes (run, at, node and other columns), of their roots, and so on until each run has one."""
    tables = [blocks(nodes, block)]
    while tables[-1].agg(F.max("block")).first()[0]:
        above = tables[-1].select("run", F.col("block").alias("at"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        tables.append(blocks(above, block))
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """run and top, the one node that a run collapses to."""
    return tables[-1].select("run", F.element_at(F.element_at("levels", -1), 1).alias("top"))


def proofs(tables: list[DataFrame], roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The lowest table's nodes (run, at, node and other columns) with the columns of roots (run, path and others) of their
    run; path gets the siblings from the node up to its run's top before those that it has."""
    kept = [c for c in roots.columns if c not in ("run", "path")]
    up = roots.withColumn("block", F.lit(0).cast("long"))
    for low in reversed(tables):
        whole = low.join(up.select("run", "block", *kept, F.col("path").alias("above")), ["run", "block"])
        path = lambda x: F.concat(siblings(F.col("levels"), x["at"], F.col("depth")), F.col("above"))
        members = F.transform("nodes", lambda x: F.struct(x.alias("node"), path(x).alias("path")))
        rows = whole.select("run", "block", *kept, F.explode(members).alias("x"))
        columns = [c for c in low.schema["nodes"].dataType.elementType.names if c != "at"]
        place = (F.col("block") * block + F.col("x.node.at")).alias("block")
        up = rows.select("run", place, *kept, *[F.col(f"x.node.{c}").alias(c) for c in columns], F.col("x.path").alias("path"))
        kept = [*kept, *columns] if low is tables[0] else kept
    return up.withColumnRenamed("block", "at")


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot (of its language), root, proof_sha256 (digest of the siblings from leaf to root), folded_root
    (what the row as it is now and the siblings give), verified (whether that is the root).

    Rows of a language ascend by doc_id; null ids come first, equal ids by their leaf. Null is a language of its own,
    before all others. A seventh of the rows, by their id's checksum, are read as if n_chars were one more; a null
    n_chars stays null, so its row verifies, and a null id is never among them. Repeated rows have a leaf each. An
    empty table gives no rows; one row alone has no siblings and its leaf is the root. Other columns are not looked at.
    """
    fields = {c: F.col(c) for c in FIELDS}
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    leaf = lambda values: digest(*[field(values[c]) for c in FIELDS])
    run = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("run")
    rows = materialise(docs.select(run, "doc_id", leaf(fields).alias("node"), F.when(touched, leaf(more)).alias("now")), "leaves")
    low = climbed(ordered(rows, ["doc_id", "node"]), block)
    high = climbed(ordered(tops(low).select(F.lit("").alias("run"), F.col("run").alias("lang_run"), F.col("top").alias("node")), ["lang_run"]), block)
    over = proofs(high, tops(high).select("run", F.col("top").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path")), block)
    leaves = proofs(low, over.select(F.col("lang_run").alias("run"), F.col("node").alias("subroot"), "root", "path"), block)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    now = folded(F.coalesce("now", "node"), F.col("path"))
    found = leaves.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), now.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
