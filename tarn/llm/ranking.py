"""Ranked lexical search by TPUT (three phases, uniform threshold) over term-partitioned postings.

The index has a list for each term that the items hold, sorted by impact, which is what an occurrence adds for each unit
of the term's weight; a long list goes over several partitions. Texts of equal terms in equal order are one posting
with their number of copies, so a crowd of copies is ranked once.

1. The first HEAD postings of each list give partial scores; the exact scores of the texts that lead an item's give a lower
   bound of its last result.
2. With m lists and a threshold of T, a text that no list gives T or more has less than m * T. T is half of bound / m: every list
   hands over what adds that much or more to an item. Postings are dealt by text once, whatever the number of items that
   read them, and added up where they are. A text stays if its sum and T for each list that has not handed it over reach the bound.
3. The sums raise the bound, and the exact scores of the texts that still reach it are looked up in all lists.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches

#: Results of an item, and postings of a list's head.
TOP, HEAD = 10, 100
#: What stands between terms: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are counted at once.
SLICE = 1 << 18
_COUNTED = "term string, b0 long, b1 long, n long, tf long, id long"
_BAG = ["b0", "b1"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE bytes of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield batch.slice(low, high - low)
        low = high


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to a row for each term of a text (b0, b1: 128 bits of a hash of its terms in order, n: their number, tf: the
    term's occurrences) and one for the text itself (null term). A text without terms has no rows."""
    for batch in itertools.chain.from_iterable(map(_slices, batches)):
        lower = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
        terms = pc.utf8_trim(pc.replace_substring_regex(lower, BETWEEN, " "), " ")
        split = pc.split_pattern(terms, " ")
        row, term = pc.list_parent_indices(split), pc.list_flatten(split)
        some = pc.not_equal(term, "")
        pairs = pa.table({"row": row.filter(some), "term": term.filter(some)})
        counts = pairs.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
        n = np.bincount(pairs.column("row").to_numpy(), minlength=batch.num_rows)
        digests = b"".join(xxhash.xxh3_128_digest(t.as_buffer()) for t in terms)
        bags = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
        whole = np.nonzero(n)[0]
        at = np.concatenate([whole, counts.column("row").to_numpy()])
        names = pa.concat_arrays([pa.nulls(len(whole), pa.string()), *counts.column("term").chunks])
        tf = np.concatenate([np.zeros(len(whole), dtype=np.int64), counts.column("count_all").to_numpy()])
        columns = [names, pa.array(bags[at, 0]), pa.array(bags[at, 1]), pa.array(n[at]), pa.array(tf), batch.column(0).take(pa.array(at))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "b0", "b1", "n", "tf", "id"])
        pa.default_memory_pool().release_unused()


def impact(texts: int, terms: int) -> Column:
    """What tf occurrences in a text of n terms add for each unit of weight, among so many texts and terms."""
    m = f"100 - 75 + (75 * n * {texts}L) div {max(terms, 1)}L"
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * ({m}))")


def weight(texts: int) -> Column:
    """A term's weight by df, the number of texts that hold it."""
    return F.floor(1000 * F.log(F.lit(float(2 * texts + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")


def _leaders(partial: DataFrame, score: str, top: int) -> DataFrame:
    """The rows of each item with the top largest scores, as many as there are."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score), *_BAG))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")


def _bounds(partial: DataFrame, score: str, top: int) -> DataFrame:
    """item and bound, the top-th largest score, 0 if there are fewer."""
    bound = F.when(F.count(F.lit(1)) == top, F.min(score)).otherwise(0).alias("bound")
    return _leaders(partial.select("item", *_BAG, score), score, top).groupBy("item").agg(bound)


def indexed(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(postings, members, texts): term, bag (b0 and b1), impact, copies and place of the postings of the given terms, written in order
    of term and falling impact (places ascend); bag and doc_id of every document with a term; the number of these."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(counted, _COUNTED)
    rows = rows.join(terms.withColumn("known", F.lit(True)), "term", "left").filter(F.col("term").isNull() | F.col("known"))
    rows = materialise(rows.drop("known"), "terms")
    whole = rows.filter(F.col("term").isNull())
    texts, length = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    once = rows.filter(F.col("term").isNotNull()).groupBy("term", *_BAG).agg(F.max("n").alias("n"), F.max("tf").alias("tf"), F.count(F.lit(1)).alias("copies"))
    once = once.select("term", *_BAG, impact(texts, length).alias("impact"), "copies")
    order = [F.col("term"), F.desc("impact"), *map(F.col, _BAG)]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = once.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return materialise(lists, "postings"), whole.select(*_BAG, F.col("id").alias("doc_id")), texts


def looked_up(some: DataFrame, lists: DataFrame, postings: DataFrame) -> DataFrame:
    """item, bag and score, the exact one, of some items and bags."""
    bags = materialise(some.select(*_BAG).distinct(), "bags")
    own = postings.select("term", *_BAG, "impact").join(bags, _BAG, "left_semi")
    wanted = some.select("item", *_BAG).join(lists.select("item", "term", "weight"), "item")
    return own.join(wanted, ["term", *_BAG]).groupBy("item", *_BAG).agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def best(postings: DataFrame, lists: DataFrame, top: int = TOP) -> DataFrame:
    """item, bag, score: of each item the texts whose exact score is among its top largest, ties included.

    lists: item, term, weight (above 0) and first (the place of the list's first posting), once for each list that an item reads.
    """
    lists = materialise(lists, "lists")
    firsts = materialise(lists.select("term", "first").distinct(), "firsts")
    heads = postings.join(firsts, "term").filter(F.col("place") - F.col("first") < HEAD).select("term", *_BAG, "impact")
    partial = heads.join(lists, "term").groupBy("item", *_BAG).agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))
    leading = looked_up(materialise(_leaders(partial, "part", 2 * top), "leaders"), lists, postings)
    sizes = lists.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    limits = sizes.join(_bounds(leading, "score", top), "item").withColumn("least", F.expr("greatest(1, (bound + 2 * m - 1) div (2 * m))"))
    limits = materialise(limits, "limits")
    reads = materialise(lists.join(limits, "item").select("term", "item", "weight", F.expr("(least + weight - 1) div weight").alias("floor")), "reads")
    floors = materialise(reads.groupBy("term").agg(F.min("floor").alias("lowest")), "floors")
    handed = postings.select("term", *_BAG, "impact").join(floors, "term").filter(F.col("impact") >= F.col("lowest")).drop("lowest").repartition(*_BAG)
    handed = handed.join(reads, "term").filter(F.col("impact") >= F.col("floor"))
    partial = handed.groupBy("item", *_BAG).agg(F.sum(F.col("weight") * F.col("impact")).alias("part"), F.count(F.lit(1)).alias("met"))
    reach = (F.col("part") + (F.col("m") - F.col("met")) * (F.col("least") - 1)).alias("reach")
    partial = partial.join(limits, "item").select("item", *_BAG, "part", reach, "bound").filter("reach >= bound").drop("bound")
    partial = materialise(partial, "partial")
    stay = materialise(partial.join(_bounds(partial, "part", top), "item").filter("reach >= bound").select("item", *_BAG), "candidates")
    scores = looked_up(stay, lists, postings).filter("score > 0")
    place = F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: of each item its highest-scoring documents, those above 0.

    Equal scores ascend by doc_id, null ids last. Null or empty texts have no terms: such documents are not counted,
    such items have no results. Every row of items is an item, every row of docs a document, repeated ones too.
    Columns besides doc_id, item_id and text are not looked at. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    items = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    asked = materialise(items.select("item", "text").mapInArrow(counted, _COUNTED).filter(F.col("term").isNotNull()).select(F.col("id").alias("item"), "term", F.col("tf").alias("times")), "asked")
    postings, members, texts = indexed(docs, materialise(asked.select("term").distinct(), "vocabulary"))
    known = postings.groupBy("term").agg(F.sum("copies").alias("df"), F.min("place").alias("first"))
    known = known.select("term", weight(texts).alias("weight"), "first")
    lists = asked.join(known, "term").select("item", "term", (F.col("times") * F.col("weight")).alias("weight"), "first").filter("weight > 0")
    found = materialise(best(postings, lists, top), "best")
    own = Window.partitionBy(*_BAG).orderBy(F.col("doc_id").asc_nulls_last())
    of_bags = members.join(found.select(*_BAG).distinct(), _BAG).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), *_BAG))
    ranked = found.join(of_bags, _BAG).withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
