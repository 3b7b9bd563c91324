"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """For every u, the lowest of u and its partners."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node, root: the lowest node that each linked node reaches.

    links: u, v. Each step links nodes to lower ones of their neighbourhood until only stars are left;
    the number of steps is logarithmic in practice. A step is written to the shared folder, and only
    its row count and checksum come to the driver. Links of a node to itself are ignored.
    """
    links = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links"
    )
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = materialise(small.filter("u != v").distinct(), "links")
