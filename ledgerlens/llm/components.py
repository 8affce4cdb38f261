"""Connected components of a pair table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or those not larger and itself) to its smallest."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    else:   # seen from the larger end
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    linked = both.join(least, "node")
    if larger:
        out = linked.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        out = (linked.select(F.col("other").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node reachable.

    ``edges``: columns a, b of one orderable type. Null ends and loops are left out. Each round is
    written to the shared folder, so no round is computed twice and executors may be lost; rounds
    grow with the logarithm of the longest path.
    """
    now = stored(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        now = stored(_star(_star(now, True), False), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and tuple(mark) == before:
            break
        before = tuple(mark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
