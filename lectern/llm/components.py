"""Connected components of a table of links, by alternating large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

MAX_ROUNDS = 60


def _min_joined(links: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """links with `least` of their key. The second join key makes both sides shuffle for the join itself, so that AQE may split a hub's rows."""
    right = least.select(F.col("node").alias(key), "least", F.xxhash64("node").alias("_h"))
    return links.withColumn("_h", F.xxhash64(key)).join(right, [key, "_h"]).drop("_h")


def _settled(links: DataFrame) -> bool:
    """Whether all links form stars: no node has two lower neighbours, or one and a higher one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    degrees = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return degrees.filter("up + down > 1 and up > 0").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that links (a, b, both long, not null) name: root is the component's smallest node.

    Self-links and repeated links do no harm; no links give no rows. Minima combine before they are shuffled, and a
    round's links are never more than the first round's, so a component of any shape or size passes through.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = materialize(now, "cc-links")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionAll(now.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        nearest = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("least"))
        large = _min_joined(now, "lo", nearest).select("hi", F.col("least").alias("lo")).distinct()
        large = materialize(large, "cc-large")
        below = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = _min_joined(large, "hi", below).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("x"))
        now = materialize(small.select("x.hi", "x.lo").filter("hi <> lo").distinct(), "cc-links")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select("lo", "lo").distinct())
