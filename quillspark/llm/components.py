"""Connected components of a graph given as links, by repeated contraction; nothing but counts reaches the driver.

In each round every node takes the neighbour (itself included) that is first in the order of a hash, links are
rewritten to what their ends took, and links within one node go. The hash order makes each round remove a constant
share of the nodes in expectation, so rounds grow as the logarithm of the largest component. Each round's links and
labels are written to the shared checkpoint folder, so a lost executor costs one round at most. Minima are
combined before the shuffle, and joins on a hot node are left to the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def with_smallest(rooted: DataFrame, low: str, out: str, salts: int = 16) -> DataFrame:
    """rooted (node, root, ...) with the smallest `low` of each root. The minima are combined before the shuffle and go
    out `salts` times, so the rows of a large component come to as many tasks."""
    lows = rooted.groupBy("root").agg(F.min(low).alias(out)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rooted.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    return salted.join(lows, ["root", "_salt"]).drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is a node of its component, the same for all its nodes. Nulls are no nodes."""
    first = lambda c: F.min(F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v")))
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        took = both.groupBy(F.col("a").alias("u")).agg(first("b").alias("m"))
        took = cut(took.select("u", F.least(F.col("m"), F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")))["v"].alias("r")))
        if labels is None:
            labels = took.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            labels = labels.join(took, labels["root"] == took["u"], "left").select("node", F.coalesce("r", "root").alias("root"))
        ra, rb = took.select(F.col("u").alias("a"), F.col("r").alias("ra")), took.select(F.col("u").alias("b"), F.col("r").alias("rb"))
        edges = edges.join(ra, "a").join(rb, "b").where(F.col("ra") != F.col("rb"))
        edges = cut(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        labels = cut(labels)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
