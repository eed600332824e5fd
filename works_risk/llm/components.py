"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.operators.lookup import attach
from works_risk.session import scratch


class Forest:
    """Union-find over few local numbers, for the links one task has seen."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Join two trees under the smaller root; false where they were one."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node hands the smallest of its neighbours and itself to its larger (or its smaller) neighbours."""
    if large:
        sides = links.union(links.select("lo", "hi")).toDF("u", "v")  # each link from both ends
    else:
        sides = links.toDF("u", "v")  # u is the larger
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = attach(sides, _written(least, "star-least"), "u", F.xxhash64("u", "v"))
    if large:
        made = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        ends = F.explode(F.array("u", "v"))
        made = met.select(ends.alias("hi"), F.col("m").alias("lo"))
    return _written(made.filter(F.col("hi") != F.col("lo")).distinct(), "star-links")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component): the smallest node that each linked node reaches.

    Every round writes its links to the shared folder. A node with very many links is no task of its own.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = _written(links.filter(F.col("a") != F.col("b")).select(hi, lo).distinct(), "links")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).collect()[0]
        if found == mark or not found[0]:
            break
        mark = found
        now = _star(_star(now, True), False)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
