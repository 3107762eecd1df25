"""Connected components of links between documents, by alternating stars.

Each round rewrites the links so that every document points at the smallest
document it knows of; the number of rounds grows with the logarithm of the
longest path. The rounds end when all links are stars: each document points at one
that points at none. Links stay in tables; the driver only learns whether any isn't
settled. Minima are written before they are joined, so that both sides of a join are
plain exchanges and a document with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for each document of links (a, b) that isn't the smallest of its component.

    Nulls, links of a document to itself and repeats of a link are ignored; an empty table gives an empty one.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct(), label)
    for _ in range(rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.lit(1).alias("low")), F.struct(F.col("m").alias("u"), F.lit(0).alias("low")))).alias("e"))
        if ends.groupBy("e.u").agg(F.sum("e.low").alias("n"), F.min("e.low").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty():
            break
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = written(both.groupBy("u").agg(F.min("w").alias("m")), label)
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.least("m", "u").alias("m")).distinct()
        large = written(large, label)
        low = written(large.groupBy("v").agg(F.min("m").alias("low")), label)
        small = large.join(low, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        now = written(small.unionByName(low.select("v", F.col("low").alias("m"))).distinct(), label)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
