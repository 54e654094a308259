"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of any ordered type as (node, comp), comp the smallest node of its component.

    Alternating large-star and small-star rounds; each round's links are a written table. Only counts
    reach the driver. Minima are formed before the shuffle and joined back by node, so that the links
    of one hot node can be split.
    """
    e = written(links.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "links")
    while True:
        both = e.union(e.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v"))
        e = written(small.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "links")
        # Done when each node has one link, to a node that has none: all components are stars.
        ends = e.selectExpr("u as x", "1 as out", "0 as into").union(e.selectExpr("v as x", "0 as out", "1 as into"))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty():
            break
    return e.selectExpr("u as node", "v as comp").union(e.selectExpr("v as node", "v as comp").distinct())
