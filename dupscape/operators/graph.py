"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.operators.skew import skewed_join
from dupscape.session import drop_path, scratch


#: Links of one vertex that a task takes without being spread.
FEW = 100_000


def _joined(links: DataFrame, values: DataFrame, hubs: bool) -> DataFrame:
    return skewed_join(links, values, ["u"], ["v"], block=FEW) if hubs else links.join(values, "u")


def connected_components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``(member, component)``: every end of an edge and the smallest value it is linked with, directly or not.

    Null ends link nothing; an edge between equal values makes a component of one. Each round is two aggregations; the
    rounds end when no link changes, about a logarithm of the longest chain. The links of a hub, which every large
    component ends in, are spread over tasks. State lies in the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("member"), F.col("u").alias("component"))
    links = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, old = None, []
    while True:
        path = scratch(spark, "links")
        links.write.parquet(path)
        links = spark.read.schema(links.schema).parquet(path)
        check = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for p in old:
            drop_path(spark, p)
        old = [path]
        if seen == (check.n, check.h) or not check.n:
            break
        seen = (check.n, check.h)
        # large star: the larger neighbours of a vertex are linked with the least of the vertex and all its neighbours;
        # its link with a smaller neighbour is seen from there
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # with fewer links than a task may hold there is no hub to look for
        hubs = 2 * check.n > FEW
        large = _joined(both.where("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if hubs:
            path = scratch(spark, "large")
            large.write.parquet(path)
            large, old = spark.read.schema(large.schema).parquet(path), [*old, path]
        # small star: the smaller neighbours of a vertex, and the vertex, are linked with their least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, low, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    found = links.groupBy(F.col("u").alias("member")).agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("member"), "component").distinct()
    linked = found.unionByName(roots)
    return linked.unionByName(loops.distinct().join(linked.select("member"), "member", "left_anti"))
