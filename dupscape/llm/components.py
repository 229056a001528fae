"""One group identifier for all records linked directly or through others.

Low-diameter decomposition (Miller, Peng and Xu): every vertex draws an exponential shift; those with large shifts
start first and their clusters grow by one edge a round, so that clusters have small diameter and few edges run
between them. Clusters are contracted to super-vertices, edges inside them vanish, and the decomposition recurses on
the edges between clusters until none is left. Composing the assignments of all levels gives each vertex its component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscape.operators.skew import crowded, skewed_join
from dupscape.session import drop_path, materialize, scratch


#: Edges of one vertex, or members of one component, that meet in one task.
HUB = 100_000


def start(vertex: Column, level: int, mean: float) -> Column:
    """Start of a vertex's own cluster: an exponential shift of the given mean before time 0, drawn from a hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level), F.lit(7)), 11) + F.lit(1)) / F.lit(float(1 << 53))
    return F.log(uniform) * F.lit(mean)


def _kept(df: DataFrame, label: str, old: list[str]) -> DataFrame:
    """``df`` in the shared folder; its path joins ``old``."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    old.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decompose(edges: DataFrame, level: int, rounds: int, mean: float, few: bool = False) -> DataFrame:
    """``(v, c)``: each vertex of the symmetric, loop-free ``edges(a, b)`` with the centre of its cluster.

    A vertex joins the centre whose cluster reaches it first, or founds its own where its start comes before; clusters
    grow for ``rounds`` steps, which bounds their diameter. ``few`` edges, no more than a task may hold, have no hub.
    """
    label = edges.select(F.col("a").alias("v")).distinct()
    # an edge takes an arrival one step on; a vertex keeps its own with no step, so a round reads the labels once
    steps = edges.withColumn("d", F.lit(1.0)).unionByName(label.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("d")))
    # the edges of a hub are spread over tasks, the same ones in every round; its label goes to each of them
    hubs = None if few else crowded(edges, ["a"], HUB)
    if hubs is not None:
        hubs = F.broadcast(hubs.select("a", F.ceil(F.col("_n") / HUB).cast("int").alias("salts")))
        steps = steps.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    label = label.select("v", start(F.col("v"), level, mean).alias("s"), F.col("v").alias("c"))
    for _ in range(rounds):
        # (arrival, centre): the least wins, pre-aggregated before the shuffle, so a hub's neighbours never meet in one task
        own, on = label, steps.a == label.v
        if hubs is not None:
            own = label.join(hubs.withColumnRenamed("a", "v"), "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            on = (steps.a == own.v) & (steps.salt == own.part)
        offers = steps.join(own, on).select("b", F.struct((F.col("s") + F.col("d")).alias("s"), "c").alias("best"))
        label = offers.groupBy(F.col("b").alias("v")).agg(F.min("best").alias("best")).select("v", "best.s", "best.c")
    return label.select("v", "c")


def component_ids(edges: DataFrame, rounds: int = 3, mean: float = 3.0, growth: float = 1.5) -> DataFrame:
    """``(v, root)`` for all vertices of ``edges(a, b)`` (bigint): equal roots if and only if linked.

    Rows with a null end are no links and do not make a vertex; loops make a vertex, and repeated or turned edges count
    once. Levels are not bounded: each contracts every cluster of two or more vertices, so the edges run out. A level
    reads only the edges between the last level's clusters, and larger mean shifts (by ``growth`` a level) cut fewer; hubs are pre-aggregated by the distinct and min above
    shuffles, and all state lies in the shared folder, so a lost executor costs a retry.
    """
    spark = edges.sparkSession
    old: list[str] = []
    whole = edges.where("a is not null and b is not null")
    vertices = materialize(whole.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "vertices")
    both = whole.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    links = _kept(both.distinct(), "edges", old)
    assigned, level = [], 0
    while n := links.count():
        few = n <= HUB
        join = DataFrame.join if few else lambda x, y, on: skewed_join(x, y, [on], ["b" if on == "a" else "a"], block=HUB)
        assigned.append(materialize(decompose(links, level, rounds, mean * growth**level, few), "level"))
        own = assigned[-1]
        left, right = own.select(F.col("v").alias("a"), F.col("c").alias("x")), own.select(F.col("v").alias("b"), F.col("c").alias("y"))
        between = join(join(links, left, "a"), right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        done, old = old, []
        links = _kept(between, "edges", old)
        for path in done:
            drop_path(spark, path)
        level += 1
    # composed from the last level, the smallest, so that each join meets the next larger assignment once
    roots = None
    for own in reversed(assigned):
        if roots is None:
            roots = own.select("v", F.col("c").alias("root"))
        else:
            up = roots.withColumnRenamed("v", "c")
            roots = materialize(own.join(up, "c", "left").select("v", F.coalesce("root", "c").alias("root")), "roots")
    if roots is None:
        return vertices.select("v", F.col("v").alias("root"))
    return vertices.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def linked_groups(pairs: DataFrame, first: str, second: str, **options) -> DataFrame:
    """``(member, group)``: every value in at least one pair of two different values, and the smallest value linked with it.

    Values compare by their UTF-8 bytes, as stored. A pair with a null end or two equal ends links nothing and adds no
    member. Values get exact numbers first, so that rounds carry 16 bytes an edge whatever the values' length.
    """
    good = materialize(pairs.select(F.col(first).alias("x"), F.col(second).alias("y")).where("x is not null and y is not null and x <> y").distinct(), "pairs")
    names = materialize(good.select(F.explode(F.array("x", "y")).alias("name")).distinct().withColumn("v", F.monotonically_increasing_id()), "names")
    edges = good.join(names.select(F.col("name").alias("x"), F.col("v").alias("a")), "x").join(names.select(F.col("name").alias("y"), F.col("v").alias("b")), "y").select("a", "b")
    roots = component_ids(edges, **options)
    named = materialize(names.join(roots, "v").select("name", "root"), "named")
    least = named.groupBy("root").agg(F.min("name").alias("group"))
    return skewed_join(named, least, ["root"], ["name"], block=HUB).select(F.col("name").alias("member"), "group")
