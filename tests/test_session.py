import random

from pyspark.sql import functions as F

from dupscape.session import fits_broadcast, materialize, ranked, spread, width


def test_ranked(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(5) if i % 7 else None) for i in range(200)]
    out = ranked(spark.createDataFrame(data, "i bigint, v bigint"), [F.desc_nulls_last("v"), F.asc("i")])
    want = sorted(data, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
    assert [r.i for r in out.orderBy("position").collect()] == [i for i, _ in want] and {r.position for r in out.collect()} == set(range(1, 201))
    assert ranked(spark.createDataFrame([], "i bigint"), [F.asc("i")]).count() == 0


def test_sizes(spark):
    df = spark.range(10)
    assert fits_broadcast(df, 10) and not fits_broadcast(df, 9) and width(spark) >= 4
    assert spread(materialize(df.coalesce(1), "one")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
