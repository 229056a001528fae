"""Joins that survive a key which holds a third of all rows: crowded keys are found first, and only they are spread.

The ``MOST`` largest keys are looked at, which bounds their table and makes it safe to collect and broadcast; any other
key holds at most one row in ``MOST``. Rows learn from it, before any shuffle of rows, over how many tasks their key is
spread. No row is dropped, and no other key can fill a task.

Finding crowded keys is a count with partial sums over the keys alone; the tables given should be files, not plans that
would be computed again for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of one key that meet all others in one task; the number of keys that can be crowded at most.
BLOCK, MOST = 256, 20_000


def crowded(df: DataFrame, keys: Sequence[str], block: int = BLOCK, most: int = MOST) -> DataFrame | None:
    """``(keys, _n)`` of the keys with more than ``block`` rows, the ``most`` largest of them, or None without any.

    A local table, from one count over the keys.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    rows = sizes.orderBy(F.desc("_n")).limit(most).collect()
    return df.sparkSession.createDataFrame(rows, sizes.schema) if rows else None


def _salt(rows: Sequence[str], salts: Column) -> Column:
    return F.pmod(F.xxhash64(*rows), salts).cast("int")


def _all_salts(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), salts - 1))


def skewed_join(facts: DataFrame, few: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner", block: int = 100_000) -> DataFrame:
    """``facts`` joined with ``few`` on ``keys``, of which ``facts`` may repeat one very often and ``few`` may not.

    The rows of a crowded key go to several tasks by a hash of ``spread_by``, and its rows of ``few`` to each of them.
    ``how`` is inner, left, left_semi or left_anti.
    """
    heavy = crowded(facts, keys, block)
    if heavy is None:
        return facts.join(few, list(keys), how)
    heavy = F.broadcast(heavy.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_salts")))
    left = facts.join(heavy, list(keys), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(_salt(spread_by, F.col("_salts")))).drop("_salts")
    right = few.join(heavy, list(keys), "left").withColumn("_salt", _all_salts(F.coalesce("_salts", F.lit(1)))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_rows(df: DataFrame, keys: Sequence[str], row: str, block: int = 100_000) -> DataFrame:
    """``df`` with ``salt`` and ``own``, for work on all rows of ``(keys, salt)`` at once.

    The rows of a crowded key come once for each of its salts, and are ``own`` in one of them, which holds ``block`` such
    rows or so; work that is done for own rows only, against all rows, is done once.
    """
    heavy = crowded(df, keys, block)
    if heavy is None:
        return df.select("*", F.lit(0).alias("salt"), F.lit(True).alias("own"))
    salts = F.broadcast(heavy.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_salts")))
    rows = df.join(salts, list(keys), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    return rows.withColumn("salt", _all_salts(F.col("_salts"))).withColumn("own", F.col("salt") == _salt([row], F.col("_salts"))).drop("_salts")


def salted_pairs(df: DataFrame, keys: Sequence[str], row: str, carry: Sequence[str] = (), block: int = BLOCK, most: int = MOST) -> DataFrame:
    """All pairs of rows that agree in ``keys``, as columns ``<name>_a`` and ``<name>_b`` with ``row_a < row_b``.

    The left rows of a key with n rows are spread over ceil(n / block) salts and the right rows repeated for each, so
    that no task holds more than ``block`` left rows of a key. Crowded keys get their salts from a broadcast before the
    first shuffle of rows; the others hold at most one row in ``most`` and get them from a join, which also drops keys
    of one row. Rows with a null key never pair; nothing is dropped.
    """
    keys, names = list(keys), [row, *carry]
    rows = df.select(*keys, *names).where(" and ".join(f"`{k}` is not null" for k in keys))
    salts = F.ceil(F.col("_n") / block).cast("int").alias("_salts")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, salts)
    heavy = crowded(rows, keys, block, most)
    if heavy is None:
        counted = rows.join(sizes, keys)
    else:
        marked = rows.join(F.broadcast(heavy.select(*keys, salts)), keys, "left")
        counted = marked.where("_salts is null").drop("_salts").join(sizes, keys).unionByName(marked.where("_salts is not null"))
    left = counted.select(*keys, _salt([row], F.col("_salts")).alias("_salt"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = counted.select(*keys, _all_salts(F.col("_salts")).alias("_salt"), *[F.col(c).alias(f"{c}_b") for c in names])
    return left.join(right, [*keys, "_salt"]).where(F.col(f"{row}_a") < F.col(f"{row}_b")).drop("_salt")
