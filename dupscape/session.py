"""Session settings, shared scratch storage and size checks used by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings for sessions that this package starts itself; a caller's session is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def start(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the package's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("dupscape")
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, the context's own checkpoint folder serves; only without either (tests, one machine) a
    temporary folder takes their place, and becomes the context's.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="dupscape-")
    if given.isEmpty():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    return f"{shared_dir(spark).rstrip('/')}/dupscape/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application materialized; call it when no result that builds on it is needed any more."""
    drop_path(spark, f"{shared_dir(spark).rstrip('/')}/dupscape/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so it works for any shared store."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, read no further than one row beyond the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that feeds expensive per-row work: the session's own shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a scan over at least one partition per core; a scan of enough files is left as it is.

    Only for DataFrames read from files: counting partitions plans the scan and runs nothing.
    """
    df = df.select(*columns) if columns else df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's position from 1 on in a total order, without bringing all rows into one task.

    Rows are parted by ranges of the order, numbered in each part, and moved on by the sizes of the parts before; the
    sizes, one number a part, are the only thing that the driver sees.
    """
    spark = df.sparkSession
    parted = materialize(df.repartitionByRange(width(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r._part, r.n) for r in parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total).cast("bigint")]
        total += n
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint")
    offset = F.try_element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0)
    return parted.withColumn(name, number + F.coalesce(offset, F.lit(0))).drop("_part")
