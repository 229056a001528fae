"""Exact duplicates: equal size, equal sample, equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscape.session import ranked

#: Bytes of one sampled block; larger files than three of them are sampled at their start, middle and end.
BLOCK = 65_536


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sample_hash(content: Column, block: int = BLOCK) -> Column:
    """Hash of three blocks of a large content, of the whole of a small one."""
    size = F.octet_length(content)
    three = F.concat(F.substring(content, 1, block), F.substring(content, F.floor(size / 2).cast("int") + 1, F.lit(block)), F.substring(content, size - block + 1, F.lit(block)))
    return F.when(size > 3 * block, F.sha2(three, 256)).otherwise(F.sha2(content, 256))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once. Counts are pre-aggregated; a key of very many rows is never in one window."""
    again = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(again, keys, "left_semi")


def size_candidates(files: DataFrame) -> DataFrame:
    return repeated(files, ["size"])


def sample_candidates(files: DataFrame, content: str = "content", block: int = BLOCK) -> DataFrame:
    """Files that share size and sample with another, with ``sample``. Content is hashed in the scan and never shuffled."""
    sampled = files.withColumn("sample", sample_hash(F.col(content), block)).drop(content)
    return repeated(sampled, ["size", "sample"])


def hashed_candidates(files: DataFrame, content: str = "content", block: int = BLOCK) -> DataFrame:
    """Files that share size, sample and ``full_hash`` with another.

    Content that is a column is read by the scan anyway, and hashing it there costs less than a shuffle of it would;
    so the scan gives both hashes, and the steps run over narrow rows. Where each read costs, over real files, the
    pipeline of :mod:`dupscape.plans.engine` hashes only what the step before left.
    """
    hashed = files.withColumn("sample", sample_hash(F.col(content), block)).withColumn("full_hash", content_hash(F.col(content))).drop(content)
    return repeated(hashed, ["size", "sample", "full_hash"])


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """``(full_hash, size, file_count, reclaimable_bytes)`` of contents that several files hold."""
    sums = hashed.where("full_hash is not null").groupBy("full_hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("file_count")).where("file_count > 1")
    return sums.withColumn("reclaimable_bytes", (F.col("file_count") - 1) * F.col("size"))


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Position of each group, most reclaimable first; a total order of groups, for paging."""
    return ranked(groups, [F.desc("reclaimable_bytes"), F.asc("full_hash")])


def summary(hashed: DataFrame) -> DataFrame:
    """One row: groups, files in them, bytes that may be freed."""
    return duplicate_groups(hashed).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes")
    )


def reuse_hashes(files: DataFrame, cache: DataFrame, keys: list[str], stamp: list[str], hashes: list[str]) -> DataFrame:
    """``files`` with the cached ``hashes`` where the stamp is unchanged (null equals null), else null."""
    old = cache.select(*keys, F.struct(*stamp).alias("_old"), *[F.col(h).alias(f"_{h}") for h in hashes]).dropDuplicates(keys)
    joined = files.join(old, keys, "left")
    return joined.withColumns({h: F.when(F.struct(*stamp) == F.col("_old"), F.col(f"_{h}")) for h in hashes}).drop("_old", *[f"_{h}" for h in hashes])
