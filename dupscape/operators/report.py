"""Reports of exact groups as CSV and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Report columns, in the two layouts.
HEADER = "group_hash,path,size_bytes,modified_at,network_volume"
OTHER_HEADER = "hash,path,size_bytes,modified_utc,network"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(members: DataFrame, upper: bool = False) -> DataFrame:
    """``(line)`` per member of a group of two or more: the path always quoted, times ISO 8601, nothing for null.

    ``members`` has ``full_hash, path, size, modified_at, is_network``; ``upper`` gives the other layout's capital digits.
    """
    again = members.groupBy("full_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("full_hash")
    rows = members.join(again, "full_hash", "left_semi")
    when = F.coalesce(F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    key = F.upper("full_hash") if upper else F.col("full_hash")
    return rows.select(F.concat_ws(",", key, _quoted(F.col("path")), F.coalesce(F.col("size").cast("string"), F.lit("")), when, F.coalesce(F.col("is_network").cast("string"), F.lit(""))).alias("line"))


def write_csv(members: DataFrame, folder: str, upper: bool = False) -> None:
    """CSV part files with a header line in each; sorted within files by line."""
    header = OTHER_HEADER if upper else HEADER
    split = F.split_part(F.col("line"), F.lit("\n"), F.lit(1))
    csv_lines(members, upper).select(split.alias(header)).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\x01").csv(folder)


def json_rows(members: DataFrame, most: int = 10_000) -> DataFrame:
    """``(full_hash, json)``: one JSON object a group, its files sorted by path.

    A group of more than ``most`` files comes in parts, numbered from 0, so that no task ever holds a larger list than
    about that; every part states the whole group's sums.
    """
    sums = members.groupBy("full_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("size").alias("_size")).where("_n > 1").withColumn("parts", F.ceil(F.col("_n") / most).cast("int"))
    rows = members.join(sums, "full_hash").withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    file = F.struct("path", "size", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), "is_network")
    groups = rows.groupBy("full_hash", "part", "parts", "_n", "_size").agg(F.sort_array(F.collect_list(file)).alias("files"))
    whole = F.struct("files", F.col("_n").alias("file_count"), "full_hash", "part", "parts", ((F.col("_n") - 1) * F.col("_size")).alias("reclaimable_bytes"))
    return groups.select("full_hash", F.to_json(whole).alias("json"))


def write_json(members: DataFrame, folder: str) -> None:
    json_rows(members).select("json").write.mode("overwrite").text(folder)
