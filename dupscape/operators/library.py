"""One library against another, and folders that are complete copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscape.paths import ancestors, parent, within_any
from dupscape.session import materialize


def cross_groups(hashed: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Members of contents held both inside and outside the reference folders, with ``in_reference``."""
    rows = hashed.where("full_hash is not null").withColumn("in_reference", within_any("path", reference))
    both = rows.groupBy("full_hash").agg(F.bool_or("in_reference").alias("a"), F.bool_or(~F.col("in_reference")).alias("b")).where("a and b").select("full_hash")
    return rows.join(both, "full_hash", "left_semi")


def unique_targets(hashed: DataFrame, reference: Sequence[str], incomplete: bool = False) -> DataFrame:
    """Files outside the reference whose content (size and hash) it does not hold; each path once.

    A file without a hash is never unique. If a reference file has no hash, or the scan is incomplete, nothing is claimed.
    """
    rows = hashed.withColumn("_a", within_any("path", reference)).dropDuplicates(["path"])
    held, rest = rows.where("_a"), rows.where("not _a and full_hash is not null").drop("_a")
    if incomplete:
        return rest.limit(0)
    unknown = held.where("full_hash is null").agg(F.count(F.lit(1)).alias("_unknown"))  # one row
    found = rest.join(held.select("size", "full_hash").distinct(), ["size", "full_hash"], "left_anti")
    return found.join(F.broadcast(unknown), F.lit(True)).where("_unknown = 0").drop("_unknown")


def ancestor_sums(files: DataFrame) -> DataFrame:
    """``(folder, total_bytes, file_count)`` over all files at any depth below each folder."""
    return files.select(F.explode(ancestors("path")).alias("folder"), "size").groupBy("folder").agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))


def framed(*parts: Column) -> Column:
    """Parts joined so that no two different lists of parts give the same text: each with its length in bytes before it."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def _tally(entry: Column, name: str) -> list[Column]:
    """A set of entries as the sums of the four 64-bit words of their SHA-256: adds up in any order and in parts, unlike a list.

    Names are unique in a folder, so entries are; equal sums of different sets need all four words to agree, each of
    which is as good as independent of the others.
    """
    hashed = F.sha2(entry, 256)
    return [F.sum(F.conv(F.substring(hashed, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"{name}{i}") for i in range(4)]


def _tallied(name: str) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(f"{name}{i}").cast("string"), F.lit("")) for i in range(4)])


def folder_digests(files: DataFrame, folders: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """``(folder, digest, total_bytes, file_count, complete)``: one digest of the whole tree below each folder.

    A digest covers the names, sizes and hashes of a folder's files and the names and digests of its folders, so that
    equal digests mean equal trees, empty folders included. ``folders(path)`` lists the folders; others have no digest and add
    nothing to those above. A folder is incomplete, and has no digest, if a file below has no hash or a folder below
    (``incomplete.path``) was not read. Levels are built from the deepest up, one aggregation each, and a folder's entries are
    summed, not listed, so a folder with very many files is pre-aggregated like any other.
    """
    known = folders.select(F.col("path").alias("folder")).distinct()
    known = materialize(known.withColumn("depth", F.when(F.col("folder") == "/", 0).otherwise(F.size(F.split("folder", "/")) - 1)), "folders")
    entry = framed(F.lit("f"), F.element_at(F.split("path", "/"), -1), F.col("size").cast("string"), F.coalesce("full_hash", F.lit("")))
    own = files.groupBy(parent("path").alias("folder")).agg(*_tally(entry, "f"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    bad = files.where("full_hash is null").select(F.explode(ancestors("path")).alias("folder"))
    if incomplete is not None:
        bad = bad.unionByName(incomplete.select(F.explode(F.array_append(ancestors("path"), F.col("path"))).alias("folder")))
    base = known.join(own, "folder", "left")
    base = base.join(bad.distinct().withColumn("bad", F.lit(True)), "folder", "left")
    base = materialize(base, "entries")
    deepest = base.agg(F.max("depth")).first()[0]
    levels, below = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = base.where(F.col("depth") == depth)
        if below is not None:
            child = framed(F.lit("d"), F.element_at(F.split("folder", "/"), -1), F.coalesce("digest", F.lit("")))
            sums = below.groupBy(parent("folder").alias("folder")).agg(*_tally(child, "d"), F.sum("total_bytes").alias("cb"), F.sum("file_count").alias("cn"), F.count(F.lit(1)).alias("dn"), F.bool_and("complete").alias("cc"))
            level = level.join(sums, "folder", "left")
        else:
            level = level.withColumns({**{f"d{i}": F.lit(None).cast("decimal(30,0)") for i in range(4)}, "cb": F.lit(None).cast("bigint"), "cn": F.lit(None).cast("bigint"), "dn": F.lit(None).cast("bigint"), "cc": F.lit(None).cast("boolean")})
        complete = F.coalesce("cc", F.lit(True)) & F.col("bad").isNull()
        digest = F.sha2(framed(_tallied("f"), F.coalesce("n", F.lit(0)).cast("string"), _tallied("d"), F.coalesce("dn", F.lit(0)).cast("string")), 256)
        below = materialize(
            level.select("folder", F.when(complete, digest).alias("digest"), (F.coalesce("bytes", F.lit(0)) + F.coalesce("cb", F.lit(0))).alias("total_bytes"), (F.coalesce("n", F.lit(0)) + F.coalesce("cn", F.lit(0))).alias("file_count"), complete.alias("complete")),
            "level",
        )
        levels.append(below)
    if not levels:
        return known.select("folder", F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("total_bytes"), F.lit(0).cast("bigint").alias("file_count"), F.lit(False).alias("complete"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def duplicate_folders(files: DataFrame, folders: DataFrame, reference: Sequence[str] | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """``(digest, folder, total_bytes, file_count)``: folders that are equal as whole trees, nested repeats left out.

    Folders without any file are no duplicates. Within a digest a folder below another of the same digest is left out.
    With ``reference`` a group needs a folder inside and one outside, and a folder that holds a reference root is neither.
    """
    rows = folder_digests(files, folders, incomplete).where("digest is not null and file_count > 0")
    if reference is not None:
        holds = F.lit(False)
        for root in reference:
            holds = holds | F.lit(root).startswith(F.concat(F.col("folder"), F.lit("/")))
        rows = rows.where(~holds).withColumn("inside", within_any("folder", reference))
    else:
        rows = rows.withColumn("inside", F.lit(None).cast("boolean"))
    again = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.bool_or("inside").alias("a"), F.bool_or(~F.col("inside")).alias("b")).where("n > 1")
    again = again.where("a and b") if reference is not None else again
    rows = rows.join(again.select("digest"), "digest", "left_semi")
    nested = rows.select("digest", "folder", F.explode(ancestors("folder")).alias("up")).join(rows.select("digest", F.col("folder").alias("up")), ["digest", "up"], "left_semi").select("digest", "folder").distinct()
    rows = rows.join(nested, ["digest", "folder"], "left_anti")
    kept = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.bool_or("inside").alias("a"), F.bool_or(~F.col("inside")).alias("b")).where("n > 1")
    kept = kept.where("a and b") if reference is not None else kept
    return rows.join(kept.select("digest"), "digest", "left_semi").select("digest", "folder", "total_bytes", "file_count")
