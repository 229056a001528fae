"""Filters over a file inventory: ``path, size`` and, where known, ``device, inode, is_network, modified_at``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscape.paths import ancestors, extension, parent, plain, within, within_any

# File kinds.
IMAGES = ("jpg", "jpeg", "png", "webp", "heic", "heif", "tif", "tiff", "bmp", "gif")
BOOKS = ("pdf", "epub", "mobi", "azw", "azw3")


@dataclass(frozen=True)
class ScanOptions:
    """What a scan takes in. Sizes are bytes; ``reference`` mode compares the rest with ``reference_paths``."""

    recursive: bool = True
    include_hidden: bool = False
    similar_images: bool = False
    minimum_size: int = 1
    maximum_size: int | None = None
    excluded_paths: tuple[str, ...] = ()
    non_recursive_paths: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    similarity_threshold: int = 8
    mode: str = "standard"
    reference_paths: tuple[str, ...] = ()
    retries: int = 2

    def problems(self, roots: Sequence[str]) -> list[str]:
        """Why these options cannot be used with ``roots``; empty if they can."""
        out = []
        if not roots:
            out.append("no roots")
        if any("://" in r and not r.startswith("file://") for r in (*roots, *self.reference_paths)):
            out.append("roots must be local paths")
        if any(not r.startswith("/") for r in self.reference_paths):
            out.append("reference paths must be absolute")
        if self.maximum_size is not None and self.maximum_size < self.minimum_size:
            out.append("maximum size below minimum size")
        if not 0 <= self.similarity_threshold <= 64:
            out.append("threshold outside 0 to 64")
        if self.mode == "reference":
            others = [r for r in roots if r not in self.reference_paths]
            if not self.reference_paths or not set(self.reference_paths) <= set(roots):
                out.append("reference paths must be among the roots")
            if not others:
                out.append("nothing to compare with the reference")
            if any(inside(a, b) or inside(b, a) for a in others for b in self.reference_paths):
                out.append("a reference and another root contain each other")
        return out


def inside(path: str, root: str) -> bool:
    """The same test as :func:`dupscape.paths.within` on the driver, for a few roots."""
    return root == "/" or path == root or path.startswith(root.rstrip("/") + "/")


def parse_extensions(text: str) -> tuple[str, ...]:
    """Extensions of a typed list: split at commas, semicolons (also full-width) and blanks, dots off, lower case."""
    return tuple(dict.fromkeys(p for p in (x.strip(".").lower() for x in re.split(r"[,，;；\s]+", text)) if p))


def accepted(size: Column, path: Column, options: ScanOptions) -> Column:
    good = size >= options.minimum_size
    if options.maximum_size is not None:
        good = good & (size <= options.maximum_size)
    return good & extension(path).isin(*options.extensions) if options.extensions else good


def hidden_below(path: Column, root: Column) -> Column:
    """Whether a name below ``root`` begins with a dot."""
    return F.substring(path, F.length(root) + 1, 1 << 30).rlike(r"(^|/)\.[^/]")


def inventory_filter(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Size bounds, extensions and excluded folders; null sizes are left out."""
    return files.where(accepted(F.col("size"), F.col("path"), options) & ~within_any("path", options.excluded_paths))


def below_roots(files: DataFrame, roots: Sequence[str], options: ScanOptions) -> DataFrame:
    """Files of the roots: of non-recursive ones only the direct children, no hidden names, each path once."""
    parts = []
    for root in sorted({*roots}):
        flat = not options.recursive or root in options.non_recursive_paths
        rule = parent("path") == F.lit(root) if flat else within("path", F.lit(root))
        if not options.include_hidden:
            rule = rule & ~hidden_below(F.col("path"), F.lit("" if root == "/" else root))
        parts.append(rule)
    good = F.lit(False)
    for rule in parts:
        good = good | rule
    return files.where(good).dropDuplicates(["path"])


def one_per_identity(files: DataFrame, device: str = "device", inode: str = "inode", preferred: Column | None = None, each: Sequence[str] = ()) -> DataFrame:
    """One path for each physical file, the smallest, preferred ones first; ``aliases`` counts its paths.

    Files without identity stand for themselves. ``each`` names columns, as the scan's, within which files are told apart.
    """
    known = F.col(device).isNotNull() & F.col(inode).isNotNull()
    order = [*([preferred.desc()] if preferred is not None else []), F.col("path")]
    w = Window.partitionBy(*each, device, inode)
    ranked = files.where(known).withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("aliases", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    return ranked.unionByName(files.where(~known).withColumn("aliases", F.lit(1).cast("bigint")))


def complete_scopes(files: DataFrame, completed: DataFrame, blocked: DataFrame | None = None, each: Sequence[str] = ()) -> DataFrame:
    """Files whose folder was read completely (``completed.path``) and lies below no blocked folder (``blocked.path``).

    Blocked folders are matched through each file's ancestors, an equi-join whatever their number. With
    ``each``, columns of ``completed`` as the scan's, a file comes once for each of their values.
    """
    scopes = completed.select(*each, F.col("path").alias("_parent")).distinct()
    kept = files.withColumn("_parent", parent("path")).join(scopes, "_parent", "inner" if each else "left_semi").drop("_parent")
    if blocked is None:
        return kept


    hit = kept.select("path", F.explode(ancestors("path")).alias("_above")).join(blocked.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()
    return kept.join(hit, "path", "left_anti")


def disjoint_roots(new: DataFrame, old: DataFrame) -> DataFrame:
    """Roots of ``new(path)`` that neither contain nor lie in one of ``old(path)``; through ancestors, by equi-joins."""


    up = lambda df: df.select("path", F.explode(F.array_append(ancestors("path"), F.col("path"))).alias("_at"))
    above = up(new).join(old.select(F.col("path").alias("_at")).distinct(), "_at", "left_semi").select("path")
    under = up(old).select(F.col("_at").alias("path")).distinct()
    return new.join(above.distinct(), "path", "left_anti").join(under, "path", "left_anti")


def spelled(files: DataFrame) -> DataFrame:
    """``path`` in one spelling."""
    return files.withColumn("path", plain("path"))
