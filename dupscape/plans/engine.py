"""The pipelines end to end, over real folders: exact duplicates, library comparison, names, book contents, images."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from dupscape.operators import content, exact, images, inventory, library, names, state
from dupscape.operators.inventory import BOOKS, ScanOptions
from dupscape.paths import extension, within_any
from dupscape.session import materialize, width
from dupscape.sources import books
from dupscape.sources import inventory as inventory_source
from dupscape.streaming.duplicates import JobControl

#: Bytes of a sampled block, and of one read.
BLOCK, READ = 65_536, 1 << 20


def _digest(path: str, size: int, sample: bool) -> str | None:
    """Hash of a file or of three blocks of it; null if it cannot be read or changes meanwhile."""
    try:
        flags = os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)
        with os.fdopen(os.open(path, flags), "rb") as file:
            before = os.fstat(file.fileno())
            found = hashlib.sha256()
            if sample and size > 3 * BLOCK:
                for at in (0, size // 2, size - BLOCK):
                    file.seek(at)
                    found.update(file.read(BLOCK))
            else:
                while part := file.read(READ):
                    found.update(part)
            after = os.fstat(file.fileno())
    except OSError:
        return None
    same = (before.st_size, before.st_mtime_ns, before.st_ctime_ns) == (after.st_size, after.st_mtime_ns, after.st_ctime_ns) and before.st_size == size
    return found.hexdigest() if same else None


@pandas_udf(StringType())
def full_digest(paths: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_digest(p, s, False) for p, s in zip(paths, sizes)], dtype=object)


@pandas_udf(StringType())
def sample_digest(paths: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_digest(p, s, True) for p, s in zip(paths, sizes)], dtype=object)


@dataclass
class ScanResult:
    """Tables of one scan. Claims about uniqueness are withheld while ``incomplete``."""

    files: DataFrame
    hashed: DataFrame
    groups: DataFrame
    unique: DataFrame | None
    images: DataFrame | None
    errors: DataFrame
    incomplete: bool
    session: dict = field(default_factory=dict)

    @property
    def status(self) -> str:
        return state.NEEDS_RETRY if self.incomplete else state.COMPLETED


class Engine:
    """Scans over folders that every executor can read."""

    def __init__(self, spark: SparkSession, cache: str | None = None) -> None:
        self.spark, self.cache = spark, cache
        inventory_source.register(spark)

    def inventory(self, roots: Sequence[str], options: ScanOptions) -> tuple[DataFrame, DataFrame]:
        """Files that the options accept, once each, and errors."""
        source = self.spark.read.format("inventory").option("roots", json.dumps(list(roots))).option("retries", str(options.retries))
        source = source.option("recursive", str(options.recursive).lower()).option("includeHidden", str(options.include_hidden).lower())
        rows = materialize(source.load(), "inventory")
        files = inventory.below_roots(rows.where("kind = 'file'"), list(roots), options)
        return inventory.inventory_filter(files, options), rows.where("kind = 'error'").select("path", "error")

    def _reused(self, files: DataFrame, stored: DataFrame | None) -> DataFrame:
        stamp = ["device", "inode", "size", "modified_s", "modified_ns", "changed_s", "changed_ns"]
        if stored is None:
            return files.withColumns({"sample_hash": F.lit(None).cast("string"), "full_hash": F.lit(None).cast("string")})
        return exact.reuse_hashes(files, stored, ["path"], stamp, ["sample_hash", "full_hash"])

    def stored_hashes(self) -> DataFrame | None:
        return self.spark.read.parquet(self.cache) if self.cache and self._exists(self.cache) else None

    def clear_cache(self) -> None:
        old = self.stored_hashes()
        if old is not None:
            old.limit(0).write.mode("overwrite").parquet(self.cache)

    def scan(self, roots: Sequence[str], options: ScanOptions = ScanOptions(), store: state.SessionStore | None = None, resume: bool = False, control: JobControl | None = None) -> ScanResult:
        """Exact duplicates, and in reference mode what only the other roots hold.

        Sizes first, then samples, then whole hashes, each only of what the step before left; hard links are read once.
        With ``store`` the hashes are saved in the session after each stage, so that a scan that fails in a later one loses
        none of them; ``resume`` takes the session's roots, options and, for files with an unchanged stamp, hashes.
        ``control`` is asked before each stage, and cancels or pauses there; a cancelled scan stays interrupted.
        """
        manifest, stored = {}, self.stored_hashes()
        if store is not None and resume:
            manifest = store.load()
            roots, options = manifest["roots"], manifest["options"]
            manifest = manifest | {"options": asdict(options)}
            if "files" in manifest["tables"]:
                stored = store.table(manifest, "files")
        elif problems := options.problems(roots):
            raise state.SessionError("; ".join(problems))
        elif store is not None:
            manifest = store.create(roots, options)
            store.save(manifest, {}, state.RUNNING)
        columns = ["path", "size", "device", "inode", "modified_s", "modified_ns", "changed_s", "changed_ns", "sample_hash", "full_hash"]

        def stage(label: str, hashed: DataFrame | None = None) -> None:
            """What is hashed so far becomes part of the session; then the next stage may begin."""
            nonlocal manifest
            if store is not None and hashed is not None:
                rest = known.select(*columns).join(hashed.select("path"), "path", "left_anti")
                manifest = store.save(manifest, {"files": rest.unionByName(hashed.select(*columns))}, state.RUNNING)
            if control is not None:
                try:
                    control.checkpoint(label)
                except InterruptedError:
                    if store is not None:
                        store.save(manifest, {}, state.INTERRUPTED)
                    raise

        stage("inventory")
        files, errors = self.inventory(roots, options)
        stage("hashes")
        preferred = within_any("path", options.reference_paths) if options.reference_paths else None
        known = materialize(self._reused(inventory.one_per_identity(files, preferred=preferred), stored), "known")
        if options.mode == "reference":
            hashed = known.withColumn("full_hash", F.coalesce("full_hash", full_digest("path", "size")))
        else:
            sized = exact.size_candidates(known)
            small = F.col("size") <= 3 * BLOCK
            sampled = materialize(sized.withColumn("sample_hash", F.coalesce("sample_hash", F.when(small, F.col("full_hash")), sample_digest("path", "size"))), "sampled")
            stage("full hashes", sampled)
            left = exact.repeated(sampled, ["size", "sample_hash"])
            hashed = left.withColumn("full_hash", F.coalesce("full_hash", F.when(small, F.col("sample_hash")), full_digest("path", "size")))
        hashed = materialize(hashed, "hashed")
        stage("images", hashed)
        failed = hashed.where("full_hash is null").select("path", F.lit("unreadable or changed while read").alias("error"))
        errors = errors.unionByName(failed)
        incomplete = not errors.isEmpty()
        groups = exact.duplicate_groups(hashed)
        unique = None
        if options.mode == "reference":
            groups = groups.join(library.cross_groups(hashed, options.reference_paths).select("full_hash").distinct(), "full_hash", "left_semi")
            unique = library.unique_targets(hashed, options.reference_paths, incomplete)
        found = images.similar_image_groups(self.image_signatures(files), options.similarity_threshold) if options.similar_images else None
        result = ScanResult(files, hashed, groups, unique, found, errors, incomplete, manifest)
        kept = known.select(*columns).join(hashed.select("path"), "path", "left_anti").unionByName(hashed.select(*columns))
        if store is not None:
            result.session = store.save(manifest, {"files": kept}, result.status)
        if self.cache:
            # the old cache may be an input of this plan, so the new one is read back from shared storage
            materialize(kept, "cache").write.mode("overwrite").parquet(self.cache)
        return result

    def image_signatures(self, files: DataFrame) -> DataFrame:
        """Signatures of the image files of an inventory, read whole on the executors."""
        from dupscape.sources.images import signed

        wanted = files.where(extension("path").isin(*inventory.IMAGES)).select("path")
        paths = [r.path for r in wanted.select(F.regexp_replace("path", r"/[^/]*$", "").alias("path")).distinct().collect()]  # folders, for the reader
        if not paths:
            return self.spark.createDataFrame([], "path string, hashes array<bigint>, mean double, deviation double")
        data = self.spark.read.format("image").option("dropInvalid", True).load([f"file://{p}" for p in paths])
        rows = data.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), signed("image.data", "image.height", "image.width", "image.nChannels").alias("s"))
        return rows.join(wanted, "path", "left_semi").select("path", "s.hashes", "s.mean", "s.deviation").where("hashes is not null")

    def scan_names(self, roots: Sequence[str], least: float = 0.55, recursive: bool = True) -> DataFrame:
        """Pairs of e-books with similar names."""
        files, _ = self.inventory(roots, ScanOptions(recursive=recursive, minimum_size=0, extensions=BOOKS))
        return names.name_matches(files, least)

    def scan_books(self, roots: Sequence[str], level: str = "standard", recursive: bool = True, text_cache: str | None = None) -> tuple[DataFrame, DataFrame]:
        """E-books with their texts, states and titles, and pairs that share passages; ``text_cache`` keeps texts between scans."""
        files, _ = self.inventory(roots, ScanOptions(recursive=recursive, minimum_size=0, extensions=BOOKS))
        wanted = files.select("path", "size", "modified_s", "modified_ns").withColumn("ext", extension("path"))
        old = self.spark.read.parquet(text_cache) if text_cache and self._exists(text_cache) else None
        if old is not None:
            # a text is taken again if path, size and time of change are those it was read at
            same = ["path", "size", "modified_s", "modified_ns", "ext"]
            kept = materialize(old.join(wanted, same, "left_semi"), "cached-books")
            read = kept.unionByName(books.read_books(wanted.join(kept, same, "left_anti").repartition(width(self.spark))))
        else:
            read = books.read_books(wanted.repartition(width(self.spark)))
        read = materialize(read, "books")
        if text_cache:
            read.write.mode("overwrite").parquet(text_cache)
        return read, content.content_matches(read.where("state = 'ready'"), "path", "text", level)

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
