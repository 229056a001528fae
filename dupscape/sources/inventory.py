"""A file inventory as a Spark data source: one row per regular file, with its stamp, or per error.

    register(spark)
    spark.read.format("inventory").option("roots", json.dumps(["/data"])).load()
"""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "root string, path string, kind string, size bigint, modified_at timestamp, device int, inode bigint, modified_s bigint, modified_ns bigint, "
    "changed_s bigint, changed_ns bigint, error string"
)
RETRIES, PAUSE = 3, 0.25


def listed(folder: str, retries: int) -> list[os.DirEntry]:
    """A folder's entries by name, after up to ``retries`` further tries with growing pauses."""
    for attempt in range(min(max(retries, 0), RETRIES) + 1):
        try:
            with os.scandir(folder) as entries:
                return sorted(entries, key=lambda e: e.name)
        except OSError:
            if attempt == min(max(retries, 0), RETRIES):
                raise
            time.sleep(PAUSE * (attempt + 1))
    return []


def _stamp(s: os.stat_result) -> tuple:
    return (s.st_dev, s.st_ino, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9)


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def walk(root: str, start: str, recursive: bool, hidden: bool, retries: int) -> Iterator[tuple]:
    """Rows of one subtree: files, folders that stayed the same while read, and errors. Links are never followed."""
    from datetime import datetime, timezone

    stack = [start]
    while stack:
        folder = stack.pop()
        try:
            before = os.lstat(folder)
            if not stat.S_ISDIR(before.st_mode):
                yield (root, folder, "error", None, None, None, None, None, None, None, None, "not a folder")
                continue
            entries = listed(folder, retries)
            rows, deeper = [], []
            for entry in entries:
                if not hidden and entry.name.startswith("."):
                    continue
                try:
                    s = entry.stat(follow_symlinks=False)
                except OSError as error:
                    rows.append((root, entry.path, "error", None, None, None, None, None, None, None, None, error.strerror))
                    continue
                if stat.S_ISDIR(s.st_mode):
                    deeper.append(entry.path)
                elif stat.S_ISREG(s.st_mode):
                    device, inode, ms, mn, cs, cn = _stamp(s)
                    when = datetime.fromtimestamp(s.st_mtime, timezone.utc)
                    rows.append((root, entry.path, "file", s.st_size, when, _signed(device, 32), _signed(inode, 64), ms, mn, cs, cn, None))
            after = os.lstat(folder)
        except OSError as error:
            yield (root, folder, "error", None, None, None, None, None, None, None, None, error.strerror)
            continue
        yield from rows
        changed = (before.st_mtime_ns, before.st_ino) != (after.st_mtime_ns, after.st_ino)
        yield (root, folder, "error" if changed else "folder", None, None, None, None, None, None, None, None, "changed while read" if changed else None)
        if recursive:
            stack += reversed(deeper)


class Subtree(InputPartition):
    def __init__(self, root: str, start: str, recursive: bool) -> None:
        self.root, self.start, self.recursive = root, start, recursive


class InventoryReader(DataSourceReader):
    """One partition per top-level folder of each root, and one for the root's own files."""

    def __init__(self, roots: list[str], recursive: bool, hidden: bool, retries: int) -> None:
        self.roots, self.recursive, self.hidden, self.retries = roots, recursive, hidden, retries

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(Subtree(root, root, False))
            if self.recursive and os.path.isdir(root):
                try:
                    entries = listed(root, self.retries)
                except OSError:
                    continue
                out += [Subtree(root, e.path, True) for e in entries if e.is_dir(follow_symlinks=False) and (self.hidden or not e.name.startswith("."))]
        return out

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from walk(partition.root, partition.start, partition.recursive, self.hidden, self.retries)


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        on = lambda key, default: str(self.options.get(key, default)).lower() == "true"
        roots = json.loads(self.options["roots"])
        return InventoryReader([os.path.normpath(r) for r in dict.fromkeys(roots)], on("recursive", "true"), on("includeHidden", "false"), int(self.options.get("retries", "2")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventorySource)
