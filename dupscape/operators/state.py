"""Scan state between runs: what changed, what can be reused, stored sessions and their history."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dupscape.operators.inventory import ScanOptions, inside

#: The states of a session.
RUNNING, INTERRUPTED, COMPLETED, NEEDS_RETRY = "running", "interrupted", "completed", "needsRetry"
VERSION = 1


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: Sequence[str]) -> DataFrame:
    """``(keys, change)``: ``added``, ``deleted``, ``modified`` or ``unchanged``, null equal to null in stamps.

    Rows of one key should be unique; repeated equal rows count once.
    """
    a = old.select(*keys, F.struct(*stamp).alias("_a")).dropDuplicates([*keys])
    b = new.select(*keys, F.struct(*stamp).alias("_b")).dropDuplicates([*keys])
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return a.join(b, [*keys], "full_outer").select(*keys, change.alias("change"))


def latest_runs(runs: DataFrame, when: str, key: str, most: int = 30) -> DataFrame:
    """The newest ``most`` runs with their position; a report, so the bound is the feature."""
    top = runs.orderBy(F.desc_nulls_last(when), F.desc(key)).limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last(when), F.desc(key))))


def pending_paths(folders: DataFrame, blocked: DataFrame, failed: DataFrame) -> DataFrame:
    """Distinct paths still to be read: open folders, blocked folders and failed files."""
    return folders.select("path").unionByName(blocked.select("path")).unionByName(failed.select("path")).distinct()


class SessionError(ValueError):
    """A stored session that cannot be used."""


class SessionStore:
    """A session as a folder: ``manifest.json`` and Parquet tables, each replaced as a whole.

    Tables are written under a new name first and become current with the manifest, whose replacement is atomic.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def create(self, roots: Sequence[str], options: ScanOptions, now: datetime | None = None) -> dict:
        if problems := options.problems(roots):
            raise SessionError("; ".join(problems))
        if any(inside(self.folder, r) and not any(inside(self.folder, x) for x in options.excluded_paths) for r in roots):
            raise SessionError("a session cannot be stored inside a scanned root")
        now = now or datetime.now(timezone.utc)
        return {"version": VERSION, "id": uuid.uuid4().hex, "created_at": now.isoformat(), "updated_at": now.isoformat(), "roots": list(roots), "options": asdict(options), "status": RUNNING, "tables": {}}

    def save(self, manifest: dict, tables: dict[str, DataFrame], status: str) -> dict:
        os.makedirs(self.folder, exist_ok=True)
        kept = dict(manifest["tables"])
        for name, df in tables.items():
            kept[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"file://{os.path.join(self.folder, kept[name])}")
        out = manifest | {"tables": kept, "status": status, "updated_at": datetime.now(timezone.utc).isoformat()}
        part = os.path.join(self.folder, f"manifest.{uuid.uuid4().hex}.part")
        with open(part, "w", encoding="utf-8") as file:
            json.dump(out, file, ensure_ascii=False, indent=1)
        os.replace(part, os.path.join(self.folder, "manifest.json"))
        return out

    def load(self) -> dict:
        try:
            with open(os.path.join(self.folder, "manifest.json"), encoding="utf-8") as file:
                manifest = json.load(file)
            version, roots, options = manifest["version"], manifest["roots"], manifest["options"]
        except (OSError, ValueError, KeyError, TypeError) as error:
            raise SessionError(f"unreadable session: {error}") from error
        if version != VERSION:
            raise SessionError(f"unknown session version {version}")
        if any("://" in r or not r.startswith("/") for r in roots):
            raise SessionError("roots must be local absolute paths")
        options = ScanOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
        if problems := options.problems(roots):
            raise SessionError("; ".join(problems))
        if "files" in manifest["tables"]:
            self._validate(self.table(manifest, "files"), roots)
        return manifest | {"options": options}

    @staticmethod
    def _validate(files: DataFrame, roots: Sequence[str]) -> None:
        from dupscape.paths import within_any

        bad = files.where(F.col("path").isNull() | ~F.col("path").startswith("/") | (F.col("size") < 0) | ~within_any("path", list(roots)))
        if not bad.isEmpty():
            raise SessionError("a stored file lies outside the session's roots")

    def table(self, manifest: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"file://{os.path.join(self.folder, manifest['tables'][name])}")

    def with_roots(self, manifest: dict, added: Sequence[str]) -> dict:
        """The session extended by roots that neither contain nor lie in its own; hashes are kept for reuse."""
        for a in added:
            if any(inside(a, r) or inside(r, a) for r in manifest["roots"]):
                raise SessionError(f"{a} overlaps a root of the session")
        return manifest | {"roots": [*manifest["roots"], *added], "status": RUNNING}


def list_sessions(parent: str) -> tuple[list[dict], int]:
    """Manifests below ``parent``, newest first, and how many could not be read."""
    found, failed = [], 0
    for name in sorted(os.listdir(parent)) if os.path.isdir(parent) else []:
        path = os.path.join(parent, name, "manifest.json")
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as file:
                    found.append(json.load(file))
            except ValueError:
                failed += 1
    return sorted(found, key=lambda m: m.get("updated_at", ""), reverse=True), failed
