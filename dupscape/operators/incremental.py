"""Only new or changed records, run after run.

A run reads the sessions completed since the last one, and rereads the arrivals from the oldest session that was open
when the last run ended, so that rows which arrive late are not skipped. What it finds is anti-joined by key and version
against a ledger of what was processed, so that the overlap is not repeated. It compares with the latest version of each
path, which is its state; older sessions are read again only for paths that late rows touch. A run counts once its
manifest is written; one that fails before leaves nothing that a later run would see.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dupscape.session import materialize

#: The fields of a file's stamp; a change in any of them is a change of the file.
STAMP = ("device", "inode", "file_size", "modified_s", "modified_ns", "changed_s", "changed_ns")
# States of a session that has ended; one that started and has neither of them is open.
ENDED = ("completed", "interrupted", "needsRetry", "failed", "cancelled")


def seen_rows(stamps: DataFrame, fields: Sequence[str] = STAMP) -> DataFrame:
    """``(file_path, session_no, at)``: one row per path seen in a session; ``at`` has observed_at, ingested_at and version."""
    version = F.struct(*fields).alias("version")
    rows = stamps.where(F.col("session_no").isNotNull() & F.col("file_path").isNotNull()).select("session_no", "file_path", F.struct("observed_at", "ingested_at", version).alias("at"))
    return rows.groupBy("file_path", "session_no").agg(F.max("at").alias("at"))


def versions(stamps: DataFrame, fields: Sequence[str] = STAMP) -> DataFrame:
    """``(session_no, file_path, version)``: one row per path seen in a session, by the row with the latest observed_at.

    Unknown times are the earliest; of equal times the later ingested, then the greater stamp holds. Rows without a
    session or path are left out. Rows are parted by path once, which the later steps reuse.
    """
    return seen_rows(stamps, fields).select("session_no", "file_path", "at.version")


def _changed(seen: DataFrame) -> DataFrame:
    """Rows of ``seen(session_no, file_path, version, ...)`` that the ledger of the path's session before does not hold."""
    following = F.lead("session_no").over(Window.partitionBy("file_path").orderBy("session_no"))
    ledger = seen.select("file_path", following.alias("session_no"), "version").where("session_no is not null")
    return _without(seen, ledger)


def _without(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``rows`` whose key and version (null equals null) are not in ``ledger``."""
    same = (F.col("s.file_path") == F.col("l.file_path")) & (F.col("s.session_no") == F.col("l.session_no")) & (F.col("s.version") == F.col("l.version"))
    return rows.alias("s").join(ledger.alias("l"), same, "left_anti")


def changed_rows(stamps: DataFrame, sessions: DataFrame, fields: Sequence[str] = STAMP) -> DataFrame:
    """``(session_no, file_path, version)``: for each completed session the paths that are new or changed in it.

    Sessions count in the order of session_no; those not completed neither hide nor repeat a change. Every version that a
    completed session saw enters the ledger, valid for the next completed session that sees the path; a row whose key
    and version (null equals null) stand in the ledger for its session is dropped by an anti-join. A version that
    returns after another is a change. Empty tables give no rows.
    """
    done = sessions.where("status = 'completed'").select("session_no").distinct()
    return _changed(versions(stamps.join(done, "session_no", "left_semi"), fields))


def open_session(sessions: DataFrame) -> Column:
    """Whether a row of ``sessions`` has started and neither finished nor failed; an unknown state ends nothing."""
    ended = F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    finished = F.col("finished_at").isNotNull() if "finished_at" in sessions.columns else F.lit(False)
    return F.col("started_at").isNotNull() & ~finished & ~ended


def land(stamps: DataFrame, folder: str) -> DataFrame:
    """``stamps`` as files by session and month of arrival, so that a run reads only the folders that it needs."""
    parted = stamps.withColumn("arrived", F.trunc("ingested_at", "month"))
    parted.repartition("session_no", "arrived").write.mode("overwrite").partitionBy("session_no", "arrived").parquet(folder)
    return stamps.sparkSession.read.parquet(folder)


class IncrementalScan:
    """Runs over growing ``stamps`` and ``sessions`` with state in ``folder``: each change is given out exactly once.

    Call :meth:`run` again after a failure, or with the same input: a run without a manifest is overwritten, a repeated
    one yields no rows. State: ``runs/run=n`` what run n gave out, the ledger; ``seen`` the rows it took in, one per path and
    session; ``latest`` the last session of each path and its version. A run reads the newest ``latest``, as long as there are
    paths, and not the tables of all runs; only paths with late rows look those up. Sessions are few, one row a scan, and their
    numbers are the only thing that the driver sees.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = STAMP) -> None:
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last successful run: its number, where to reread from, the newest arrival, and the sessions done by then."""
        path, files = self._path("manifests")
        runs = [int(f.getPath().getName().split(".")[0]) for f in files.listStatus(path) if f.getPath().getName().endswith(".json")] if files.exists(path) else []
        if not runs:
            return {"run": 0, "reread_from": None, "newest": None, "done": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{max(runs)}.json").collect()))

    def _tables(self, kind: str, run: int, like: DataFrame | None = None) -> DataFrame:
        read = self.spark.read if like is None else self.spark.read.schema(like.schema)
        found = read.option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/run={i}" for i in range(1, run + 1)])
        return found.drop("run") if like is None else found.select(*like.columns)

    def processed(self) -> DataFrame | None:
        """The ledger: all that was given out."""
        run = self.manifest()["run"]
        return self._tables("runs", run) if run else None

    def _keep(self, df: DataFrame, kind: str, run: int, by: Sequence[str] = ()) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{kind}/run={run}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{kind}/run={run}").select(*df.columns)

    def _late(self, stamps: DataFrame, last: dict) -> DataFrame:
        """Rows of sessions done before that came since, or may have: those without a time of arrival, too."""
        since = F.timestamp_micros(F.lit(last["reread_from"]))
        came = (F.col("ingested_at") >= since) | F.col("ingested_at").isNull()
        if "arrived" in stamps.columns:
            came = came & ((F.col("arrived") >= F.trunc(since, "month")) | F.col("arrived").isNull())
        rows = stamps.where(F.col("session_no").isin(last["done"]))
        return rows.where(came) if last["reread_from"] is not None else rows

    def run(self, stamps: DataFrame, sessions: DataFrame) -> DataFrame:
        """``(session_no, file_path, version)`` of changes not given out before, written before they are returned.

        ``stamps`` in folders by session, as :func:`land` makes them, are read only as far as needed. A session that completes
        after a later one counts in its place, by session_no. What was given out is never taken back.
        """
        last = self.manifest()
        number, first = last["run"] + 1, not last["run"]
        done = sorted(r.session_no for r in sessions.where("status = 'completed' and session_no is not null").select("session_no").distinct().collect())
        fresh = [s for s in done if s not in set(last["done"])]
        new = seen_rows(stamps.where(F.col("session_no").isin(fresh)), self.fields)
        if last["done"]:
            # the reread overlaps what was seen: only rows that are new there, or later than what was, are late
            late = materialize(seen_rows(self._late(stamps, last), self.fields), "late")
            of = [r.session_no for r in late.select("session_no").distinct().collect()]
            if of:
                known = self._tables("seen", last["run"], late).where(F.col("session_no").isin(of))
                same = (F.col("n.file_path") == F.col("k.file_path")) & (F.col("n.session_no") == F.col("k.session_no")) & (F.col("n.at") <= F.col("k.at"))
                new = new.unionByName(late.alias("n").join(known.alias("k"), same, "left_anti"))
        new = self._keep(new, "seen", number, ["session_no"])
        old = None if first else self.spark.read.parquet(f"{self.folder}/latest/run={last['run']}")
        rows, behind = new.withColumn("fresh", F.lit(True)), None
        if not first:
            # a path with a row before its latest session needs all its sessions, any other only the latest
            behind = new.join(old.select("file_path", F.col("session_no").alias("top")), "file_path").where("session_no <= top").select("file_path").distinct()
            behind = materialize(behind, "behind")
            behind = None if behind.isEmpty() else behind
            touched = old.join(new.select("file_path").distinct(), "file_path", "left_semi")
            if behind is not None:
                history = self._tables("seen", last["run"], new).join(behind, "file_path", "left_semi")
                rows = rows.unionByName(history.withColumn("fresh", F.lit(True)))
                touched = touched.join(behind, "file_path", "left_anti")
            rows = rows.unionByName(touched.withColumn("fresh", F.lit(False)))
        merged = rows.groupBy("file_path", "session_no").agg(F.max("at").alias("at"), F.bool_or("fresh").alias("fresh"))
        found = _changed(merged.select("session_no", "file_path", "at.version", "fresh")).where("fresh").select("session_no", "file_path", "version")
        if behind is not None:
            given = self._tables("runs", last["run"]).join(behind, "file_path", "left_semi")
            found = _without(found, given)
        found = self._keep(found, "runs", number)
        latest = new if first else new.unionByName(old)
        top = F.max(F.struct("session_no", "at")).alias("top")
        self._keep(latest.groupBy("file_path").agg(top).select("file_path", "top.session_no", "top.at"), "latest", number)
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        open_since = sessions.where(open_session(sessions)).agg(F.min(micros("started_at"))).first()[0]
        arrived = new.agg(F.max(micros("at.ingested_at"))).first()[0]
        newest = max((t for t in (last.get("newest"), arrived) if t is not None), default=None)
        times = [t for t in (open_since, newest) if t is not None]
        self._commit(number, {"run": number, "reread_from": min(times) if times else None, "newest": newest, "done": sorted({*done, *last["done"]})})
        return found

    def _commit(self, number: int, state: dict) -> None:
        """Write the manifest under another name and rename it; a rename that fails is no run."""
        path, files = self._path(f"manifests/{number}.json.part")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(path, self._path(f"manifests/{number}.json")[0]):
            raise OSError(f"run {number} of {self.folder} could not be committed")
