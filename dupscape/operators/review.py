"""Review of duplicate groups: which file to keep, safe selections, and the plan of a cleanup."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscape.paths import below, plain, within_any


def selectable(path: Column, network: Column, protected: Sequence[str], complete: bool = True) -> Column:
    """Whether a file may be selected for removal: a complete result, not on a network volume, not protected."""
    return F.lit(complete) & ~F.coalesce(network, F.lit(False)) & ~within_any(path, protected)


def suggested_keepers(members: DataFrame, group: str, protected: Sequence[str] = (), preferred: Sequence[str] = (), network: str | None = None) -> DataFrame:
    """``members`` with ``rank`` and ``action``: one ``keep`` a group, ``remove`` for the other selectable files, else ``leave``.

    Kept is what cannot be selected, before files strictly below a preferred folder, before the rest; then the shorter
    path, then the smaller. The keeper is found by one pre-aggregated minimum a group, so no group is sorted in one task.
    """
    liked = F.lit(False)
    for root in preferred:
        liked = liked | below("path", plain(F.lit(root)))
    free = selectable(F.col("path"), F.col(network) if network else F.lit(False), protected)
    rows = members.withColumn("rank", F.when(~free, 0).when(liked, 1).otherwise(2))
    best = rows.groupBy(group).agg(F.min(F.struct("rank", F.length("path").alias("len"), "path")).alias("_b")).select(group, F.col("_b.path").alias("_keep"))
    action = F.when(F.col("path") == F.col("_keep"), "keep").when(F.col("rank") == 0, "leave").otherwise("remove")
    return rows.join(best, group).withColumn("action", action).drop("_keep")


def repaired_selection(members: DataFrame, group: str, selected: str) -> DataFrame:
    """``members`` with at least one file of each group unselected: where all were, the smallest path is."""
    state = members.groupBy(group).agg(F.bool_and(F.coalesce(selected, F.lit(False))).alias("_all"), F.min("path").alias("_first"))
    keep = F.col("_all") & (F.col("path") == F.col("_first"))
    return members.join(state, group).withColumn(selected, F.coalesce(F.col(selected), F.lit(False)) & ~keep).drop("_all", "_first")


def groups_matching(members: DataFrame, group: str, text: str) -> DataFrame:
    """All members of groups in which some path contains ``text``, case ignored; an empty text keeps all."""
    hit = members.where(F.lower("path").contains(text.lower())).select(group).distinct()
    return members.join(hit, group, "left_semi")


def cleanup_problems(plan: DataFrame, members: DataFrame, group: str, protected: Sequence[str] = ()) -> DataFrame:
    """``(group, path, problem)`` of a removal plan (group, path); an empty result means it may be carried out.

    ``unknownSelection``: not a member of its group; ``lastCopy``: no member would remain; ``protected`` and ``network``.
    """
    chosen = plan.select(group, "path").distinct()
    unknown = chosen.join(members.select(group, "path"), [group, "path"], "left_anti").withColumn("problem", F.lit("unknownSelection"))
    known = members.join(chosen, [group, "path"], "left_semi")
    left = members.select(group, "path").join(chosen, [group, "path"], "left_anti").select(group).distinct()
    last = known.join(left, group, "left_anti").select(group, "path", F.lit("lastCopy").alias("problem"))
    guarded = known.where(within_any("path", protected)).select(group, "path", F.lit("protected").alias("problem"))
    out = unknown.unionByName(last).unionByName(guarded)
    if "is_network" in members.columns:
        out = out.unionByName(known.where("is_network").select(group, "path", F.lit("network").alias("problem")))
    return out


def file_sha256(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def same_bytes(a: str, b: str, block: int = 1 << 20) -> bool:
    """Whether two different physical files hold equal bytes and did not change while read."""
    before = os.lstat(a), os.lstat(b)
    if (before[0].st_dev, before[0].st_ino) == (before[1].st_dev, before[1].st_ino) or before[0].st_size != before[1].st_size:
        return False
    with open(a, "rb") as x, open(b, "rb") as y:
        while True:
            left, right = x.read(block), y.read(block)
            if left != right:
                return False
            if not left:
                break
    return all((s.st_mtime_ns, s.st_ctime_ns, s.st_size) == (n.st_mtime_ns, n.st_ctime_ns, n.st_size) for s, n in zip(before, (os.lstat(a), os.lstat(b))))


def preflight(keeper: str, targets: Sequence[str], full_hash: str | None) -> dict[str, str]:
    """Problems by path before files are moved; on the driver, for one reviewed group. Cached hashes are not trusted."""
    try:
        if full_hash is not None and file_sha256(keeper) != full_hash:
            return {keeper: "staleFile"}
    except OSError as error:
        return {keeper: f"unreadable: {error.strerror}"}
    out = {}
    for target in targets:
        try:
            if not same_bytes(keeper, target):
                out[target] = "staleFile"
        except OSError as error:
            out[target] = f"unreadable: {error.strerror}"
    return out


def move_to(folder: str, keeper: str, targets: Sequence[str], full_hash: str | None = None) -> dict[str, str]:
    """Move targets into ``folder``, each checked again right before; failures by path. Never called by any other operator."""
    failed = {}
    for target in targets:
        if problem := preflight(keeper, [target], full_hash):
            failed |= {target: next(iter(problem.values()))}
            continue
        to, n = os.path.join(folder, os.path.basename(target)), 1
        while os.path.exists(to):
            to, n = os.path.join(folder, f"{n}-{os.path.basename(target)}"), n + 1
        shutil.move(target, to)
    return failed
