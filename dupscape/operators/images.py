"""Similar images: three perceptual hashes each, a lossless banded join, leaders without chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscape.functions.bits import bands, clamp, near_in_band
from dupscape.operators.skew import BLOCK, salted_pairs, salted_rows, skewed_join
from dupscape.session import materialize, ranked, width

#: Pairs that leave Python together, about.
BATCH = 100_000


def flat(mean_a: Column, mean_b: Column, dev_a: Column, dev_b: Column) -> Column:
    """Whether one image is nearly flat and their brightness differs: such images are never similar."""
    return F.coalesce((F.least(dev_a, dev_b) < 3) & (F.abs(mean_a - mean_b) > 8), F.lit(False))


def signature_classes(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images by equal signature, so that copies are compared once: ``(path, cls)`` and ``(cls, hashes, mean, deviation, lead)``.

    ``cls`` is the position of the class in the order of ``lead``, its first path.
    """
    signed = images.where("path is not null and hashes is not null").select("path", "hashes", "mean", "deviation").dropDuplicates(["path"])
    signed = materialize(signed.withColumn("sign", F.unhex(F.sha2(F.concat_ws(",", F.array_join("hashes", ","), "mean", "deviation"), 256))), "signatures")
    found = signed.groupBy("sign").agg(F.first("hashes").alias("hashes"), F.first("mean").alias("mean"), F.first("deviation").alias("deviation"), F.min("path").alias("lead"))
    classes = materialize(ranked(found, [F.col("lead")], "cls"), "leads")
    return signed.select("path", "sign").join(classes.select("sign", "cls"), "sign").select("path", "cls"), classes.drop("sign")


def near_hashes(hashes: DataFrame, threshold: int, block: int = 100_000) -> DataFrame:
    """``(x, y, distance)`` of different values of ``hash`` within the threshold, x < y; nulls have none.

    Of threshold + 2 bands such hashes agree in two or more. The rows go to tasks by one of them, a task compares those that agree
    in a later one too, and pairs that are not near never leave it. A pair comes from its first two bands only.
    """
    t = clamp(threshold)
    held = materialize(hashes.where("hash is not null").select("hash").distinct(), "hashes")
    # the last band has no later one
    banded = held.select("hash", F.explode(F.slice(bands(F.col("hash"), t, 2), 1, t + 1)).alias("k")).select("hash", "k.band", "k.bits")
    placed = salted_rows(banded, ["band", "bits"], "hash", block).repartition(width(hashes.sparkSession), "band", "bits", "salt")

    def run(batches):
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        values, band, salt = (held[c].to_numpy() for c in ("hash", "band", "salt"))
        own, values = held["own"].to_numpy().astype(bool), values.view(np.uint64)
        del held, batches
        out, n = [], 0

        def batch() -> pa.RecordBatch:
            x, y = (np.concatenate(v) for v in zip(*out))
            apart = np.bitwise_count(x ^ y).astype(np.int32)  # of unsigned values: of signed ones it counts the absolute value's bits
            x, y = x.view(np.int64), y.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(apart)], ["x", "y", "distance"])

        for b in range(t + 1):
            here = band == b
            for pair in near_in_band(values[here], own[here], salt[here], b, t) if here.any() else ():
                out.append(pair)
                n += len(pair[0])
                if n >= BATCH:
                    yield batch()
                    out, n = [], 0
        if n:
            yield batch()

    return placed.select("hash", "band", "salt", "own").mapInArrow(run, "x bigint, y bigint, distance int")


def near_signatures(classes: DataFrame, threshold: int) -> DataFrame:
    """``(a, b, distance)`` of different signatures within the threshold, a < b."""
    owners = classes.select("cls", "mean", "deviation", F.explode("hashes").alias("h")).where("cls is not null and h is not null").distinct()
    owners = materialize(owners, "owners")
    near = materialize(near_hashes(owners.select(F.col("h").alias("hash")), threshold), "near-hashes")
    side = lambda h, c: owners.select(F.col("h").alias(h), F.col("cls").alias(f"cls_{c}"), F.col("mean").alias(f"mean_{c}"), F.col("deviation").alias(f"deviation_{c}"))
    half = skewed_join(side("x", "a"), near, ["x"], ["cls_a"], block=BLOCK)
    different = skewed_join(side("y", "b"), half, ["y"], ["cls_b"], block=BLOCK)
    equal = salted_pairs(owners, ["h"], "cls", ["mean", "deviation"]).withColumn("distance", F.lit(0))
    both = different.select(*(c for c in equal.columns if c != "h")).unionByName(equal.drop("h"))
    both = both.where(F.col("cls_a") != F.col("cls_b")).where(~flat(*(F.col(c) for c in ("mean_a", "mean_b", "deviation_a", "deviation_b"))))
    return both.groupBy(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).agg(F.min("distance").alias("distance"))


def similar_image_groups(images: DataFrame, threshold: int = 8) -> DataFrame:
    """``(rep_path, path, distance, similarity)``: images and the leader they belong to, groups of two or more.

    In path order an image joins the earliest leader within the threshold, or becomes one; nothing is chained. Leaders are
    found in rounds over signatures, not files.
    ``similarity`` is that of the group's farthest member.
    """
    members, classes = signature_classes(images)
    # a class's number is its place in path order, so each link leads from the earlier to the later one
    ahead = materialize(near_signatures(classes, threshold).withColumnsRenamed({"a": "early", "b": "late"}), "ahead")
    leaders = materialize(leading(ahead.select("early", "late"), classes.select("cls")), "leaders")
    joins = ahead.join(leaders.withColumnRenamed("cls", "early"), "early", "left_semi").join(leaders.withColumnRenamed("cls", "late"), "late", "left_anti")
    joined = joins.groupBy("late").agg(F.min(F.struct("early", "distance")).alias("m")).select(F.col("late").alias("cls"), F.col("m.early").alias("leader"), F.col("m.distance").alias("distance"))
    led = materialize(joined.unionByName(leaders.select("cls", F.col("cls").alias("leader"), F.lit(0).alias("distance"))), "led")
    files = members.join(led, "cls").join(classes.select(F.col("cls").alias("leader"), F.col("lead").alias("rep_path")), "leader").select("rep_path", "path", "distance")
    sums = files.groupBy("rep_path").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where("n > 1").select("rep_path", (1 - F.col("far") / 64).alias("similarity"))
    return files.join(sums, "rep_path")


def leading(ahead: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cls)`` of ``nodes`` that lead: in order, a node leads if no earlier leader is its neighbour (``ahead(early, late)``).

    In each round the nodes without an undecided earlier neighbour lead, and their later neighbours do not; both are
    decided, which is what going through the nodes one by one would decide. No part of the graph is brought into one task.
    """
    out = nodes.join(ahead.select(F.col("late").alias("cls")).distinct(), "cls", "left_anti")
    if ahead.isEmpty():
        return out
    open_, edges = None, ahead
    found = out
    while True:
        settled = materialize(edges.join(found.withColumnRenamed("cls", "early"), "early", "left_semi").select(F.col("late").alias("cls")).distinct(), "settled")
        gone = found.unionByName(settled)
        rest = edges.join(gone.withColumnRenamed("cls", "late"), "late", "left_anti")
        left = rest.select(F.col("late").alias("cls")) if open_ is None else open_.join(gone, "cls", "left_anti")
        open_ = materialize(left.distinct(), "open")
        edges = materialize(rest.join(gone.withColumnRenamed("cls", "early"), "early", "left_anti"), "edges")
        if open_.isEmpty():
            return out
        found = materialize(open_.join(edges.select(F.col("late").alias("cls")).distinct(), "cls", "left_anti"), "found")
        out = out.unionByName(found)
