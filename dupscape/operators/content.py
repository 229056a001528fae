"""Texts that share passages: winnowed fingerprints, containment scores, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscape.functions.text import classification, evidence, normalize_text, symbols, winnow
from dupscape.operators.names import pair_id
from dupscape.operators.skew import salted_pairs, skewed_join
from dupscape.session import materialize, spread

#: The least score of each level, and of the name candidates that go with it.
LEVELS = {"strict": 0.72, "standard": 0.48, "loose": 0.28}
NAME_LEVELS = {"strict": 0.55, "standard": 0.42, "loose": 0.30}


def fingerprints(documents: DataFrame, key: str, text: str, normalize: bool = True) -> DataFrame:
    """``(key, prints)`` by winnowing the normalised text's symbols; texts below 18 symbols have an empty array.

    ``normalize=False`` takes the texts as they are.
    """
    rows = spread(documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")))
    value = normalize_text(F.col("_t")) if normalize else F.col("_t")
    return rows.select(key, winnow(symbols(value)).alias("prints"))


def score(both: Column, first: Column, second: Column) -> Column:
    """0.72 of the coverages' harmonic mean and 0.28 of the greater one."""
    a, b = both / first, both / second
    return 0.72 * (2 * a * b / F.greatest(F.lit(1e-4), a + b)) + 0.28 * F.greatest(a, b)


def least_shared(size: Column, level: float) -> Column:
    """How many prints a set of ``size`` shares at least with any other set that it reaches ``level`` with.

    As the larger of two sets it shares least if it holds the smaller one whole: then 1.44 s / (s + size) + 0.28 is the score
    of s shared prints. As the smaller one it shares ``level`` times its size or more, which is not less.
    """
    rest = max(level - 0.28, 0.0)
    return F.greatest(F.lit(1), F.ceil(size * (rest / (1.44 - rest)) - 1e-6))


def similar_classes(classes: DataFrame, level: float) -> DataFrame:
    """``(ca, cb, similarity, x, y)`` of classes ``(cls, prints, n)`` that reach ``level``, ca < cb; x, y are their coverages.

    With prints from the rarest on, a set that shares k prints with another shares one of its first n - k + 1; the
    smaller set of a pair shares ``level`` times its size, the larger :func:`least_shared`. So a print is a posting of its
    set as the larger one or also as the smaller one, and prints that most texts hold are seldom a posting at all. What
    shares a posting, and has room for the overlap after its place, is verified on the whole sets.
    """
    each = classes.select("cls", "n", F.explode("prints").alias("print"))
    frequency = each.groupBy("print").agg(F.count(F.lit(1)).alias("df"))
    each = skewed_join(each, frequency.where("df > 1"), ["print"], ["cls"])
    # alone: prints that no other set holds come first in the order and are never shared
    shared = each.groupBy("cls").agg(F.count(F.lit(1)).alias("held"))
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("df", "print"))).join(shared, "cls")
    placed = placed.withColumn("place", F.col("place") + F.col("n") - F.col("held"))
    small = F.ceil(F.col("n") * level - 1e-6)
    placed = placed.where(F.col("place") <= F.col("n") - least_shared(F.col("n"), level) + 1).withColumn("small", F.col("place") <= F.col("n") - small + 1)
    postings = materialize(placed.select("cls", "n", "print", "place", "small"), "postings")
    pairs = salted_pairs(postings, ["print"], "cls", ["n", "place", "small"])
    a_less = F.col("n_a") <= F.col("n_b")
    less, more = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    needed = level / (1.44 / (less + more) + 0.28 / less) - 1e-6
    role = F.when(a_less, F.col("small_a")).otherwise(F.col("small_b")) | ((F.col("n_a") == F.col("n_b")) & F.col("small_b"))
    room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed
    pairs = materialize(pairs.where(role & (less >= needed) & room).select(F.col("cls_a").alias("ca"), F.col("cls_b").alias("cb")).distinct(), "candidates")
    left = classes.select(F.col("cls").alias("ca"), F.col("prints").alias("pa"))
    right = classes.select(F.col("cls").alias("cb"), F.col("prints").alias("pb"))
    joined = pairs.join(left, "ca").join(right, "cb")
    counted = joined.select("ca", "cb", F.size(F.array_intersect("pa", "pb")).alias("both"), F.size("pa").alias("na"), F.size("pb").alias("nb"))
    scored = counted.withColumn("similarity", score(F.col("both"), F.col("na"), F.col("nb"))).where(F.col("similarity") >= level)
    return scored.select("ca", "cb", "similarity", (F.col("both") / F.col("na")).alias("x"), (F.col("both") / F.col("nb")).alias("y"))


def content_classes(documents: DataFrame, key: str, text: str, level: str = "standard", normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents by equal fingerprint set, and the links between sets: ``members(id, cls)`` and ``links(ca, cb, similarity, x, y)``.

    As large as the documents and the similar sets, however many copies a text has. A pair without a common fingerprint
    cannot reach any level, so the inverted join finds every pair that the comparison of all would. A document without
    a fingerprint has no class; null texts and texts below 18 symbols have none.
    """
    prints = materialize(fingerprints(documents, key, text, normalize).where(F.size("prints") > 0).withColumn("cls", F.sha2(F.array_join("prints", ","), 256)), "prints")
    classes = materialize(prints.groupBy("cls").agg(F.first("prints").alias("prints")).withColumn("n", F.size("prints")), "classes")
    return materialize(prints.select(F.col(key).alias("id"), "cls").distinct(), "members"), materialize(similar_classes(classes, LEVELS[level]), "links")


def content_matches(documents: DataFrame, key: str, text: str, level: str = "standard", candidates: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """``(first, second, similarity, first_coverage, second_coverage, classification)`` of pairs at or above the level.

    The pairs of :func:`content_classes`, given their documents; a text copied very often is spread over tasks.
    ``candidates(first, second)`` restricts the result to pairs chosen before. Texts are normalised unless ``normalize`` is false.
    """
    members, links = content_classes(documents, key, text, level, normalize)
    one = F.lit(1.0)
    same = salted_pairs(members, ["cls"], "id").select(F.col("id_a").alias("p"), F.col("id_b").alias("q"), one.alias("similarity"), one.alias("x"), one.alias("y"))
    first = skewed_join(members.select(F.col("cls").alias("ca"), F.col("id").alias("p")), links, ["ca"], ["p"]).drop("ca")
    cross = skewed_join(members.select(F.col("cls").alias("cb"), F.col("id").alias("q")), first, ["cb"], ["q"]).drop("cb")
    pairs = same.unionByName(cross)
    turned = F.col("p") > F.col("q")
    out = pairs.select(
        F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), "similarity",
        F.when(turned, F.col("y")).otherwise(F.col("x")).alias("first_coverage"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("second_coverage"),
    )
    if candidates is not None:
        out = out.join(candidates.select("first", "second").distinct(), ["first", "second"], "left_semi")
    return out.withColumn("classification", classification(F.col("similarity"), F.col("first_coverage"), F.col("second_coverage")))


def with_evidence(matches: DataFrame, documents: DataFrame, key: str, text: str, delimiter: str = "[。；]", normalize: bool = True) -> DataFrame:
    """``matches`` with ``match_id`` and up to three excerpts of the first text, normalised as for the matches, that the second holds."""
    value = normalize_text(F.col(text)) if normalize else F.col(text)
    a = documents.select(F.col(key).alias("first"), value.alias("_a")).dropDuplicates(["first"])
    b = documents.select(F.col(key).alias("second"), value.alias("_b")).dropDuplicates(["second"])
    joined = matches.join(a, "first").join(b, "second")
    found = joined.withColumn("evidence", evidence(F.col("_a"), F.col("_b"), delimiter))
    return found.withColumn("match_id", pair_id(F.col("first").cast("string"), F.col("second").cast("string"))).drop("_a", "_b")
