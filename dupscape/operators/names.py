"""Similar file names: trigram Jaccard joins, groups of linked names and what they waste."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscape.functions.text import grams, name_key, prefilter_key
from dupscape.operators.graph import connected_components
from dupscape.operators.skew import salted_pairs, skewed_join
from dupscape.session import materialize, ranked


def _classes(files: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Files with their key, and one row per distinct non-empty key with its grams: equal names are one class."""
    keyed = materialize(files.select("path", "size", key.alias("key")).where("path is not null and key is not null and key <> ''").dropDuplicates(["path"]), "names")
    classes = materialize(keyed.select("key").distinct().select("key", grams(F.col("key")).alias("grams")).withColumn("n", F.size("grams")), "keys")
    return keyed, classes


def bitmap(grams: Column) -> Column:
    """256 bits, as four numbers, with one bit set for each gram's hash."""
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(256)).cast("int")
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(g) % 64)
    word = lambda i: F.aggregate(grams, F.lit(0).cast("bigint"), lambda s, g: F.when(F.floor(place(g) / 64) == i, s.bitwiseOR(bit(g))).otherwise(s))
    return F.array(*[word(i) for i in range(4)])


def most_shared(size_a: Column, size_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """A bound of the grams that two sets share: each differing bit stands for at least one gram that only one has."""
    differ = F.bit_count(F.get(bits_a, F.lit(0)).bitwiseXOR(F.get(bits_b, F.lit(0))))
    for i in range(1, 4):
        differ = differ + F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i))))
    return (size_a + size_b - differ) / 2


def similar_keys(classes: DataFrame, least: float) -> DataFrame:
    """``(a, b, score)`` for keys whose grams have a Jaccard similarity of ``least`` or more, a < b.

    Prefix filter: with a key's grams from the rarest on, two similar keys share one of their first n - ceil(least n) + 1.
    Ceilings are taken in whole numbers a little low, so rounding never shortens a prefix. Only those grams are joined, a
    crowded one over salts. A pair leaves that join only if sizes, the place of the gram (what comes before it is not
    shared, if it is the first shared one) and the bitmaps of both sets leave room for the needed overlap; the few that
    remain are verified on the whole gram sets.
    """
    each = classes.select("key", "n", F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(frequency, "gram").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("df", "gram")))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1).where("df > 1").select("key", "gram", "place")
    # rows of a key are few: as many as its grams
    held = classes.select("key", "n", bitmap(F.col("grams")).alias("bits"))
    prefix = materialize(prefix.join(held, "key").select("key", "n", "gram", "place", "bits"), "prefix")
    pairs = salted_pairs(prefix, ["gram"], "key", ["n", "place", "bits"])
    needed = (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-6
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (least - 1e-9)
    room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed
    alike = most_shared(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b")) >= needed
    pairs = materialize(pairs.where(near & room & alike).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct(), "candidates")
    left = classes.select(F.col("key").alias("a"), F.col("grams").alias("ga"))
    right = classes.select(F.col("key").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return scored.select("a", "b", (F.col("both") / (F.size("ga") + F.size("gb") - F.col("both"))).alias("score")).where(F.col("score") >= least)


def sizes_fit(first: Column, second: Column, least_score: float) -> Column:
    """From a minimum score of 0.85 on, both sizes must be known and the smaller at least 0.60 of the larger."""
    if least_score < 0.85:
        return F.lit(True)
    ratio = F.when(F.greatest(first, second) == 0, 1.0).otherwise(F.least(first, second) / F.greatest(first, second))
    return F.coalesce(first.isNotNull() & second.isNotNull() & (ratio >= 0.60), F.lit(False))


def pair_id(first: Column, second: Column) -> Column:
    return F.concat_ws("|", F.least(first, second), F.greatest(first, second))


def name_classes(files: DataFrame, least: float = 0.55, name: Column | None = None, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """Files by equal key, and the links between keys: ``members(path, size, key)`` and ``links(a, b, score)``, a < b.

    As large as the files and the similar keys, however many files carry one name. Files with an empty key have no class; a
    path listed twice counts once.
    """
    members, classes = _classes(files, name_key(name if name is not None else F.element_at(F.split("path", "/"), -1), compose))
    return members, materialize(similar_keys(classes, least), "links")


def _expanded(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of files with equal keys, and pairs of files with linked keys; a key of very many files is spread over tasks."""
    rows = members.select("key", F.struct("path", "size").alias("f"), "path")
    same = salted_pairs(rows, ["key"], "path", ["f"]).select(F.col("f_a").alias("x"), F.col("f_b").alias("y"))
    first = skewed_join(rows.select(F.col("key").alias("a"), F.col("f").alias("x")), links, ["a"], ["x"]).drop("a")
    return same, skewed_join(rows.select(F.col("key").alias("b"), F.col("f").alias("y")), first, ["b"], ["y"]).drop("b")


def name_matches(files: DataFrame, least: float = 0.55, name: Column | None = None, compose: bool = True) -> DataFrame:
    """``(match_id, first_path, second_path, score)`` of files with similar names; ``files`` has ``path`` and ``size``.

    Files with the same key match at 1. Keys are compared, not files: a name carried by many files is compared once, and the
    result alone is as large as its pairs; :func:`name_classes` states the same without them. Files with an empty key match
    nothing; a path listed twice counts once.
    """
    members, links = name_classes(files, least, name, compose)
    same, cross = _expanded(members, links)
    pairs = same.withColumn("score", F.lit(1.0)).unionByName(cross).where(sizes_fit(F.col("x.size"), F.col("y.size"), least))
    p, q = F.col("x.path"), F.col("y.path")
    return pairs.select(pair_id(p, q).alias("match_id"), F.least(p, q).alias("first_path"), F.greatest(p, q).alias("second_path"), "score")


def candidate_names(files: DataFrame, least: float, bucket: int = 0, compose: bool = True) -> DataFrame:
    """``(first_path, second_path)`` likely to hold the same content by their names.

    Every pair from ``least`` on, and equal keys always. With a ``bucket``, an option that loses pairs, only grams that 2 to
    ``bucket`` files share make candidates of different keys.
    """
    keyed, classes = _classes(files, prefilter_key(F.element_at(F.split("path", "/"), -1), compose))
    found = similar_keys(classes, least).select("a", "b")
    if bucket:
        each = keyed.join(classes, "key").select("path", "key", F.explode("grams").alias("gram"))
        small = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, bucket)).select("gram")
        kept = each.select("key", "gram").distinct().join(small, "gram", "left_semi")
        share = kept.select(F.col("key").alias("a"), "gram").join(kept.select(F.col("key").alias("b"), "gram"), "gram").where("a < b").select("a", "b").distinct()
        found = found.join(share, ["a", "b"], "left_semi")
    same, cross = _expanded(keyed, found)
    return same.unionByName(cross).select(F.least("x.path", "y.path").alias("first_path"), F.greatest("x.path", "y.path").alias("second_path"))


def match_groups(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(group_id, file_count, highest_score, largest, duplicate_bytes)`` of files linked by matches.

    The group's id is its smallest path. duplicate_bytes is all sizes but the largest, null if a size is unknown.
    """
    members = materialize(connected_components(matches, "first_path", "second_path"), "members")
    ends = matches.select(F.col("first_path").alias("member"), "second_path", "score")
    best = skewed_join(ends, members, ["member"], ["second_path"]).groupBy("component").agg(F.max("score").alias("highest_score"))
    known = members.join(sizes.select(F.col("path").alias("member"), "size").dropDuplicates(["member"]), "member", "left")
    sums = known.groupBy("component").agg(
        F.count(F.lit(1)).alias("file_count"), F.max("size").alias("largest"), F.when(F.count("size") == F.count(F.lit(1)), F.sum("size") - F.max("size")).alias("duplicate_bytes")
    )
    return sums.join(best, "component").select(F.col("component").alias("group_id"), "file_count", "highest_score", "largest", "duplicate_bytes")


def ranked_groups(groups: DataFrame, most: int | None = None) -> DataFrame:
    """Positions for paging: largest file first (unknown last), then score, then id; ``most`` is a page's length."""
    order = [F.coalesce("largest", F.lit(-1)).desc(), F.desc("highest_score"), F.asc("group_id")]
    if most is None:
        return ranked(groups, order)
    return groups.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))
