"""One key with a third of all rows: results stay whole and no task gets more than twice its share."""

import random

import pytest
from pyspark.sql import functions as F

from dupscape.operators import graph
from dupscape.operators.content import content_classes, content_matches
from dupscape.operators.names import name_classes, name_matches
from dupscape.operators.skew import crowded, salted_pairs, skewed_join


@pytest.fixture
def hot(spark):
    rng = random.Random(3)
    data = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", f"v{i}") for i in range(3000)]
    return data, spark.createDataFrame(data, "id bigint, key string, v string")


SHUFFLED = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}


def shares(df):
    """Rows of the fullest task of a shuffled join against a task's equal share."""
    conf = df.sparkSession.conf
    old = {k: conf.get(k) for k in SHUFFLED}
    for k, v in SHUFFLED.items():
        conf.set(k, v)
    try:
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            conf.set(k, v)
    return max(counts) / (sum(counts) / 8)


def test_crowded_keys_are_bounded(hot, spark):
    _, df = hot
    assert [(r.key, r._n > 900) for r in crowded(df.where("key is not null"), ["key"], 50).collect()] == [("hot", True)]
    assert crowded(df, ["id"], 50) is None and crowded(df.limit(0), ["key"]) is None
    assert crowded(df, ["key"], 1, most=3).count() == 3


@pytest.mark.parametrize("most", [1, 20_000])
def test_pairs_of_a_hot_key(hot, most):
    data, df = hot
    got = salted_pairs(df.withColumn("id_a", F.lit("clash")), ["key"], "id", ["v"], block=16, most=most)
    by = {}
    for i, k, v in data:
        by.setdefault(k, []).append(i)
    want = sum(len(x) * (len(x) - 1) // 2 for k, x in by.items() if k)
    assert got.columns == ["key", "id_a", "v_a", "id_b", "v_b"]
    assert got.count() == want == got.distinct().count()
    assert shares(got) < 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_with_a_hot_key(hot, spark, how):
    data, df = hot
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3), (None, 4)], "key string, n int")
    plain = df.join(few, "key", how)
    spread = skewed_join(df, few, ["key"], ["id"], how, block=10)
    assert sorted(map(str, spread.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    if how == "inner":
        assert shares(spread) < 2


def test_components_with_a_hub(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "FEW", 8)
    edges = [("m", f"x{i:03d}") for i in range(120)] + [(f"x{i:03d}", f"a{i:03d}") for i in range(0, 120, 7)] + [("q", "q"), (None, "r"), ("s", "t")]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b")))
    ends = {e for edge in edges[:-3] for e in edge}
    assert got == {**dict.fromkeys(ends, "a000"), "q": "q", "s": "s", "t": "s"}


def jaccard(a, b):
    cut = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} or {t}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_one_name_carried_by_a_third(spark, rows):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "harbour", "lantern"]
    data = [(f"/d{i}/" + ("the hot name.pdf" if i % 3 == 0 else " ".join(rng.choices(words, k=3)) + rng.choice(["", " 2", " copy"]) + ".pdf"), i) for i in range(90)]
    df = spark.createDataFrame([*data, data[0], (None, 1), ("/d/.pdf", None)], "path string, size bigint")
    members, links = name_classes(df, 0.55)
    keys = {r.path: r.key for r in members.collect()}
    got = {(r.first_path, r.second_path): round(r.score, 9) for r in name_matches(df, 0.55).collect()}
    want = {}
    for p in keys:
        for q in keys:
            if p < q and (s := jaccard(keys[p], keys[q])) >= 0.55:
                want[p, q] = round(s, 9)
    assert got == want and len(want) > 400
    assert {(r.a, r.b) for r in links.collect()} == {tuple(sorted((keys[p], keys[q]))) for p, q in want if keys[p] != keys[q]}
    empty = df.limit(0)
    assert name_matches(empty).count() == 0 and name_classes(empty)[1].count() == 0


def test_many_similar_names_all_come_out(spark):
    """320 names that are alike in pairs: every pair from the threshold on, no bound on buckets."""
    names = [f"collected papers of the harbour society volume {i:03d}" for i in range(320)]
    df = spark.createDataFrame([(f"/{n}.pdf", 1) for n in names], "path string, size bigint")
    members, links = name_classes(df, 0.55)
    keys = sorted(r.key for r in members.collect())
    want = sum(jaccard(a, b) >= 0.55 for i, a in enumerate(keys) for b in keys[i + 1 :])
    assert links.count() == want == 320 * 319 // 2


@pytest.mark.parametrize("level", ["strict", "standard", "loose"])
def test_contents_with_one_text_in_a_third(spark, level):
    from dupscape.functions.text import winnowed
    from dupscape.operators.content import LEVELS

    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    notice, parts = prose(30), [prose(60) for _ in range(8)]
    texts = [notice + " " + " ".join(rng.sample(parts, rng.choice([1, 2, 4]))) for _ in range(40)] + [notice + " " + parts[0]] * 20 + [None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("cls", F.lit("clash"))
    sets = {i: set(winnowed(t.replace(" ", "")).tolist()) for i, t in enumerate(texts) if t and len(t) > 17}
    want = {}
    for i, a in sets.items():
        for j, b in sets.items():
            c = len(a & b)
            if i < j and c:
                x, y = c / len(a), c / len(b)
                s = 0.72 * 2 * x * y / max(1e-4, x + y) + 0.28 * max(x, y)
                if s >= LEVELS[level]:
                    want[i, j] = round(s, 9)
    assert {(r["first"], r.second): round(r.similarity, 9) for r in content_matches(df, "id", "text", level).collect()} == want
    members, links = content_classes(df, "id", "text", level)
    assert members.count() == len(sets) and links.count() < len(want)
