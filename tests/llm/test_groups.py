import random
from datetime import datetime

from pyspark.sql import functions as F

from dupscape.llm.components import component_ids, linked_groups
from dupscape.functions.text import winnowed
from dupscape.llm.history import FileHistory, TextHistory, file_fingerprints, known_records, overlapping_records, text_fingerprints, usable_hash
from dupscape.llm.survivors import is_real, learned_precedence, style, survivors


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_groups_equal_union_find(spark, rows):
    rng = random.Random(2)
    name = lambda i: f"/p/{i:04d}é"
    pairs = [(name(i), name(i + 1)) for i in range(150)] + [(name(500), name(501 + i)) for i in range(80)] + [(name(1000 + rng.randrange(60)), name(1000 + rng.randrange(60))) for _ in range(50)]
    given = pairs + [(b, a) for a, b in pairs[:20]] + [(name(2000), name(2000)), (None, name(3)), (name(3001), None), (None, None)] + pairs[:5]
    rng.shuffle(given)
    df = spark.createDataFrame([(a, b, "x") for a, b in given], "a string, b string, v string")
    assert rows(linked_groups(df, "a", "b")) == sorted(union_find([(a, b) for a, b in pairs if a != b]).items())
    assert rows(linked_groups(df.limit(0), "a", "b")) == []


def test_ids_keep_loops(spark):
    out = component_ids(spark.createDataFrame([(1, 2), (5, 5), (None, 3)], "a bigint, b bigint"))
    found = {r.v: r.root for r in out.collect()}
    assert found[1] == found[2] and found[5] == 5 and set(found) == {1, 2, 5}


HEX = {c: (c * 3 + "0123456789abcdef" * 4)[:64] for c in "abcdef"}


def test_usable_hash(spark):
    forms = [HEX["a"], HEX["a"].upper(), "sha256:" + HEX["a"], " SHA-256:" + HEX["a"] + "\n", "0" * 64, "f" * 64, HEX["a"][:40], "pending", "", None]
    out = [r.h for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").orderBy("i").select(usable_hash(F.col("f")).alias("h")).collect()]
    assert out == [HEX["a"]] * 4 + [None] * 6


SCHEMA = "record_id bigint, session_no int, file_size bigint, sample_hash string, full_hash string, kind string"
FILES = [
    (1, 1, 100, HEX["a"], None), (2, 2, 100, HEX["a"].upper(), HEX["a"]), (3, 2, 101, HEX["a"], HEX["a"]), (4, 1, 500_000, HEX["b"], HEX["c"]), (5, 3, 500_000, HEX["b"], HEX["d"]),
    (6, 4, 500_000, HEX["b"], "sha256:" + HEX["d"]), (7, 4, 500_000, HEX["e"], HEX["d"]), (8, 2, 0, HEX["a"], HEX["a"]), (9, 3, None, HEX["a"], HEX["a"]), (10, 1, 500_000, HEX["b"], HEX["c"]),
    (0, 5, 500_000, None, HEX["c"]), (11, None, 100, HEX["a"], HEX["a"]), (None, 2, 100, HEX["a"], HEX["a"]), (2, 2, 100, HEX["a"].upper(), HEX["a"]),
]
WANT = [(0, 4, "exact"), (2, 1, "exact"), (5, 4, "near"), (6, 5, "exact"), (7, 5, "exact")]


def prints_of(df):
    return file_fingerprints(df, "record_id", "session_no", "file_size", "sample_hash", "full_hash")


def test_known_records(spark, rows):
    df = spark.createDataFrame([(*f, "x") for f in FILES], SCHEMA)
    assert rows(known_records(prints_of(df)), "record", "earlier", "kind") == WANT
    assert rows(known_records(prints_of(df), words=1), "record", "earlier", "kind") == WANT
    assert rows(known_records(prints_of(df.limit(0)))) == []


def test_batches_against_a_stored_history(spark, rows, tmp_path):
    df = spark.createDataFrame([(*f, "x") for f in FILES], SCHEMA)
    index = FileHistory(spark, f"file://{tmp_path}/history", 64, parts=4)
    found = []
    for batch in (1, 2, 3, 4, 5):
        new = prints_of(df.where(F.col("session_no") == batch))
        found += rows(index.check(new), "record", "earlier", "kind")
        index.update(new, batch)
        index.update(new, batch)  # written twice, counted once
    assert sorted(found, key=str) == WANT


def test_real_values(spark):
    given = ["Real", "  ", "", None, "--", "?", "N/A", "n/a", "(no title)", "UNKNOWN", "Unknown Author", "未知", "佚名", "Sans titre", "ohne Titel", "Без названия", "300", "Noah"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").orderBy("i").select(is_real(F.col("v")).alias("r"))
    assert [v for v, r in zip(given, df.collect()) if r.r] == ["Real", "300", "Noah"]


def test_survivors(spark, rows):
    at = lambda y: datetime(y, 1, 1)
    data = [("g", 1, "Old", 1, 10, at(2001)), ("g", 2, "none", 1, None, at(2005)), ("g", 3, "New", 0, 99, at(2009)), ("g", 3, "New", 0, 99, at(2009)), ("h", 5, None, 0, None, None), ("h", 4, "-", 0, None, None), (None, 9, "x", 1, 1, at(2000)), ("i", None, "x", 1, 1, at(2000))]
    df = spark.createDataFrame(data, "group_id string, file_id bigint, title string, trusted int, size bigint, dated timestamp").withColumn("x", F.lit("clash"))
    order = [F.col("trusted"), F.unix_micros("dated")]
    out = survivors(df, "group_id", "file_id", {"path": None, "title": F.col("title")}, order, field_order={"path": [F.col("trusted"), F.col("size")]})
    assert rows(out) == [("g", "path", 1), ("g", "title", 1), ("h", "path", 4)]
    assert rows(survivors(df.limit(0), "group_id", "file_id", {"path": None}, order)) == []


def test_learned_precedence_places_undated_values(spark, rows):
    at = lambda y: datetime(y, 1, 1)
    data = [(f"t{i}", 1, "a_title", at(2001)) for i in range(5)] + [(f"t{i}", 2, "A Title", at(2004)) for i in range(5)]
    data += [("u", 1, "b_title", at(2010)), ("u", 2, "B Title", None), ("w", 1, "B Title", at(2010)), ("w", 2, "b_title", None), ("z", 1, "b_title", None), ("z", 2, "B Title", None)]
    df = spark.createDataFrame(data, "g string, id bigint, title string, dated timestamp")
    before = learned_precedence(df, ["g"], "title", "dated")
    assert before == {("ul", "")}
    out = survivors(df, "g", "id", {"title": F.col("title")}, [], when="dated", learned={"title": before})
    assert [r for r in rows(out) if r[0] in "uwz"] == [("u", "title", 2), ("w", "title", 1), ("z", "title", 2)]
    assert df.select(style(F.col("title"))).distinct().count() == 2


def test_incomparable_styles_stay_incomparable(spark, rows):
    at = lambda y: datetime(y, 1, 1)
    data = [("a", 1, "AA", at(2010)), ("a", 2, "Aa_b", None), ("b", 1, "x, y", at(2010)), ("b", 2, "Aa", None), ("c", 1, "Aa", None), ("c", 2, "Aa_b", None), ("c", 3, "AA", None), ("d", 1, "Aa", at(2001)), ("d", 2, "Aa_b", None)]
    df = spark.createDataFrame(data, "g string, id bigint, title string, dated timestamp")
    out = survivors(df, "g", "id", {"title": F.col("title")}, [], when="dated", learned={"title": {("", "u")}})
    # dated and incomparable: the dated one; later style: the undated one; an undated one of no known style: the smaller row
    assert rows(out) == [("a", "title", 1), ("b", "title", 1), ("c", "title", 2), ("d", "title", 2)]


def test_text_overlaps_equal_brute_force(spark, rows, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    books = [prose(120) for _ in range(6)]
    data = []
    for i in range(40):
        words = rng.choice(books).split()
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words[rng.randrange(len(words))] = "edited"
        data.append((i, rng.randrange(1, 5), " ".join(words[: rng.choice([60, 120])])))
    data += [(100, 2, None), (101, 3, ""), (102, None, books[0]), (None, 2, books[0]), (103, 4, "short")]
    df = spark.createDataFrame([(*d, "x") for d in data], "id bigint, batch int, text string, record string")
    squeeze = lambda t: "".join(c for c in t.lower() if c.isalnum())
    sets = {i: (b, set(winnowed(squeeze(t)).tolist())) for i, b, t in data if i is not None and b is not None and t and len(squeeze(t)) >= 18}
    want = []
    for i, (b, s) in sets.items():
        best = min(((-len(s & o) / len(s), j) for j, (c, o) in sets.items() if c < b and len(s & o) / len(s) >= 0.8), default=None)
        if best:
            want.append((i, best[1], -best[0]))
    prints = text_fingerprints(df, "id", "batch", "text")
    for block in (256, 2):
        assert rows(overlapping_records(prints, block=block)) == sorted(want, key=str)
    index, found = TextHistory(spark, f"file://{tmp_path}/texts", 256, parts=4), []
    for b in (1, 2, 3, 4):
        found += rows(index.check(prints.where(F.col("batch") == b)))
        index.update(prints, b)
        index.update(prints, b)
    assert sorted(found, key=str) == sorted(want, key=str)
    assert want and rows(overlapping_records(text_fingerprints(df.limit(0), "id", "batch", "text"))) == []


def test_groups_with_a_hub_and_one_large_component(spark, rows, monkeypatch):
    from dupscape.llm import components

    monkeypatch.setattr(components, "HUB", 6)
    pairs = [("hub", f"n{i:03d}") for i in range(90)] + [(f"n{i:03d}", f"z{i:03d}") for i in range(0, 90, 4)] + [("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert rows(linked_groups(df, "a", "b")) == sorted(union_find(pairs).items())
