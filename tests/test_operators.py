import json
import random

import pytest
from pyspark.sql import functions as F

from dupscape.functions.bits import bands, hamming
from dupscape.functions.text import classification, evidence, grams, name_key, normalize_text, prefilter_key, strip_markup, title, winnowed
from dupscape.operators import content, exact, images, inventory, library, names, report, review, state
from dupscape.operators.graph import connected_components
from dupscape.operators.inventory import ScanOptions, parse_extensions
from dupscape.paths import ancestors, below, extension, parent, plain, within


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, root, want", [("/library/A/course/x", "/library/tmp/../A/", True), ("/library/AB", "/library/A", False), ("/library/A", "/", True), ("/a/b", "//a/./b", True)])
def test_within(spark, path, root, want):
    assert one(spark, within(F.col("p"), plain("r")), p=path, r=root) is want


def test_path_functions(spark):
    p = "/a/b/c.tar.GZ"
    assert one(spark, parent("p"), p=p) == "/a/b" and one(spark, parent("p"), p="/a") == "/" and one(spark, parent("p"), p="/") is None
    assert one(spark, extension("p"), p=p) == "gz" and one(spark, extension("p"), p="/a/.hidden") == ""
    assert one(spark, ancestors("p"), p=p) == ["/", "/a", "/a/b"] and one(spark, ancestors("p"), p="/x") == ["/"]
    assert one(spark, below("p", F.lit("/a")), p="/a") is False and one(spark, plain("p"), p=None) is None
    assert one(spark, plain("p"), p="/../a//b/") == "/a/b"


def test_name_keys(spark):
    assert one(spark, name_key(F.col("n")), n="Ｔｈｅ Book - Copy (2).pdf") == "thebook"
    assert one(spark, name_key(F.col("n")), n="书名副本.epub") == "书名" and one(spark, name_key(F.col("n")), n="...") == ""
    assert one(spark, prefilter_key(F.col("n")), n="a.b.pdf") == "a"
    assert one(spark, grams(F.col("k")), k="abcab") == ["abc", "bca", "cab"] and one(spark, grams(F.col("k")), k="ab") == ["ab"] and one(spark, grams(F.col("k")), k="") == []


def test_text_functions(spark):
    assert one(spark, strip_markup(F.col("t")), t="<SCRIPT>x</SCRIPT><p>a&amp;lt;b</p>") == " \na<b\n"
    assert one(spark, normalize_text(F.col("t")), t=" ａ\n 12 \nb　c ") == "a b c"
    assert one(spark, title(F.col("t"), F.lit("f")), t="T") == "f" and one(spark, title(F.col("t"), F.lit("f")), t="Ab\nc") == "Ab"
    long = "This sentence is long enough to count"
    assert one(spark, evidence(F.col("a"), F.col("b"), r"\."), a=f"{long}. {long}.short.", b=long.upper()) == [long]
    assert [one(spark, classification(F.lit(s), F.lit(a), F.lit(0.9)), x="") for s, a in ((0.9, 0.8), (0.9, 0.5), (0.3, 0.9))] == ["high", "much", "partial"]


def test_winnow_by_definition():
    rng = random.Random(0)
    for n in (0, 17, 18, 40, 64, 65, 66, 200):
        text = "".join(rng.choices("abcxyz中文", k=n))
        codes = [ord(c) + 1 for c in text]
        hashes = [sum(c * pow(1_099_511_628_211, 17 - k, 1 << 64) for k, c in enumerate(codes[i : i + 18])) % (1 << 64) for i in range(n - 17)]
        want = {min(hashes[i : i + 48]) for i in range(len(hashes) - 47)} or set(hashes[-1:])
        assert set(winnowed(text).tolist()) == want


def test_bands_lose_nothing(spark):
    rng = random.Random(1)
    for t in (1, 4, 12):
        x = rng.getrandbits(63)
        y = x
        for b in rng.sample(range(64), t):
            y ^= 1 << b
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        df = spark.createDataFrame([(signed(x), signed(y))], "x bigint, y bigint")
        r = df.select(bands(F.col("x"), t).alias("p"), bands(F.col("y"), t).alias("q"), hamming(F.col("x"), F.col("y")).alias("d")).first()
        assert r.d == t and any(a == b for a, b in zip(r.p, r.q)) and len(r.p) == t + 1


def test_options():
    assert parse_extensions(".PDF, epub；mobi  .azw3") == ("pdf", "epub", "mobi", "azw3")
    assert ScanOptions(minimum_size=5, maximum_size=4).problems(["/a"]) and ScanOptions().problems([]) and not ScanOptions().problems(["/a"])
    assert ScanOptions(mode="reference", reference_paths=("/a/b",)).problems(["/a", "/a/b"])
    assert not ScanOptions(mode="reference", reference_paths=("/a",)).problems(["/a", "/b"])


def test_exact_groups(spark, rows):
    data = [("/a", b"same"), ("/b", b"same"), ("/c", b"diff"), ("/d", b"x" * 20 + b"1" + b"x" * 40), ("/e", b"x" * 20 + b"2" + b"x" * 40), ("/f", None)]
    files = spark.createDataFrame(data, "path string, content binary").withColumn("size", F.octet_length("content").cast("bigint"))
    assert rows(exact.sample_candidates(files, block=4), "path") == [("/a",), ("/b",), ("/d",), ("/e",)]
    found = exact.hashed_candidates(files, block=4)
    assert rows(found, "path") == [("/a",), ("/b",)]
    assert rows(exact.duplicate_groups(found), "file_count", "reclaimable_bytes") == [(2, 4)]
    assert rows(exact.summary(found.limit(0))) == [(0, 0, 0)]


def test_library(spark, rows):
    data = [("/A/one", "old"), ("/B/copy", "old"), ("/B/new-one", "new"), ("/B/new-two", "new"), ("/B/unreadable", None), ("/B/new-two", "new")]
    files = spark.createDataFrame([(p, 10, h) for p, h in data], "path string, size bigint, full_hash string")
    assert rows(library.unique_targets(files, ["/A"]), "path") == [("/B/new-one",), ("/B/new-two",)]
    assert rows(library.unique_targets(files, ["/A"], incomplete=True)) == []
    broken = files.unionByName(spark.createDataFrame([("/A/x", 1, None)], files.schema))
    assert rows(library.unique_targets(broken, ["/A"])) == []
    assert rows(library.cross_groups(files, ["/A"]), "path", "in_reference") == [("/A/one", True), ("/B/copy", False)]


def tree(spark, names_, folders):
    files = spark.createDataFrame([(p, 10, h) for p, h in names_], "path string, size bigint, full_hash string")
    return files, spark.createDataFrame([(f,) for f in folders], "path string")


def test_folders(spark, rows):
    files = [("/A/course/l", "x"), ("/B/course/l", "x"), ("/C/course/renamed", "x"), ("/D/course/l", "x")]
    folders = ["/A/course", "/A/course/empty", "/B/course", "/B/course/empty", "/C/course", "/C/course/empty", "/D/course"]
    found = library.duplicate_folders(*tree(spark, files, folders))
    assert rows(found, "folder", "file_count") == [("/A/course", 1), ("/B/course", 1)]
    assert rows(library.duplicate_folders(*tree(spark, files, folders), reference=["/A"]), "folder") == [("/A/course",), ("/B/course",)]
    assert rows(library.duplicate_folders(*tree(spark, files, folders), reference=["/A/course/empty"])) == []
    unread = spark.createDataFrame([("/A/course/empty",)], "path string")
    assert rows(library.duplicate_folders(*tree(spark, files, folders), incomplete=unread)) == []
    unknown = [*files, ("/A/course/empty/u", None)]
    assert rows(library.duplicate_folders(*tree(spark, unknown, folders))) == []
    assert rows(library.duplicate_folders(*tree(spark, [], []))) == []


def test_inventory(spark, rows):
    df = spark.createDataFrame([("/r/a", 1, 1), ("/r/b", 1, 1), ("/r/s/.h/c", 2, 5), ("/r/s/d", None, 7), ("/q/e", 1, 2)], "path string, device int, inode bigint").withColumn("size", F.lit(5))
    assert rows(inventory.one_per_identity(df, preferred=F.col("path") == "/r/b"), "path", "aliases") == [("/q/e", 1), ("/r/b", 2), ("/r/s/.h/c", 1), ("/r/s/d", 1)]
    assert rows(inventory.below_roots(df, ["/r", "/r"], ScanOptions()), "path") == [("/r/a",), ("/r/b",), ("/r/s/d",)]
    assert rows(inventory.below_roots(df, ["/r"], ScanOptions(recursive=False)), "path") == [("/r/a",), ("/r/b",)]
    roots = lambda *r: spark.createDataFrame([(x,) for x in r], "path string")
    assert rows(inventory.disjoint_roots(roots("/a/b", "/c", "/ab", "/d"), roots("/a", "/d/e"))) == [("/ab",), ("/c",)]


def test_names(spark, rows):
    files = spark.createDataFrame([("/x/The Long Book.pdf", 100), ("/y/The Long Book (1).epub", 59), ("/z/Other.pdf", None), ("/w/....pdf", 1), ("/x/The Long Book.pdf", 100)], "path string, size bigint")
    assert rows(names.name_matches(files, 0.85)) == []
    assert rows(names.name_matches(files, 0.8), "score") == [(1.0,)]
    matches = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.8), ("X", "Y", 0.7)], "first_path string, second_path string, score double")
    sizes = spark.createDataFrame([("A", 100), ("B", 80), ("C", 60), ("X", 5)], "path string, size bigint")
    assert rows(names.match_groups(matches, sizes)) == [("A", 3, 0.9, 100, 140), ("X", 2, 0.7, 5, None)]
    assert [r.group_id for r in names.ranked_groups(names.match_groups(matches, sizes)).orderBy("position").collect()] == ["A", "X"]


def test_prefix_filter_equals_exact_join(spark, rows):
    rng = random.Random(9)
    keys = {"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(120)}
    classes = spark.createDataFrame([(k,) for k in keys], "key string").select("key", grams(F.col("key")).alias("grams")).withColumn("n", F.size("grams"))
    sets = {k: {k[i : i + 3] for i in range(len(k) - 2)} or {k} for k in keys}
    for least in (0.35, 0.55, 0.8):
        want = {(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in names.similar_keys(classes, least).collect()} == want


def test_components(spark, rows):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 5)]
    rng = random.Random(3)
    rng.shuffle(edges)
    found = {r.member: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_content(spark, rows):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    book = prose(300)
    part = " ".join(book.split()[100:200])
    docs = spark.createDataFrame([("a", book), ("b", book.upper()), ("c", prose(20) + part), ("d", prose(300)), ("e", ""), ("f", None)], "path string, text string")
    found = {(r.first, r.second): r for r in content.content_matches(docs, "path", "text", "loose").collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert found["a", "b"].similarity == 1.0 and found["a", "b"].classification == "high" and found["a", "c"].second_coverage > found["a", "c"].first_coverage
    chosen = spark.createDataFrame([("a", "c")], "first string, second string")
    assert content.content_matches(docs, "path", "text", "loose", chosen).count() == 1


def test_leaders_do_not_chain(spark, rows):
    df = spark.createDataFrame([("/a", [0], 120.0, 20.0), ("/b", [15], 120.0, 20.0), ("/c", [255], 120.0, 20.0)], "path string, hashes array<bigint>, mean double, deviation double")
    assert rows(images.similar_image_groups(df, 4), "rep_path", "path", "distance") == [("/a", "/a", 0), ("/a", "/b", 4)]
    flat = spark.createDataFrame([("/a", [7], 0.0, 0.0), ("/b", [7], 255.0, 0.0)], df.schema)
    assert rows(images.similar_image_groups(flat, 12)) == []


def test_leaders_equal_the_sequential_rule(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(62) for _ in range(5)]
    data = []
    for i in range(60):
        h = rng.choice(base)
        for b in rng.sample(range(62), rng.randint(0, 4)):
            h ^= 1 << b
        data.append((f"/{i:03d}", [h], 120.0, 20.0))
    leaders, want = [], {}
    for p, (h,), _, _ in data:
        mine = next((q for q, g in leaders if (h ^ g).bit_count() <= 4), None)
        if mine is None:
            leaders.append((p, h))
        want[p] = mine or p
    df = spark.createDataFrame(data, "path string, hashes array<bigint>, mean double, deviation double")
    got = {r.path: r.rep_path for r in images.similar_image_groups(df, 4).collect()}
    sizes = {p: sum(v == p for v in want.values()) for p in want.values()}
    assert got == {k: v for k, v in want.items() if sizes[v] > 1}


def test_review(spark, rows):
    m = spark.createDataFrame([("g", "/A/x", False), ("g", "/B/longer", False), ("g", "/B/y", True), ("h", "/B/p/1", False), ("h", "/B/2", False)], "full_hash string, path string, is_network boolean")
    found = review.suggested_keepers(m, "full_hash", protected=["/A"], preferred=["/B/p"], network="is_network")
    assert rows(found, "path", "action") == [("/A/x", "keep"), ("/B/2", "remove"), ("/B/longer", "remove"), ("/B/p/1", "keep"), ("/B/y", "leave")]
    chosen = m.withColumn("sel", F.lit(True))
    assert rows(review.repaired_selection(chosen, "full_hash", "sel").where("not sel"), "path") == [("/A/x",), ("/B/2",)]
    plan = spark.createDataFrame([("g", "/A/x"), ("g", "/B/y"), ("h", "/B/2"), ("h", "/B/p/1"), ("h", "/nope")], "full_hash string, path string")
    assert rows(review.cleanup_problems(plan, m, "full_hash", ["/A"]), "path", "problem") == [("/A/x", "protected"), ("/B/2", "lastCopy"), ("/B/p/1", "lastCopy"), ("/B/y", "network"), ("/nope", "unknownSelection")]


def test_state(spark, rows):
    old = spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("c", 1, 1)], "path string, s bigint, t bigint")
    new = spark.createDataFrame([("a", 1, None), ("b", 1, 3), ("d", 1, 1)], "path string, s bigint, t bigint")
    assert rows(state.reconcile(old, new, ["path"], ["s", "t"])) == [("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")]
    cache = old.withColumn("h", F.concat(F.lit("h"), "path"))
    assert rows(exact.reuse_hashes(new, cache, ["path"], ["s", "t"], ["h"]), "path", "h") == [("a", "ha"), ("b", None), ("d", None)]


def test_reports(spark, rows, tmp_path):
    m = spark.createDataFrame([("h", '/a"b', 3, None, False), ("h", "/c", 3, None, None), ("k", "/d", 1, None, True)], "full_hash string, path string, size bigint, modified_at timestamp, is_network boolean")
    assert rows(report.csv_lines(m)) == [('h,"/a""b",3,,false',), ('h,"/c",3,,',)]
    report.write_csv(m, str(tmp_path / "csv"), upper=True)
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.startswith(report.OTHER_HEADER) and 'H,"/a""b",3,,false' in text
    assert '"reclaimable_bytes":3' in report.json_rows(m).first().json and report.json_rows(m).count() == 1
    many = spark.createDataFrame([("h", f"/{i}", 3, None, False) for i in range(50)], m.schema)
    parts = [json.loads(r.json) for r in report.json_rows(many, most=8).collect()]
    assert sum(len(p["files"]) for p in parts) == 50 and {p["parts"] for p in parts} == {7} and max(len(p["files"]) for p in parts) < 30
