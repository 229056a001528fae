import random

import numpy as np

from dupscape.llm.leakage import HammingBlocks, item_indexes, leaked_items, run_hashes, shares_run, shingle_hashes, simhash, weighted_jaccard
from dupscape.llm.lookalikes import comparable, points
from dupscape.llm.residue import BREAK, EXEMPLARS, FIELD, Exemplars, read, residue_coverage, residue_documents


def test_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 50).astype(np.uint64) * np.uint64(5)
    for count in (1, 2, 9, 27):
        got = simhash(h, np.arange(10), count)
        for s in range(10):
            votes = ((h[s : s + count, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
            assert int(got[s]) == sum(1 << i for i in range(64) if votes[i] * 2 > count)


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    queries = prints[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 1, 2, 3):
        q, f = HammingBlocks(prints, radius).lookup(queries)
        want = {(i, j) for i in range(100) for j in range(300) if int(queries[i] ^ prints[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), f.tolist())) == want and len(q) == len(want)


def test_leaks_equal_brute_force(spark, rows):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmn"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, "en", prose(60)) for i in range(8)] + [(20, "zh", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒"), (21, "zh-CN", "短"), (22, None, None), (23, "en", ""), (0, "en", items0 := prose(60))]
    docs = []
    for n in range(60):
        item = items[n % 9][2]
        plain = len(item)
        start, size = rng.randrange(plain), rng.randrange(10, plain)
        piece = item[start : start + size]
        if n % 4 == 1:
            piece = piece.upper()
        if n % 4 == 2:
            piece = piece.replace("a", "а").replace(" ", " ")
        docs.append((n, prose(rng.randrange(40)) + " " + piece + " " + prose(rng.randrange(40))))
    docs += [(100, None), (101, ""), (102, items[1][2] * 30), (102, items[1][2] * 30)]
    d = spark.createDataFrame([(i, t, "en", "x") for i, t in docs], "doc_id bigint, text string, lang string, item string")
    e = spark.createDataFrame([(i, lang, t) for i, lang, t in items], "item_id bigint, lang string, text string")
    form = lambda t: comparable([t or ""])[0].astype("<u4").tobytes().decode("utf-32-le")
    want = set()
    for i, lang, t in items:
        need, f = (25 if (lang or "").startswith("zh") else 60), form(t)
        for n, text in docs:
            g = form(text)
            if any(f[k : k + need] in g for k in range(len(f) - need + 1)):
                want.add((n, i))
    assert rows(leaked_items(d, e)) == sorted(want, key=str) and want and items0
    assert rows(leaked_items(d, e, block_chars=500)) == sorted(want, key=str)
    assert rows(leaked_items(d.limit(0), e)) == [] and rows(leaked_items(d, e.limit(0))) == []
    near = rows(leaked_items(d, e, similarity=0.9))
    assert (102, 1) in near


def test_run_and_weighted_similarity():
    for size in (1, 2, 3, 7, 25, 60):
        text = "".join(random.Random(size).choices("abc", k=200))
        found = run_hashes(points(text), size)
        assert len(found) == 201 - size and len(set(found.tolist())) == len({text[i : i + size] for i in range(201 - size)})
    assert shares_run(points("xxabcdef"), points("abxdefabcd"), 4) and not shares_run(points("abcdef"), points("abxdef"), 4) and not shares_run(points(""), points("a"), 3)
    assert weighted_jaccard(points("abcabcabc"), points("abcabcabc")) == 1.0 and weighted_jaccard(points("abcd"), points("wxyz")) == 0.0
    assert len(shingle_hashes(points("abc"))) == 0


BOOK = "It took 116 days to see why the worn satchel opened until the bell rang. The envelope of Lekibabi was distant, and the manuscript beside it faint."
RESIDUE = [
    "Please enable JavaScript to read this book.", "404 Not Found\nThe page you asked for is not on this server.", "<h1>Title: {{title}}</h1>\n<p>By &lt;your name here&gt;</p>", "TBD TBD TBD",
    "L o r e m   i p s u m   d o l o r   v i t a e   a r c u", "LOREM IPSUM DOLOR SIT AMET, CONSECTETUR ADIPISCING ELIT.", "此处添加内容 此处添加内容", "Copyright %book.name% @@date@@", "权限不足，无法打开此文件。\r\nAccess denied",
]
CONTENT = [BOOK, BOOK + " A server answers 404 Not Found when a page has moved.", BOOK + "\nDear {{name}}, your copy is ready.", 'if (size >= 0x0F) { return null; }', r"\frac{a}{b} + \sum_{i=0}^{n} x_i", "", "   ", "没有人清点过枫黛的目录，除了那完整的冰川。", "a" * 5000]


def test_residue(spark, rows):
    data = [(i, t) for i, t in enumerate(RESIDUE)] + [(100 + i, t) for i, t in enumerate(CONTENT)] + [(200, None), (0, RESIDUE[0]), (300, (BOOK + "\n") * 400 + RESIDUE[0]), (301, RESIDUE[0] + "\n" + BOOK[:20])]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "key bigint, body string, text string")
    assert [r[0] for r in rows(residue_documents(df, "key", "body"))] == sorted([*range(len(RESIDUE)), 301], key=lambda x: str((x,)))
    assert rows(residue_documents(df.limit(0), "key", "body")) == []
    share = {r.key: r.coverage for r in residue_coverage(df, "key", "body").collect()}
    assert 0 < share[300] < 0.01


def test_reading():
    assert read(["A {{x}} 12!\nb", "", "  ", "中文"]) == [["a", FIELD, "0", BREAK, BREAK, "b"], [], [], ["中", "文"]]
    known = Exemplars.of(EXEMPLARS)
    assert "lorem" in known.words and FIELD in known.parts


def test_common_han_are_letters():
    assert len(comparable(["人口手竹文立比火一入子言谷鼓舟"])[0]) == 15


def test_repetitive_texts_cost_no_product():
    import time

    index = item_indexes([(1, "en", "a" * 2000), (2, "en", "ab" * 500)], frozenset(), 60, 25, 1)[0]
    cps, offsets = comparable(["a" * 80_000, "ba" * 40, "b" * 500])
    began = time.time()
    assert index.search(cps, offsets, shingle_hashes(cps)) == {(0, 0), (1, 1)}
    assert time.time() - began < 1


def test_similar_stretches_by_brute_force():
    rng = random.Random(9)
    words = [f"{a}{b}{c}{d}" for a in "bdgk" for b in "aeiou" for c in "lmnr" for d in "stx"]
    prose = lambda n: rng.choices(words, k=n)
    items = [(i, "en", " ".join(prose(rng.randrange(30, 90)))) for i in range(8)] + [(98, "en", ""), (99, "en", "ab"), (97, None, None)]
    docs = []
    for n in range(60):
        piece = items[rng.randrange(8)][2].split()
        for _ in range(rng.choice([0, 1, 2, 3, 8])):
            piece[rng.randrange(len(piece))] = rng.choice(words)
        docs.append(" ".join(prose(rng.randrange(60)) + piece + prose(rng.randrange(60))))
    docs += [items[0][2], "", "ab", items[1][2][:20]]
    index = item_indexes(items, frozenset(), 60, 25, 1, 0.8)[0]
    cps, offsets = comparable(docs)
    got = {(d, index.ids[i]) for d, i in index.search(cps, offsets, shingle_hashes(cps))}
    want = set()
    for d in range(len(docs)):
        text = cps[offsets[d] : offsets[d + 1]]
        for i, own in zip(index.ids, index.texts):
            at = range(0, max(len(text) - len(own), 0) + 1, 2)
            if any(weighted_jaccard(text[k : k + len(own)], own) >= 0.8 for k in at):
                want.add((d, i))
    print(f"similar stretches: {len(got & want)} of {len(want)}")
    assert len(want) > 30 and len(got & want) >= 0.9 * len(want)
