import random

import numpy as np

from dupscape.llm.near_edits import band_hashes, char_runs, dart_signature, missed, near_duplicate_pairs, near_duplicates
from dupscape.operators.skew import salted_pairs


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    whole = rng.integers(1, 1 << 62, 1500).astype(np.uint64)
    x, y = np.unique(whole[:1000]), np.unique(whole[500:])
    k = 2000
    same = (dart_signature(x, None, k) == dart_signature(y, None, k)).mean()
    assert abs(same - 500 / 1500) < 0.05
    wx, wy = np.full(len(x), 2.0), np.full(len(y), 0.5)
    both = np.intersect1d(x, y)
    expected = 0.5 * len(both) / (2.0 * len(x) + 0.5 * len(y) - 0.5 * len(both))
    assert abs((dart_signature(x, wx, k) == dart_signature(y, wy, k)).mean() - expected) < 0.04
    assert not dart_signature(x[:0], None, 16).any()
    assert len(band_hashes(dart_signature(x, None, 40), 8, 5)) == 8 and missed(0.7, 96, 5) < 1e-6


def test_char_pairs_equal_brute_force(spark, rows):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefgh ijkl.", k=400)) for _ in range(12)]
    data = []
    for i, text in enumerate(base):
        for e in range(4):
            t = list(text)
            for _ in range(e * 3):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            data.append((len(data), "".join(t)))
    data += [(100, base[0].upper()), (101, base[0]), (101, base[0]), (102, None), (103, ""), (104, "..."), (105, "ab"), (106, "AB"), (None, base[0])]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in data], "id bigint, text string, digest string")
    got = rows(near_duplicate_pairs(frame, "id", "text", unit="chars", size=8, threshold=0.6, bands=96, rows=5))
    norm = {i: "".join(c for c in (t or "").lower() if c.isalnum()) for i, t in data if i is not None}
    runs = {i: {s[j : j + 8] for j in range(len(s) - 7)} for i, s in norm.items()}
    want = [(a, b) for a in runs for b in runs if a < b and ((norm[a] and norm[a] == norm[b]) or (runs[a] and runs[b] and jaccard(runs[a], runs[b]) >= 0.6))]
    assert got == sorted(want, key=str)


def test_words_default_and_counts(spark, rows):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["edit"] + words[101:]
    data = [(1, " ".join(words)), (2, "  ".join(words)), (3, " ".join(near)), (4, "short text"), (5, "short text"), (6, None), (7, " ")]
    found = near_duplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text")
    assert [(r.id, r.copies, r.links) for r in found.orderBy("id").collect()] == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 0), (5, 2, 0)]
    empty = spark.createDataFrame([], "id bigint, text string")
    assert rows(near_duplicate_pairs(empty, "id", "text")) == []
    assert len(char_runs(np.zeros(3, np.uint32), 8)) == 0


def test_salted_pairs_are_complete(spark):
    data = [("hot", i) for i in range(60)] + [("cold", 100), (None, 101), (None, 102)]
    pairs = salted_pairs(spark.createDataFrame(data, "k string, id bigint"), ["k"], "id", block=7)
    assert pairs.count() == 60 * 59 // 2 == pairs.distinct().count()
