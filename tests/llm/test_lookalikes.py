import random
import unicodedata

import pytest

from dupscape.llm.lookalikes import Folding, comparable, comparing_folding, corpus_folding, default_folding, points, text_of
from dupscape.llm.same_look import folded, look_alike_pairs

SAME = [
    ("First Flight", "Ｆｉｒｓｔ　Ｆｌｉｇｈｔ"), ("café", "café"), ("cafe", "c​afe﻿"), ("a b", "a b"), ("a b", "a b"), ("scope", "ѕсоре"),
    ("over", "оνer"), ("office", "oﬃce"), ("Part IV", "Part Ⅳ"), ("人入口", "⼈⼊⼝"), ("한글", unicodedata.normalize("NFD", "한글")), ("well-known", "well‑known"), ("soft", "so­ft"), ("ё", "ë"), ("ё", unicodedata.normalize("NFD", "ё")), ("Tea", "Τeа"),
]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("a", "b"), ("a b", "a  b"), ("a\nb", "a b"), ("a\r\nb", "a\nb"), ("a.", "a"), ("a–b", "a-b"), ("2", "²"), ("1", "①"), ("σ", "ς"), ("l", "1"), ("x", "×")]


@pytest.mark.parametrize("a, b", SAME)
def test_looks_the_same(a, b):
    f = default_folding()
    assert f.fold(a) == f.fold(b) and a != b


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_looks_different(a, b):
    f = default_folding()
    assert f.fold(a) != f.fold(b)


def test_fold_is_idempotent_and_batches_agree():
    rng = random.Random(5)
    pool = [c for pair in SAME for s in pair for c in s] + list("ab \ń̈ﬁ한ᄒ‍가") + [chr(c) for c in range(0x1D400, 0x1D420)]
    f = default_folding()
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)]
    once = [f.fold(t) for t in texts]
    assert [f.fold(t) for t in once] == once
    cps, at = f.batch(texts)
    assert [text_of(cps[at[i] : at[i + 1]]) for i in range(len(texts))] == [text_of(f.codes(t)) for t in texts]
    kept, at = comparable(texts)
    single = [text_of(comparable([t])[0]) for t in texts]
    assert [text_of(kept[at[i] : at[i + 1]]) for i in range(len(texts))] == single
    assert all(unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" for s in single for c in s)


def test_representative_is_the_most_frequent():
    counts = {ord("а"): 10, ord("a"): 3}
    assert Folding(counts).fold("a") == "а" and Folding({ord("a"): 9}).fold("а") == "a"


def test_comparison_ignores_case_across_scripts():
    assert text_of(comparable(["НОРА, нора"])[0]) == text_of(comparable(["нора НОРА"])[0])
    f = comparing_folding()
    assert f.fold("V") != f.fold("n") and f.fold("l") != f.fold("i")


def test_pairs(spark, rows):
    data = [(1, "Tea time", None, "x"), (2, "Τea time", "", "x"), (3, "Tea time", "ab​c", "x"), (4, "Tea time", "abc", "x"), (5, None, "abc", "x"), (6, "tea time", " ", "x"), (7, "​", "ＡＢ", None), (4, "Tea time", "abc", "x"), (None, "Tea time", None, "x")]
    df = spark.createDataFrame(data, "book_id bigint, title string, text string, form string")
    found = rows(look_alike_pairs(df, "book_id", ["title", "text"], block=1))
    assert found == [(1, 2, "title"), (1, 3, "title"), (2, 3, "title"), (2, 4, "title"), (3, 4, "text"), (3, 4, "title"), (3, 5, "text")]
    assert rows(look_alike_pairs(df.limit(0), "book_id", ["title", "text"])) == []


def test_folded_keeps_nulls(spark, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Ａ" * 70_000)], "id bigint, t string")
    out = {r.id: r.t_form for r in folded(df, "id", ["t"]).collect()}
    assert out[1] is None and out[2] == "" and len(set(out[3])) == 1 and len(out[3]) == 70_000
    assert corpus_folding(df, ["t"]).fold("A") == "Ａ"
    assert points("é").tolist() == [0xE9]
