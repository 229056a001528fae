import random

import pytest

from dupscape.llm.encoding import Bpe, Encoder, encode_corpus
from dupscape.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(11)
    alphabet = "aaab  bcd'ste\n\t.,!?1234 é中文字你好ßнет🙂‍—“”<|>"
    out = ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(300)]
    return out + ["", " ", "a", "x  y", "x \ny", "x\n \ny ", "  lead", "trail  ", "<|endoftext|>", "a" * 20_000, "ab" * 5_000, "中" * 3_000, "don't we'll", "Hello, world. Hello, world."]


def test_ids_equal_the_library(reference):
    e, given = Encoder(Bpe(tokenizer_path())), texts()
    for _ in range(2):  # the second time from what was kept
        flat, at = e.encode(given)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == reference(given)


def test_forgetting_changes_nothing(reference, monkeypatch):
    import dupscape.llm.encoding as module

    monkeypatch.setattr(module, "KEPT", 20)
    e, given = Encoder(Bpe(tokenizer_path())), texts()
    got = []
    for i in range(0, len(given), 7):
        flat, at = e.encode(given[i : i + 7])
        got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == reference(given)


def test_corpus(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "Hello world", None), (3, "Hello world", None), (None, "a", "x")]
    out = encode_corpus(spark.createDataFrame(data, "doc_id bigint, text string, ids string"), "doc_id", "text", tokenizer_path())
    got = sorted(((r.doc_id, r.ids) for r in out.collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (None, [64])], key=str)
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", tokenizer_path()).count() == 0
