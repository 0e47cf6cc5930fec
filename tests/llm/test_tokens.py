"""Token counts and packing against the tokenizer library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm.packing import pack, padded_length
from marlstone.llm import token_counts as T
from marlstone.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, n_tokens string"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a   b", "\n \n", "a \n b", " \t x  y\n\n z ", "It's we'LL they'd", "naïve ΣΑΣ Σ é é ½ x²",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>", "<|end", "日本語 テスト、ok", "x" * 500, "word " * 3000, "1 22 333", "\x1c \x1d a b   c", "!!! ... --", "á ́b",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts(rows(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 2048), text


def test_counts_of_null_ids_repeats_and_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    frame = spark.createDataFrame([(None, "a b", "x"), (3, "a b", "x"), (3, "a b", None)], SCHEMA)
    assert sorted(token_counts(frame, path).collect(), key=str) == sorted([(3, 3, 2, False), (3, 3, 2, False), (None, 3, 2, False)], key=str)
    assert token_counts(frame.limit(0), path).collect() == []


def test_packing_is_a_gapless_round_trip(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = pack(rows(spark, texts).repartition(3), path).collect()
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    seen: dict = {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes()), repr(texts[p.doc_id])
        assert p.doc_tokens == len(want[p.doc_id])
    assert seen.keys() == want.keys()
    for i, own in seen.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) == len(want[i])
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for sequence, offset, length in places:
        assert sequence * 2048 + offset == at and offset + length <= 2048
        at += length


def test_packing_repeats_and_nothing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(None, "a b", "x"), (3, None, "x"), (3, None, None)], SCHEMA)
    assert sorted((p.doc_id or -1, p.doc_tokens) for p in pack(frame, path).collect()) == [(-1, 3), (3, 1), (3, 1)]
    assert pack(frame.limit(0), path).collect() == []
    assert [padded_length(n) for n in (1, 3, 512, 2047, 2048)] == [1, 2048, 512, 2048, 2048]


def test_cuts_of_odd_strings_equal_the_library(monkeypatch):
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(7)
    assert T.cuts_alike(path) and not T.cuts_alike(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(T, "CACHE_PIECES", 50)
    counter = T.PieceLengths(path, {"the": 1, "s": 1}, True)
    signs = ["'", "''", "'s", "'ll", "'S", " ", "\t", "\xa0", "\n", "İ", "ı", "ß", "É", "Ÿ", "ſ", "²", "½", "1", "22", "!", "...", "-", "_", "\xad", "×", "÷", "µ", "ª", "\x1c", "\x85", "́", "​", "Ǆ", "Σ", "ς", "日本", "ﬁ", "🙂", "the", "THE", "Don't", "word", "<|", "|>"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    for point in range(0x180):
        for text in (chr(point), f"a{chr(point)}b 1{chr(point)}", f"{chr(point)}{chr(point)}'s"):
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_sketch_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(T, "SKETCH", 100)
    sketch = T.Sketch()
    for i in range(3000):
        sketch.add(["often", f"w{i}", f"v{i}"] + ["second"] * (i % 2))
    assert len(sketch) <= 101 and [k for k, _ in sketch.most_common(2)] == ["often", "second"] and sketch["often"] >= 3000 - 7500 / 50
