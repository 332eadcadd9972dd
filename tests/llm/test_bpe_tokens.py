"""Byte-level BPE against the tiktoken library."""

import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from riskloom.llm import bpe

R = random.Random(3)
TEXTS = [
    "", "a", " ", " a", "a ", "  a  b", "a\n b", "a \nb\n", "it's I'll x'd 's ' s", "a" * 5000, "ab" * 3000,
    "x y z " * 100, "　 a b   c", "日本語テキスト мир 🙂🙂 é", "<|endoftext|> a", "1234567890 12 ١٢",
    "foo\tbar \tbaz\r\n\r\n q", "=====----!!!" * 50,
    "".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500)),
    "".join(R.choice("abcé \n\t.,'12🙂") for _ in range(4000)),
    "".join(chr(R.choice([R.randrange(32, 0x2FFF), R.randrange(0x1F300, 0x1F900)])) for _ in range(3000)),
]


@pytest.fixture(scope="module")
def engine():
    return bpe.engine(*bpe._defaults(None, None))


@pytest.fixture(scope="module")
def library(engine):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=engine.ranks, special_tokens={})


def test_ids_are_the_library_s(engine, library):
    for text, (ids, decoded) in zip(TEXTS, engine.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(text)
        assert decoded == text.encode()


def test_slices_of_long_texts_change_nothing(engine, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 300)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 900)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    whole = " ".join(TEXTS)
    ids, decoded = engine.encode([whole])[0]
    assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(whole)
    assert decoded == whole.encode()


def test_rows_with_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, None, 0), (None, "a b", 1), (2, "", 2), (2, "", 2), (3, "word " * 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in bpe.encode(docs).collect())
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    back = bpe.decode(bpe.encode(docs).select("doc_id", "ids"))
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_decoded_bytes_are_those_of_the_ids():
    wrong = bpe.Engine(*bpe._defaults(None, None))
    ids = wrong.ranks[b" the"], wrong.ranks[b" was"]
    wrong.ranks[b" the"] = ids[1]
    got, decoded = wrong.encode(["in the sea"])[0]
    assert ids[1] in np.frombuffer(got, np.int32).tolist() and decoded == b"in was sea"


def test_what_is_remembered_is_small():
    import tracemalloc

    words = [f" {''.join(R.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(8))}" for _ in range(40_000)]
    fresh = bpe.Engine(*bpe._defaults(None, None))
    tracemalloc.start()
    fresh.encode(["".join(words)[1:]])
    held = tracemalloc.get_traced_memory()[0]
    del words
    tracemalloc.stop()
    assert held < 200 * 40_000


def test_frequent_chunks_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1000)
    fresh, asked = bpe.Engine(*bpe._defaults(None, None)), []
    query = fresh._query
    monkeypatch.setattr(fresh, "_query", lambda sql, words: asked.extend(words) or query(sql, words))
    # A long time without the frequent word, among many that are met once.
    last = ["zqxjkvbw,"] * 100 + ["yyxz"] * 700 + ["zqxjkvbw,"] * 100
    texts = [f"x zqxjkvb{chr(0x4E00 + k)}q {word}" for k, word in enumerate(last)]
    for (_, decoded), text in zip(fresh.encode(texts), texts, strict=True):
        assert decoded == text.encode()
    assert asked.count(b" zqxjkvbw") == 1
