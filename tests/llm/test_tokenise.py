import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convoloom.llm import tokenise as k

PATH = os.path.join(k.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def mine():
    return k.Encoder(*k.parts_of_tokenizer(PATH))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(k.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x1FFF, exclude_categories=["Cs", "Cn"]), max_size=60), max_size=5))
def test_any_text(mine, theirs, texts):
    assert mine.encode(texts) == theirs(texts)


def test_special_long_and_empty(mine, theirs):
    rng = random.Random(2)
    texts = ["<|endoftext|> x", "", " ", "\n\n \t x", "a" * 5000, "ab" * 3000 + "!?" * 900, "".join(rng.choice("abcdefgh") for _ in range(4000)), "汉字 ünï 👩‍💻 नमस्ते", "'s 're I'll", "x" * 511 + " " + "y" * 513]
    assert mine.encode(texts) == theirs(texts)
    assert mine.encode([None, ""]) == [[], []] and mine.encode([]) == []


def test_pieces_are_cut_into_batches(mine, theirs):
    texts = [f"word{i} and more {i * 7}" for i in range(300)]
    assert mine.encode(texts, at_once=50) == theirs(texts)


def test_memory_may_start_afresh(theirs, monkeypatch):
    monkeypatch.setattr(k, "REMEMBER", 40)
    e = k.Encoder(*k.parts_of_tokenizer(PATH))
    texts = [f"alpha{i} beta{i}" for i in range(60)]
    assert [e.encode([t])[0] for t in texts] == theirs(texts)


def test_heap_and_matrix_agree(mine):
    rng = random.Random(4)
    for _ in range(50):
        piece = bytes(rng.choice(b"aabcde \xc3\xa9") for _ in range(rng.randrange(2, 200)))
        assert mine.long_piece(piece) == mine.matrix([piece])[0]


def test_frame(spark, theirs):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, None), (3, "", ""), (3, "hi there", "y"), (None, "z", None)], "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in k.encode_column(df, "doc_id", "text").collect()]
    hi, z = theirs(["hi there", "z"])
    assert sorted(got, key=str) == sorted([(1, hi), (2, []), (3, []), (3, hi), (None, z)], key=str)
    assert k.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["n_tokens"] for r in k.count_tokens(df, "doc_id", "text").collect()) == sorted([len(hi), 0, 0, len(hi), len(z)])
