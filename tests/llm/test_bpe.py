import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rambleweave.llm import bpe as B
from rambleweave.llm.tokens import decode, encode, token_counts


@pytest.fixture(scope="module")
def own():
    return B.vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.default_vocabulary())
    t.encode_special_tokens = True
    return t


CASES = [
    "", " ", "  ", "\n", "a", " a", "  a", "a  ", "a \n b", "don't", "'s", "''s", "!'s", " 's", "\n's", "it's's'll 'lla 'LL", "x'ves", "we're'd", "\t\tif x:\n\n\n  y", "<|endoftext|> <|x|>", "naïve café ﬁ", "日本語テキスト。", "🎉👩‍👩‍👧",
    "\u00a0x \u3000y\u2028z", "1234 5.6e7 ½ ٣", "a" * 5000, "ab" * 3000 + "!?" * 500, " " * 3000 + "x", "\r\n\r\n", "\x00\x01 \x1c a", "́e", "\ufeffbom", "___--- --_", "ǅ ʰ ª", "x\u0085y",
]


def ids(own, texts):
    at, flat = own.encode(pa.array(texts))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_cases(own, library):
    got = ids(own, CASES)
    for text, g in zip(CASES, got):
        assert g == library.encode(text, add_special_tokens=False).ids, repr(text[:50])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" '\nsStTdlrevm!.aé1", max_size=80)), max_size=6))
def test_any_text(texts):
    own, lib = B.vocabulary(), test_any_text.library
    assert ids(own, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    at, flat = own.encode(pa.array(texts, pa.string()))
    assert own.decode(at, flat) == [t.encode() for t in texts]
    assert own.count(pa.array(texts, pa.string())).tolist() == np.diff(at).tolist()


@pytest.fixture(autouse=True)
def _library(library):
    test_any_text.library = library


def test_slices_and_nulls(own):
    a = pa.array(["drop", None, "keep it", "", "日本"])
    assert ids(own, a.slice(1)) == ids(own, ["", "keep it", "", "日本"])
    assert ids(own, pa.array([], pa.string())) == [] and ids(own, pa.array([None, None], pa.string())) == [[], []]


def test_long_text_in_parts(own, library, monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "beta's", "\n\n", "x1", "日本", "  "]) for _ in range(3000))
    whole = ids(own, [text, "after", text])
    monkeypatch.setattr(B, "CHUNK_BYTES", 700)
    assert ids(own, [text, "after", text]) == whole == [library.encode(t, add_special_tokens=False).ids for t in (text, "after", text)]


def test_cache_is_bounded_and_collisions_do_no_harm(own, monkeypatch):
    texts = ["the quick brown fox", "jumped over", "the lazy dog"]
    right = ids(own, texts)
    monkeypatch.setattr(B, "CACHE_WORDS", 2)
    assert ids(own, texts) == right == ids(own, texts)
    own.forget()
    own.known = dict.fromkeys(range(1))
    # every key the same: all words but one collide
    monkeypatch.setattr(B.pd, "factorize", lambda key: (np.zeros(len(key), np.int64), np.zeros(1, np.uint64)))
    own.forget()
    assert ids(own, texts) == right
    own.forget()


def test_operators(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "hello", "x"), (1, "hello world", "x"), (5, "tail " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in encode(df).collect()]
    assert sorted((k or 0, v) for k, v in got)[:2] == [(0, [31373]), (1, [31373, 995])] and len(got) == 6
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()}[2] == 0
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: "hello", 5: "tail " * 50_000}
    assert encode(df.limit(0)).collect() == []
