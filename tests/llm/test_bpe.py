import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text, path):
    return np.frombuffer(bpe.encode_text(text, path, PATTERN), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(text):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.decode_ids(bpe.encode_text(text, path, PATTERN), path, step=2) == text


def test_equals_the_library(both):
    path, library = both
    random.seed(4)
    tokens = list(bpe.read_ranks(path))
    alphabets = ["aeioutrns ", "éèêçöüß aeiou", "😀漢字かな한글 \n\t", "0123456789²½.,;:!?-_  '", "".join(map(chr, range(1, 400)))]
    for n in range(3000):
        if n % 2:
            text = "".join(random.choice(tokens).decode("utf-8", "ignore") for _ in range(random.randint(1, 8)))
        else:
            text = "".join(random.choices(random.choice(alphabets), k=random.randint(0, 60)))
        assert ids(text, path) == library.encode_ordinary(text), text


def test_tables_may_start_anew(both, monkeypatch):
    path, library = both
    monkeypatch.setattr(bpe, "MOVES", 50)
    small = bpe.Transducer(bpe.read_ranks(path))
    for word in ["internationalisation", "öffentlichkeitsarbeit", "zzzzqqqq", "a" * 300, "internationalisation"] * 3:
        assert small.run(word.encode()) == library.encode_ordinary(word)


def test_long_piece(both):
    path, library = both
    text = "abc" * 4000 + " " * 5000
    assert ids(text, path) == library.encode_ordinary(text)


def test_streamed_characters():
    text = {0: "é".encode()[:1], 1: "é".encode()[1:], 2: "😀".encode()[:3], 3: "😀".encode()[3:], 4: b"a"}
    assert list(bpe.decode_stream([0, 1, 4, 2, 3], text)) == ["é", "a", "😀"]
    assert "".join(bpe.decode_stream([2], text)) == "�"


def test_rows(spark, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents([(1, "Hello wörld"), (2, ""), (3, None), (1, "Hello wörld"), (None, "x")])
    rows = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(docs, path, PATTERN), path).collect()}
    assert rows == {(1, "Hello wörld"), (2, ""), (3, ""), (None, "x")}
    assert bpe.encode(docs.limit(0), path, PATTERN).count() == 0


def test_letters_without_a_break(both):
    """A megabyte of one piece takes linear time."""
    path, library = both
    random.seed(6)
    letters = "".join(random.choices("acgt", k=30_000))
    assert ids(letters, path) == library.encode_ordinary(letters)
    text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    started = time.perf_counter()
    found = bpe.encode_text(text, path, PATTERN)
    assert time.perf_counter() - started < 10
    assert bpe.decode_ids(found, path) == text
    head = ids(text[:20_000], path)
    assert head == library.encode_ordinary(text[:20_000]) and np.frombuffer(found, "<u4")[: len(head) - 20].tolist() == head[:-20]


def test_one_lookup_tells_tokens_and_openings():
    ranks = {bytes((i,)): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    kinds = bpe.Transducer(ranks).kinds
    assert (kinds[b"a"], kinds[b"b"], kinds[b"ab"], kinds[b"abc"]) == (3, 2, 3, 2)
    assert len(kinds) == 258 and b"bc" not in kinds
