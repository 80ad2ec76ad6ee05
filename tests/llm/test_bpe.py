import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, documents

from walkweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tools():
    ranks = bpe.read_ranks(PATH)
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(st.characters(codec="utf-8"), max_size=60), st.lists(st.sampled_from(["a", "aa", "ab", " ", "  ", "\n", "é", "日", "1", "the", "ing", "=", "--"]), max_size=40).map("".join)))
def test_encoding_is_that_of_the_library(tools, text):
    vocabulary, library = tools
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN, keep=50)
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_long_pieces(tools):
    vocabulary, library = tools
    for text in ("a" * 3000, "ab" * 700, " " * 999 + "x", "=" * 500, "é" * 400, "the" * 300):
        assert bpe.Encoder(vocabulary, public_tokenizers.PATTERN).encode(text) == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(data=st.binary(max_size=80), start=st.integers(0, 80), size=st.integers(0, 10), new=st.binary(max_size=10))
def test_edits_and_appends(tools, data, start, size, new):
    vocabulary = tools[0]
    table = bpe.PrefixTable(vocabulary, data)
    start = min(start, len(data))
    end = min(start + size, len(data))
    table.replace(start, end, new)
    edited = data[:start] + new + data[end:]
    assert table.data == edited and table.last == bpe.PrefixTable(vocabulary, edited).last
    table.append(b"more")
    assert table.last == bpe.PrefixTable(vocabulary, edited + b"more").last
    assert b"".join(vocabulary.bytes_of[t] for t in table.tokens()) == edited + b"more"


def test_an_edit_of_a_long_text_is_near(tools):
    table = bpe.PrefixTable(tools[0], b"some plain words here " * 400)
    assert table.replace(50, 53, b"X") < 600


def test_rows(spark, tools):
    got = {r.doc_id: r for r in bpe.encode(documents(spark), PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    for doc_id, text in DOCS:
        ids = tools[1].encode_ordinary(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids) and list(row.ids) == ids
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(documents(spark), PATH, public_tokenizers.PATTERN, with_ids=True), PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in DOCS}
    assert bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
