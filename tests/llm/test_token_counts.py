import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, documents
from pyspark.sql import functions as F

from walkweave.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    return tc.Pieces(tc.read_pieces(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


PARTS = ["a", "ab", " ", "  ", "   ", "\n", "\t", "é", "日本", "the", "ing", "tion", "==", "--", "*", "1", "23", "<s>", "</s>", "<unk>", "<0x41>", "▁", "▁▁", "\x00", "😀", "ﬁ", "ħ", "Straße ", "x" * 20]
TEXT = st.one_of(st.text(st.characters(codec="utf-8"), max_size=50), st.lists(st.sampled_from(PARTS), max_size=25).map("".join), st.text("abcdeinorst ▁", max_size=60))


@settings(max_examples=600, deadline=None)
@given(text=TEXT)
def test_counts_of_all_prefixes_are_those_of_the_library(tools, text):
    counter = tc.Counter(tools[0], keep=50)
    want = [len(tools[1].encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.counts(text) == want and counter.count(text) == want[-1]
    for limit in (-1, 0, 1, 2, 5, 17):
        fits = [i for i, n in enumerate(want) if n <= limit]
        assert counter.measure(text, limit) == (want[-1], max(fits, default=0))


@settings(max_examples=200, deadline=None)
@given(order=st.dictionaries(st.text("ab▁", min_size=2, max_size=5), st.integers(0, 6), max_size=12), text=st.text("ab▁", max_size=14))
def test_any_vocabulary(order, text):
    """Also where pieces can't be reached, places are shared, or a merge comes before one that it rests on."""
    order |= {c: 99 for c in "ab▁"}
    pieces = tc.Pieces(order)
    want = [len(pieces.merge(list(text[:i]))[0]) for i in range(len(text) + 1)]
    assert tc.PrefixTable(pieces, text).counts == want
    grown = tc.PrefixTable(pieces)
    for c in text:
        grown.append(c)
    assert grown.counts == want
    # The text is counted with a mark in front.
    assert tc.Counter(pieces, keep=5).count(text) == (len(pieces.merge(list("▁" + text))[0]) if text else 0)


def test_long_texts(tools):
    counter = tc.Counter(tools[0])
    for text in ("a" * 30000, " " * 9999, "ab" * 9000, "日本" * 3000, "the cat " * 20000, "=" * 5000, "\n" * 3000):
        assert counter.count(text) == len(tools[1].encode(text))


def test_rows(spark, tools):
    got = {r.doc_id: r for r in tc.count(documents(spark), PATH, limit=100).collect()}
    assert len(got) == len(DOCS)
    for i, text in DOCS:
        row, n = got[i], len(tools[1].encode(text or ""))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 100)
        kept = (text or "")[: row.n_kept]
        assert len(tools[1].encode(kept)) <= 100 and (n > 100 or kept == (text or ""))
    cut = {r.doc_id: r for r in tc.truncate(documents(spark), PATH, 100).collect()}
    for i, text in DOCS:
        assert cut[i].text == (None if text is None else text[: got[i].n_kept]) and cut[i].n_tokens == len(tools[1].encode(cut[i].text or ""))
    assert tc.count(documents(spark, []), PATH).count() == 0
    assert tc.count(documents(spark, [(3, "a b"), (3, "a b"), (None, "a b")]), PATH).where("n_tokens = 2").count() == 3


def test_stored_counts_answer_places_and_budgets(spark, tools):
    table = tc.prefix_counts(documents(spark), PATH)
    asked = table.select("doc_id", "counts", tc.at_place(F.col("counts"), F.lit(50)).alias("at"), tc.longest_within(F.col("counts"), F.lit(30)).alias("fits"), tc.longest_within(F.col("counts"), F.lit(-1)).alias("none"))
    text_of = dict(DOCS)
    for r in asked.collect():
        text = text_of[r.doc_id] or ""
        assert len(r.counts) == len(text) + 1 and r.counts[-1] == len(tools[1].encode(text))
        assert r.at == len(tools[1].encode(text[:50])) and r.none == 0
        assert len(tools[1].encode(text[: r.fits])) <= 30 and all(n > 30 for n in r.counts[r.fits + 1 :])
    assert tc.prefix_counts(documents(spark, []), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tc.read_pieces(str(tmp_path / "m.model"))
