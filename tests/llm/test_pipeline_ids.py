import public_tokenizers
from llm_cases import DOCS, documents

import corpus_pipeline
from walkweave.llm import bpe


def test_last_stage_returns_the_tokens(spark):
    out = corpus_pipeline.tokens(spark, documents(spark), "")
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {r.doc_id: len(r.ids or []) for r in out.collect()}
    back = bpe.decode(out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data or b"").decode() for r in back.collect()} == {i: t or "" for i, t in DOCS}
