"""Texts of 5 MB, on one line and of one word again and again, through the operators that have no such test of their own."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm.jaccard import groups
from gridloom.llm.langid import identified
from gridloom.llm.packing import packed
from gridloom.llm.phrases import collocations
from gridloom.llm.pieces import encoded
from gridloom.llm.quality import judged
from gridloom.llm.tokencounts import token_counts
from gridloom.llm.warc import round_trip


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    line = " ".join(f"the w{r.randint(0, 50_000)}" for _ in range(550_000))
    return [line, "word " * 1_000_000, line + " end", "a short text of some words that is like no other one here", "x" * 300_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i != 4 else None, "host") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()
    df.count()
    return df


def test_tokens(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert [got[i] for i in range(5)] == want
    pieces = packed(docs).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in pieces} == {i: n + 1 for i, n in enumerate(want)}


def test_pieces(docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in encoded(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_pieces, got[i].decoded_sha256) == (len(sp.encode(t)), hashlib.sha256(t.encode()).hexdigest())


def test_groups(docs):
    assert {r.doc_id: r.component_id for r in groups(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_quality_and_language(docs, texts):
    got = {r.doc_id: r for r in judged(docs).collect()}
    assert [got[i].n_words for i in range(5)] == [len(t.split()) for t in texts] and got[1].base_failed and not got[3].base_failed
    got = {r.doc_id: r.lang_pred for r in identified(docs).collect()}
    assert got[0] == got[2] == "en"


def test_phrases(docs, texts):
    top = [(r.a, r.l, r.r, r.score) for r in collocations(docs).collect() if r.phrase == "word word word"]
    assert top == [(999_998, 1_000_000, 999_999, 999_998**2 * 10**6 // (10**6 * 999_999))]


def test_pages(spark, docs, texts):
    pages = docs.selectExpr("doc_id AS page_id", "'http://x/' || doc_id AS url", "text AS html")
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in round_trip(pages, least_bytes=0).collect()}
    assert got == {i: (len(t), "response") for i, t in enumerate(texts)}
