"""Every registered query of this part over the smallest tables, against plain versions of its contract."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gridloom.llm import queries as llm

from .test_alignment import brute as brute_alignment
from .test_jaccard import brute as brute_groups
from .test_phrases import brute as brute_phrases
from .test_quality import brute as brute_quality
from .test_quality import brute_kept
from .test_repeats import brute_bytes, brute_words, order


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: llm.queries()[name](spark, sf_dir).collect()


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.queries()) == list(range(1, 14))
    assert set(llm.queries()) | {"pipeline"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_op1(run, docs):
    got = {r.doc_id: r for r in run("op1_fingerprints")}
    for (i, t, _), (_, nxt, _) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited > 0.5 or len(t) < 300)
    equal = defaultdict(set)
    for i, t, _ in docs:
        equal[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in equal.values()) and len({f for x in equal.values() for f in x}) == len(equal)


def test_op2(run, docs):
    assert order(tuple(r) for r in run("op2_substring_dedup")) == order(brute_words([d[:2] for d in docs]))


def test_op3(run, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, room = defaultdict(list), defaultdict(list)
    for r in run("op3_packing"):
        pieces[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for x in room.values():
        assert [a for a, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1].tolist()]
        assert (n := sum(n for _, n in x)) <= 1024 and n & (n - 1) == 0


def test_op4(run, docs):
    assert sorted(tuple(r) for r in run("op4_jaccard_join")) == sorted(brute_groups([d[:2] for d in docs]))


def test_op5(run, docs, spark, sf_dir):
    got = {r.doc_id: r for r in run("op5_quality")}
    for i, t, _ in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
    hosts = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    assert [got[i].kept for i, _, _ in docs] == [k for k, _ in brute_kept([(t, hosts[i]) for i, t, _ in docs], 50)]


def test_op6(run, docs):
    assert order(tuple(r) for r in run("op6_suffix_dedup")) == order(brute_bytes([d[:2] for d in docs]))


def test_op7(run, spark, sf_dir):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    top = defaultdict(int)
    for i, b in pages:
        top[b] = max(top[b], i)
    got = {r.page_id: r for r in run("op7_warc")}
    for i, b in pages:
        first = top[b] == i
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[b])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_op8(run, docs):
    got = {r.doc_id: r for r in run("op8_language")}
    right = [got[i].lang_pred == lang for i, _, lang in docs if got[i].held_out and lang]
    assert len(right) > 40 and sum(right) >= 0.9 * len(right)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in docs)


def test_op9(run, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in run("op9_token_counts")}
    for i, t, _ in docs:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512)


def test_op10(run, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run("op10_sentencepiece")}
    for i, t, _ in docs:
        ids = np.array(sp.encode(t), "<u4")
        assert (got[i].n_pieces, got[i].ids_crc32, got[i].decoded_sha256) == (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(t.encode()).hexdigest())


def test_op11(run, docs):
    want = [(i, n, c, i == c) for i, n, c in brute_groups([d[:2] for d in docs], 80, 2)]
    assert sorted(tuple(r) for r in run("op11_minhash")) == sorted(want)


def test_op13(run, docs):
    assert sorted(tuple(r) for r in run("op13_collocations")) == sorted(brute_phrases([(t, lang) for _, t, lang in docs]))


def test_op12(run, docs):
    assert sorted(tuple(r) for r in run("op12_alignment")) == sorted(brute_alignment([d[:2] for d in docs]))
