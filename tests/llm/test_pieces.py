import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from gridloom.llm.pieces import encoded, load

from .data import frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(seed=1):
    r = random.Random(seed)
    parts = ["the", "ing", "tion", " ", " ", "  ", "\n", "é", "ß", "###", "中文", "\U0001f600", "ö", "x", "Q", "0", "17", ".", ", ", "\t", "s", "er"]
    out = ["", " ", "a", "  a  b ", "\n\n", "hello world", "<s> </s> <unk> <0x41>", "é" * 100, "the" * 60, "a" * 200, "\U0001f600", None, "    x", "\x00\x01", "word " * 300]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(120)]


def check(spark, path, ts):
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, ts)
    got = {r.doc_id: r for r in encoded(df, path, texts=True, slice_bytes=1500).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        ids = sp.encode(t or "")
        assert got[i].ids == ids, repr(t)
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded == (t or "") == load(path).decoded(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        for u in (t or "").split():
            assert load(path).encoded("▁" + u) == sp.encode(u) or "▁" in u
    assert encoded(df.limit(0), path).collect() == []


def test_bpe(spark):
    check(spark, PATH, texts())


def test_unigram(spark, tmp_path):
    """The same pieces as a unigram model: the sums of scores decide."""
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    r = random.Random(3)
    for p in m.pieces:
        if p.type == 1:
            p.score = -len(p.piece) * 0.3 - 6 - r.random() * 6
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    check(spark, path, texts(2))
