import random

import numpy as np
import pytest

pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm.jaccard import reached
from gridloom.llm.minhash import BANDS, ROWS, banded, minima, near_duplicates, searched
from gridloom.llm.tokencounts import token_counts

from .data import frame, words
from .test_jaccard import brute, corpus


def got(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, **more).collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 17), (2, 60)])
def test_groups_as_by_brute_force(spark, seed, block):
    texts = corpus(seed)
    ids = [None if i in (3, 4) else (i * 37) % 1000 for i in range(len(texts))]
    assert got(frame(spark, texts, 4, ids), slice_bytes=3000, block=block) == sorted(brute(list(zip(ids, texts, strict=True)), 80, 2), key=str)


def test_a_family_near_the_threshold(spark):
    r = random.Random(23)
    base = words(r, 90)
    texts = []
    for i in range(250):
        t = list(base)
        for k in r.sample(range(90), r.choice([1, 3, 4, 5, 6])):
            t[k] = f"e{i}-{k}" if r.random() < 0.8 else "e"
        texts.append(" ".join(t))
    want = sorted(brute(list(enumerate(texts)), 80, 2), key=str)
    assert 10 < len({c for *_, c in want}) < 240
    assert got(frame(spark, texts), block=2000) == want


def test_large_arrow_batches(spark):
    """Slices have a bounded number of rows however many an Arrow batch has."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', 'w' || id, 'x', 'y' || id, 'z') AS text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        rows = near_duplicates(df).groupBy("n_shingles", "kept").count().collect()
        counts = token_counts(df.selectExpr("doc_id", "text || ' ' || reverse(text) AS text")).agg({"n_tokens": "sum", "doc_id": "count"}).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in rows] == [(3, True, 20_000)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join([t := f"w{i} x y{i} z", t[::-1]]) for i in range(20_000)]
    assert tuple(counts)[::1] in ((20_000, sum(len(e.ids) for e in tok.encode_batch(texts))), (sum(len(e.ids) for e in tok.encode_batch(texts)), 20_000))


def test_minima_agree_as_often_as_sets_do():
    r = np.random.default_rng(5)
    for both, own in ((800, 100), (300, 400), (90, 5)):
        x = r.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
        a, b = np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own :]]))
        m = minima(np.concatenate([a, b]), np.array([0, len(a), len(a), len(a) + len(b)]), 2000)
        assert m.shape == (2, 2000)
        assert abs((m[0] == m[1]).mean() - both / (both + 2 * own)) < 0.05
    keys = banded(m[:, : BANDS * ROWS], BANDS)
    same = (m[0].reshape(-1, ROWS) == m[1].reshape(-1, ROWS)).all(1)[:BANDS]
    assert ((keys[0] == keys[1]) == same).all() and len(set(keys[0].tolist())) == BANDS


def test_signatures_first_give_the_same_components():
    r = random.Random(3)
    t = [[r.getrandbits(63) for _ in range(50)]]
    for _ in range(150):
        x = list(r.choice(t))
        for _ in range(r.choice([1, 3, 6])):
            x[r.randrange(50)] = r.getrandbits(63)
        t.append(x)
    names = [np.array(sorted(set(x)), np.uint64) for x in t]
    assert searched(BANDS, ROWS)(names, 80).tolist() == reached(names, 80).tolist()


def test_odd_rows(spark):
    df = frame(spark, [None, "", " \t", "One", "one", "a b", "A B", "a b a b", "x"])
    assert got(df.limit(0)) == []
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert rows == {0: (0, 0, True), 1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), 5: (1, 5, True), 6: (1, 5, False), 7: (2, 7, True), 8: (1, 8, True)}


def test_a_very_long_text(spark):
    """5 MB on one line and 5 MB of one word, each with a near copy or copy."""
    r = random.Random(9)
    line = [f"w{r.getrandbits(40)}" for _ in range(400_000)]
    texts = [" ".join(line), " ".join([*line, "end"]), "ab" * 2_500_000, "AB" * 2_500_000]
    assert [(i, c) for i, _, c in got(frame(spark, texts, 2))] == [(0, 0), (1, 0), (2, 2), (3, 2)]
