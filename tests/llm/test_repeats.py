import hashlib
import random

import pytest

pytest.importorskip("xxhash")
from gridloom.llm.substring import deduplicated
from gridloom.llm.suffixes import deduplicated_bytes

from .data import corpus, frame, words


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, width=50):
    low = {}
    docs = [((1 << 63) - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            low[k] = min(low.get(k, i), i)
    out = []
    for (i, w), (doc, _) in zip(docs, rows, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if low[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def brute_bytes(rows, width=200):
    times = {}
    docs = [(t or "").encode() for _, t in rows]
    for b in docs:
        for a in range(len(b) - width + 1):
            times[b[a : a + width]] = times.get(b[a : a + width], 0) + 1
    out = []
    for (i, _), b in zip(rows, docs, strict=True):
        gone = [False] * len(b)
        for a in range(len(b) - width + 1):
            if times[b[a : a + width]] > 1:
                gone[a : a + width] = [True] * width
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", [5, 6])
def test_words_as_by_brute_force(spark, tmp_path, seed):
    texts = corpus(seed)
    ids = [None if i in (7, 8) else 900 - i if i % 2 else i // 2 for i in range(len(texts))]
    frame(spark, texts, 4, ids).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = deduplicated(docs, carry=("lang", "row"), slice_bytes=4000)
    assert got.columns[:3] == ["doc_id", "lang", "row"]
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert order(rows) == order(brute_words(list(zip(ids, texts, strict=True))))
    for r in got.collect():
        assert sha(b" ".join(r.kept_text.encode().split())) == r.kept_sha256
    assert sum(r[2] for r in rows) > 0


@pytest.mark.parametrize("seed", [5, 7])
def test_bytes_as_by_brute_force(spark, seed):
    p, q = "".join(words(random.Random(1), 80)), "".join(words(random.Random(2), 80))
    texts = [*corpus(seed), f"{p} one {q}", f"{q}two{p}"]
    got = deduplicated_bytes(frame(spark, texts), slice_bytes=3000).collect()
    want = brute_bytes(list(enumerate(texts)))
    assert order(tuple(r) for r in got) == order(want)
    assert any(r[3] > 1 for r in want)


def test_empty(spark):
    df = frame(spark, ["a b"]).limit(0)
    assert deduplicated(df).collect() == [] and deduplicated_bytes(df).collect() == []
    with pytest.raises(ValueError):
        deduplicated(df, width=40)


def chunk_rows(texts, parse, width):
    """What a task emits for a slice of these texts."""
    import numpy as np
    import pyarrow as pa

    from gridloom.llm.arrowtext import Rolling, mixed
    from gridloom.llm.repeats import chunks, steps

    u = parse(pa.array([t.encode() for t in texts], pa.binary()))
    text, p, s, e = chunks(u, width)
    name = [Rolling(h, k).span(s, e + width) for k, h in enumerate(u.hashes)]
    name[0] = mixed(name[0] ^ (p - s).astype(np.uint64))
    one, step, many = steps(text, name, s)
    assert many.sum() == len(s)
    found = sorted(int(a + k * d) for a, d, m in zip(s[one], step, many, strict=True) for k in range(m))
    assert found == sorted(s.tolist())
    at = {int(x): (int(a), int(b)) for x, a, b in zip(s, *name, strict=True)}
    assert all(at[int(a + k * d)] == at[int(a)] for a, d, m in zip(s[one], step, many, strict=True) for k in range(m))
    return len(s), len(one)


def test_periodic_texts_are_few_rows():
    from gridloom.llm.substring import word_units
    from gridloom.llm.suffixes import byte_units

    r = random.Random(3)
    for t in ("a" * 20_000, "ab " * 7_000, "0123456789abcdef" * 1_500):
        chunks, rows = chunk_rows([t, t], byte_units(200), 200)
        assert rows < 120 + chunks // 100, (t[:5], chunks, rows)
    for t in ("same " * 5_000, "one two three " * 2_000):
        chunks, rows = chunk_rows([t, "x y z"], word_units(50), 50)
        assert rows < 60 + chunks // 100
    odd = "".join(r.choice(["ab", "abc", "q" * 250, "x" * 230 + "y"]) for _ in range(300))
    chunk_rows([odd, odd[50:], "".join(chr(97 + r.randrange(26)) for _ in range(3000))], byte_units(200), 200)


def test_periodic_texts_as_by_brute_force(spark):
    r = random.Random(11)
    texts = ["ab" * 400, "ab" * 300 + "x", "abc" * 250, "q" + "abc" * 120, "z" * 199, "z" * 200, "y" * 201, " ".join(["u v"] * 90), " ".join(["v u"] * 60 + ["w"]), "u " * 120, "".join(r.choice("ab") for _ in range(900)), "".join(["ab" * 150, "c", "ab" * 150])]
    docs = list(enumerate(texts))
    assert order(tuple(x) for x in deduplicated_bytes(frame(spark, texts)).collect()) == order(brute_bytes(docs))
    got = deduplicated(frame(spark, texts)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert order(tuple(x) for x in got) == order(brute_words(docs))


def test_very_long_texts(spark):
    """5 MB of one letter, of one word again and again, and on one line, each beside a copy of a part."""
    r = random.Random(12)
    line = " ".join(f"w{r.getrandbits(30)}" for _ in range(450_000))
    texts = ["a" * 5_000_000, "b" * 100 + "a" * 150, "word " * 1_000_000, "word " * 49 + "end", line, line[1_000_000:1_200_000]]
    got = {x.doc_id: x for x in deduplicated_bytes(frame(spark, texts, 2)).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (5_000_000, 1) and got[1].n_removed == 0
    assert (got[2].n_removed, got[2].n_spans) == (5_000_000, 1) and got[5].n_removed == 200_000 and got[4].n_removed == 200_000
    got = {x.doc_id: x for x in deduplicated(frame(spark, texts, 2)).collect()}
    assert [got[i].n_removed for i in range(5)] == [0] * 5 and got[5].n_removed >= len(texts[5].split()) - 2


def test_carried_columns_may_not_clash(spark):
    df = frame(spark, ["a b"]).withColumnRenamed("row", "kept_text")
    with pytest.raises(ValueError, match="kept_text"):
        deduplicated(df, carry=("kept_text",))
