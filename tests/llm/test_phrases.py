import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("xxhash")
from gridloom.llm import phrases
from gridloom.llm.phrases import END, collocations, dealt, pack, prefixes, sorted_suffixes, unpack

from .data import frame


def brute(rows, longest=3, least=10, share=50, top=2000):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = []
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not within[p] or 100 * within[p] < share * a:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def corpus(seed, n=80):
    r = random.Random(seed)
    vocabulary = [f"{r.choice(['é', 'A', 'b', 'z', 'Ö'])}{i}" for i in range(25)] + ["the", "of", "\x00", "\x1c", "-"]
    out = []
    for i in range(n):
        t = "".join(r.choice(vocabulary[: r.choice([4, 12, 30])]) + r.choice([" ", " ", " ", "  ", "\t", "\n", ". ", ",", " ; ", "\x0b", "\r\n"]) for _ in range(r.randint(0, 120)))
        out.append(t + ("New York City " if i % 4 == 0 else "new york. ") * 2)
    return [*out, None, "", " . ", out[0], out[0], "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab"]


def got(df, **more):
    return sorted(tuple(r) for r in collocations(df, **more).collect())


@pytest.mark.parametrize(("seed", "longest", "top"), [(1, 3, 2000), (2, 2, 7), (3, 4, 40)])
def test_as_by_brute_force(spark, seed, longest, top):
    texts = corpus(seed)
    df = frame(spark, texts, 4)
    want = sorted(brute([(t, ["en", None, "de"][i % 3]) for i, t in enumerate(texts)], longest, 4, 50, top))
    assert len(want) > 15
    assert got(df, longest=longest, least=4, top=top, slice_bytes=2000) == want


def test_all_words_hot(spark, monkeypatch):
    """Counts of prefixes that are spread over buckets add up."""
    texts = corpus(7)
    df = frame(spark, texts, 3)
    want = sorted(brute([(t, ["en", None, "de"][i % 3]) for i, t in enumerate(texts)], 3, 5))
    monkeypatch.setattr(phrases.Mined, "hot", lambda self, words: {k: np.array([r.name for r in words.where(f"lang = '{k}'").collect()], np.int64).view(np.uint64) for k in ("en", "de", "und")})
    assert got(df, least=5) == want


def test_ties_at_the_end_of_the_list(spark):
    """All phrases tie; the first by their bytes stay."""
    texts = [" . ".join(f"{a}{i} {a}{i + 1000}" for i in range(100) for a in ("a", "é", "z")) for _ in range(10)]
    df = frame(spark, texts)
    want = sorted(brute([(t, ["en", None, "de"][i % 3]) for i, t in enumerate(texts)], 3, 3, 50, 20))
    assert got(df, least=3, top=20) == want and len(want) == 60


def test_products_of_more_than_64_bits(spark):
    m = phrases.Mined(frame(spark, ["a"]), 2, 10, 1 << 20)
    name = lambda *x: np.array(x, ">u8").tobytes()
    a, l, r = 3_000_000_007, 4_000_000_000_039, 3_000_000_011
    rows = [("en", bytearray(name(1)), 1, l), ("en", bytearray(name(2)), 1, r), ("en", bytearray(name(1, 2)), 2, a)]
    out = m.scored(spark.createDataFrame(rows, "lang string, phrase binary, size int, times long"), 50).collect()
    assert [(x.a, x.l, x.r, x.score) for x in out] == [(a, l, r, 1_000_000 * a * a // (l * r))]


def test_packed_suffixes():
    r = np.random.default_rng(1)
    rows = r.integers(0, 4, (300, 4)).astype(np.uint64)
    for i in range(0, 300, 3):
        rows[i, r.integers(1, 4) :] = END
    rows, times = sorted_suffixes(rows, r.integers(1, 1000, 300))
    back = unpack(pack(rows, times), 4)
    assert (back[0] == rows).all() and (back[1] == times).all()
    want = Counter()
    for row, n in zip(rows.tolist(), times.tolist(), strict=True):
        for k in range(1, 5):
            if row[k - 1] != int(END):
                want[tuple(row[:k])] += n
    assert {tuple(rows[i, :k].tolist()): n for k, first, count in prefixes(rows, times) for i, n in zip(first.tolist(), count.tolist(), strict=True)} == want


def test_hot_words_are_dealt_out():
    rows = np.stack([np.full(4000, 7), np.arange(4000), np.full(4000, 9)], 1).astype(np.uint64)
    assert len(set(dealt(rows, np.zeros(0, np.uint64), 64).tolist())) == 1
    assert np.bincount(dealt(rows, np.array([7], np.uint64), 64)).max() < 120


def test_odd_rows(spark):
    df = frame(spark, [None, "", " ,", "a"])
    assert got(df.limit(0)) == [] and got(df) == []
    null = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert got(null) == []


def test_a_very_long_text(spark):
    texts = ["x" * 5_000_000, "ab cd " * 900_000]
    df = frame(spark, texts)
    assert got(df) == sorted(brute([(texts[0], "en"), (texts[1], None)]))
