import random

import pyarrow as pa
import pytest

pytest.importorskip("xxhash")
from gridloom.llm.jaccard import Sets, components, groups, reached, signatures

from .data import frame, words


def shingles(t, width=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, percent=75, width=5):
    sets = [shingles(t, width) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                at[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (d, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(same) if same else None))
    return out


def corpus(seed, n=140):
    r = random.Random(seed)
    base = [words(r, r.choice([0, 1, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200])) for _ in range(n // 4)]
    passage = words(r, 30)
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            if t:
                k = r.randrange(len(t))
                if r.random() < 0.5:
                    t[k] = f"edit{r.randint(0, 3)}"
                else:
                    del t[k:]
        if r.random() < 0.3:
            t = t[: len(t) // 2] + passage
        out.append(" ".join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in t))
    return [*out, None, "", " \n", "x", "X"]


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 17), (2, 60), (3, 400)])
def test_groups_as_by_brute_force(spark, seed, block):
    texts = corpus(seed)
    ids = [None if i in (3, 4) else (i * 37) % 1000 for i in range(len(texts))]
    got = groups(frame(spark, texts, 4, ids), slice_bytes=3000, block=block)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute(list(zip(ids, texts, strict=True))), key=str)


def test_a_chain_within_a_signature(spark):
    """Links that don't go through the first set of a signature are found as well."""
    r = random.Random(8)
    t = words(r, 120)
    texts = []
    for _ in range(40):
        t = list(t)
        k = r.randrange(0, 100)
        t[k : k + 3] = [f"n{r.random()}"]
        texts.append(" ".join(t))
    r.shuffle(texts)
    rows = [(x.doc_id, x.n_shingles, x.component_id) for x in groups(frame(spark, texts), block=700).collect()]
    assert sorted(rows) == sorted(brute(list(enumerate(texts))))


def test_a_family_near_the_threshold(spark):
    """300 texts whose likeness to their common text, and so to each other, lies about 75 %; in blocks and in one."""
    r = random.Random(21)
    base = words(r, 90)
    texts = []
    for i in range(300):
        t = list(base)
        for k in r.sample(range(90), r.choice([1, 2, 3, 4])):
            t[k] = f"e{i}-{k}" if r.random() < 0.8 else "e"
        texts.append(" ".join(t[r.choice([0, 0, 4, 9]) :]))
    want = sorted(brute(list(enumerate(texts))))
    assert 10 < len({c for *_, c in want}) < 250
    for block in (2000, 1 << 17):
        rows = [(x.doc_id, x.n_shingles, x.component_id) for x in groups(frame(spark, texts), block=block).collect()]
        assert sorted(rows) == want


def test_similar_sets_share_as_many_signatures_as_both_need():
    r = random.Random(4)
    for _ in range(400):
        n = r.choice([1, 2, 3, 5, 8, 13, 30, 60, 61, 62, 150, 400])
        a = [f"w{r.random()}" for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, max(1, n // 5))):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], ["q"], ["p", "q"]]) if len(b) > 1 else ["q"]
        s = Sets(pa.array([" ".join(a), " ".join(b)]), 1)
        x, y = (set(s.h[s.bound[i] : s.bound[i + 1]].tolist()) for i in (0, 1))
        if 100 * len(x & y) >= 75 * len(x | y):
            sig, row, grp, need = signatures(s, 75)
            met = 0
            for g in set(grp.tolist()):
                both = {h: len(set(sig[(row == 0) & (grp == g)].tolist()) & set(sig[(row == 1) & (grp == h)].tolist())) for h in (g, g ^ 1)}
                for h, common in both.items():
                    if common:
                        least = max(need[(row == 0) & (grp == g)].max(), need[(row == 1) & (grp == h)].max())
                        met += common >= least
            assert met, (n, len(x & y), len(x | y))


def test_reached():
    r = random.Random(3)
    t = [words(r, 60)]
    for _ in range(60):
        x = list(r.choice(t))
        x[r.randrange(60)] = str(r.random())
        t.append(x)
    texts = [" ".join(x) for x in t]
    want = {i: c for i, _, c in brute(list(enumerate(texts)))}
    got = reached(Sets(pa.array(texts), 5).names(), 75).tolist()
    assert dict(enumerate(got)) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(1, 5), (9, 5), (7, 9), (3, 3)] + [(500, k) for k in range(501, 560)]
    r = random.Random(1)
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(101, 131)} | {5: 1, 7: 1, 9: 1} | {k: 500 for k in range(501, 560)}
    assert got == want


def test_empty(spark):
    df = frame(spark, ["a b"])
    assert groups(df.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in groups(df).collect()] == [(0, 1, 0)]
