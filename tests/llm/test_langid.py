import random
import zlib

import numpy as np

from gridloom.llm.langid import SWITCH, Model, identified, learned, paths, spans, viterbi


def brute(s, switch):
    n, k = s.shape
    best = {(): 0.0}
    for t in range(n):
        best = {p + (x,): v + s[t, x] - (switch if p and p[-1] != x else 0) for p, v in best.items() for x in range(k)}
    return max(best.values())


def value(s, p, switch):
    return s[np.arange(len(p)), p].sum() - switch * (p[1:] != p[:-1]).sum()


def test_best_paths():
    r = np.random.default_rng(1)
    for _ in range(40):
        sizes = r.integers(0, 7, 4)
        s = -r.integers(0, 6, (sizes.sum(), 3)).astype(float)
        bound = np.concatenate([[0], np.cumsum(sizes)])
        p, whole = paths(s, bound, 3.0), viterbi(s, bound, 3.0)
        for a, b in zip(bound, bound[1:], strict=False):
            if b > a:
                assert value(s[a:b], p[a:b], 3.0) == value(s[a:b], whole[a:b], 3.0) == brute(s[a:b], 3.0)


def corpus():
    r = random.Random(2)
    parts = {"aa": ["the", "ing", "wh", "ould"], "bb": ["ciò", "gli", "zza", "nel"], "cc": ["при", "что", "ого", "ыва"]}
    text = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, r.randint(3, 60)), k) for i, k in enumerate(r.choice(list(parts)) for _ in range(150))]
    return text, rows


def test_held_out_accuracy_and_odd_texts(spark):
    text, rows = corpus()
    odd = [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (903, text("aa", 40), None), (904, "漢字", None), (None, text("bb", 9), "aa")]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in identified(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, _, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert got[900].score == 0 and not got[None].held_out
    model = learned(df)
    mixed = text("aa", 30) + " " + text("bb", 30)
    assert [x[2] for x in spans(mixed, model)] == ["aa", "bb"]
    assert identified(df.limit(0)).collect() == []
    assert identified(df.where("doc_id is null")).collect()[0].lang_pred == "und"


def test_predictions_as_word_by_word(spark):
    """Scores of one word at a time, a plain best path, a plain vote."""
    text, rows = corpus()
    r = random.Random(7)
    texts = [" ".join(text(r.choice(["aa", "bb", "cc"]), r.randint(1, 9)) for _ in range(r.randint(1, 4))) for _ in range(40)] + ["12 !", "the 12 при"]
    model = Model([t for _, t, _ in rows], [k for _, _, k in rows])
    got = {x.doc_id: x for x in identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        scores, has = zip(*(model.scores([w]) for w in t.split()), strict=True)
        s, has = np.concatenate(scores), np.concatenate(has)
        best, back = s[0].copy(), []
        for x in s[1:]:
            moved = best.max() - SWITCH > best
            back.append(np.where(moved, best.argmax(), np.arange(len(best))))
            best = np.where(moved, best.max() - SWITCH, best) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        votes = np.bincount(np.array(path[::-1])[has], minlength=3)
        want = ("und", 0.0) if not has.any() else (model.languages[int(votes.argmax())], votes.max() / votes.sum())
        assert (got[i].lang_pred, got[i].score) == want, t


def test_nothing_learned():
    assert spans("a b", Model([], [])) == []
