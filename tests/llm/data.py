"""Small corpora with copies, near copies, shared passages, odd texts and nulls."""

import random


def words(r, n, vocabulary=400):
    return [f"{r.choice('abcdeé')}{r.randint(0, vocabulary)}" for _ in range(n)]


def corpus(seed=5, n=60):
    r = random.Random(seed)
    passage = words(r, 70)
    long = words(r, 300)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = words(r, r.randint(0, 150))
        elif kind == 1:
            t = words(r, r.randint(5, 60)) + passage[: r.randint(45, 70)] + words(r, r.randint(0, 40))
        elif kind == 2:
            t = list(long)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = "edit"
        elif kind == 3:
            t = ["same"] * r.randint(0, 130)
        elif kind == 4:
            t = (words(r, 3) * 60)[: r.randint(1, 160)]
        else:
            t = long[r.randint(0, 100) :][: r.randint(40, 200)] + passage
        sep = [" ", "\n", "  ", "\t", " \r\n\x0b"]
        out.append("".join(w + r.choice(sep) for w in t))
    out += ["", " ", None, out[5], out[5], out[2], "x", "é" * 300, "é" * 300, "ab" * 250, "\x1c \x85 "]
    return out


def frame(spark, texts, parts=3, ids=None):
    rows = [(ids[i] if ids else i, t, ["en", None, "de"][i % 3], f"s{i % 2}", 7 * i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long").repartition(parts)
