import random
import re

from pyspark.sql import functions as F

from gridloom.llm.quality import judged

from .data import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    cover = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(cover), n < 10 or 100 * len(cover) > 20 * n


def brute_kept(rows, limit, min_words=10, min_left=0.5):
    """(kept, words of shared lines) of (text, host) rows, line by line."""
    lines = lambda t: [(x, " ".join(WORD.findall(x.translate({c: c + 32 for c in range(0x41, 0x5B)})))) for x in (t or "").split("\n")]
    texts = {}
    for t, host in rows:
        for _, x in lines(t):
            if x:
                texts.setdefault((host, x), set()).add(t)
    out = []
    for t, host in rows:
        n, *_, failed = brute(t)
        gone = sum(len(x.split(" ")) for _, x in lines(t) if x and len(texts[host, x]) > limit)
        out.append((not failed and not (gone and (n - gone < min_words or n - gone < min_left * n)), gone))
    return out


def test_kept_as_line_by_line(spark):
    r = random.Random(5)
    common = [" ".join(f"c{k}x{j}" for j in range(r.randint(1, 14))) for k in range(12)]
    texts = []
    for i in range(160):
        own = [" ".join(f"w{i}x{j}x{k}" for k in range(r.randint(1, 12))) for j in range(r.randint(0, 4))]
        t = own + [x.upper() if r.random() < 0.2 else x.replace(" ", "  ") for x in r.sample(common, r.randint(0, 4))]
        r.shuffle(t)
        texts.append("\n".join(t))
    texts += [None, "", texts[3], texts[3]]
    df = frame(spark, texts)
    got = {x.doc_id: (x.kept, x.n_line_words) for x in judged(df, line_limit=12).collect()}
    want = brute_kept([(t, f"s{i % 2}") for i, t in enumerate(texts)], 12)
    assert [got[i] for i in range(len(texts))] == want and 20 < sum(k for k, _ in want) < 140


def test_measures(spark):
    texts = [*corpus(9, 40), "a | b\n\na | b\n c # <d>\n c # <d>\na | b", "one two three four five " * 2 + " ".join(map(str, range(60)))]
    got = {r.doc_id: r for r in judged(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert r.kept == (not r.base_failed)
    assert judged(frame(spark, texts).limit(0)).collect() == []


def test_shared_lines(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    furniture = "home | about us | contact | all rights reserved now and then for ever and ever amen"
    texts = [furniture + "\n" + own(i) for i in range(6)]  # most of the words are the shared line's
    texts += [furniture.upper() + "\n" + " ".join(own(i) for i in range(i, i + 9)) for i in range(6)]
    texts += [own(77)] * 20  # copies of one text are one document
    df = frame(spark, texts)
    df = df.withColumn("source", df.source.substr(1, 1))
    got = {r.doc_id: r for r in judged(df, line_limit=5).collect()}
    assert [got[i].kept for i in range(6)] == [False] * 6
    assert all(got[i].kept and got[i].n_line_words > 0 for i in range(6, 12))
    assert all(got[i].kept for i in range(12, 32))
    assert all(r.kept for r in judged(df, line_limit=12).collect())
    assert all(r.kept for r in judged(df.drop("source").withColumn("source", df.doc_id.cast("string")), line_limit=5).collect())


def test_shared_lines_leave_the_text(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    texts = [f"Home |  About us\r\n{own(i)}\n\nhome | about US\nlast {i}" for i in range(8)] + [own(9) + "\nHome | About us here"]
    df = frame(spark, texts).withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in judged(df, line_limit=5, carry=("lang",)).collect()}
    assert [got[i].kept_text for i in range(8)] == [f"{own(i)}\n\nlast {i}" for i in range(8)]
    assert all(got[i].kept and got[i].n_line_words == 8 and got[i].n_words == 40 for i in range(8))
    assert (got[8].kept_text, got[8].n_line_words, got[8].lang) == (texts[8], 0, "de")


def test_long_shared_lines(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    notice = " ".join(f"notice{j}" for j in range(60))
    df = frame(spark, [f"{own(i)}\n{notice}" for i in range(8)] + [notice + f" {i}" for i in range(3)]).withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in judged(df, line_limit=5).collect()}
    assert all((got[i].kept_text, got[i].n_line_words, got[i].kept) == (own(i), 60, True) for i in range(8))
    assert all(got[i].n_line_words == 0 for i in range(8, 11))


def test_the_limit_does_not_grow_with_the_host(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    few = [f"{own(i)}\nshared line of some documents" for i in range(8)]
    df = frame(spark, few + [own(i) for i in range(8, 500)] + [own(0)] * 500).withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in judged(df, line_limit=5).collect()}
    assert all((got[i].kept_text, got[i].n_line_words) == (own(i), 5) for i in range(8))
    assert all(r.kept for r in got.values()) and sum(r.n_line_words for r in got.values()) == 40
