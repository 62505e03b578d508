import hashlib

from gridloom.llm.fingerprints import differing, edit_fingerprints, fingerprint, likeness

from .data import corpus, frame


def test_rows(spark):
    texts = corpus(3, 40)
    ids = [3 * i for i in range(len(texts))]
    for parts in (1, 5):
        got = {r.doc_id: r for r in edit_fingerprints(frame(spark, texts, parts, ids)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[:k]
            r = got[3 * i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(edited)
            assert r.near_edited == likeness(fingerprint(t), fingerprint(edited))
            assert r.near_next == likeness(fingerprint(t), fingerprint(nxt))


def test_tree():
    a = " ".join(f"word{i}" for i in range(400)) + "\n\n" + "\n".join(f"line {i} of a second part" for i in range(30))
    b = a.replace("line 17 of", "line 17 off")
    assert fingerprint(a) == fingerprint(a) != fingerprint(b)
    assert 0.9 < likeness(fingerprint(a), fingerprint(b)) < 1 and len(differing(fingerprint(a), fingerprint(b))) == 1
    assert differing(fingerprint(a), fingerprint(a)) == []
    assert likeness(fingerprint(a), fingerprint("nothing alike here at all")) == 0
    for x in ("", " ", "\n\n", "a", " a", "a ", "a\n"):
        assert fingerprint(x) != fingerprint(x + " ") and likeness(fingerprint(x), fingerprint(x)) == 1


def test_odd_tables(spark):
    df = frame(spark, ["a b c d"])
    assert edit_fingerprints(df.limit(0)).collect() == []
    assert [r.near_next for r in edit_fingerprints(df).collect()] == [1.0]
    twice = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None), (None, "q"), (0, "zz")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_chars, r.near_next) for r in edit_fingerprints(twice).collect()), key=str)
    assert [x[:2] for x in got] == [(0, 2), (1, 3), (1, 3), (None, 0), (None, 1)]


def test_thue_morse_texts_differ():
    """Texts that polynomial hashes modulo a power of two can't tell apart."""
    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    for pre, post in (("", ""), ("some words before ", " and some after")):
        a, b = fingerprint(pre + t + post), fingerprint(pre + u + post)
        assert a != b and likeness(a, b) < 1


def test_pieces_are_bounded():
    for text in ("is " * 700, "Ertionha " * 90, "ab cd " * 200, "x" * 5000, "\u4e00\u4e8c" * 700):
        edited = text[: len(text) - len(text) // 4] + ("another end " * 1000)[: len(text) // 4]
        assert 0.5 < likeness(fingerprint(text), fingerprint(edited)) < 1


def test_helper_columns_of_the_input_are_ignored(spark):
    names = ["key", "at", "range", "bucket", "extra", "previous", "place"]
    df = spark.createDataFrame([(i, f"text {i}", *range(7)) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(r.n_chars for r in edit_fingerprints(df).collect()) == [6] * 5


def test_rows_of_one_id_are_dealt_out(spark):
    """A third of all rows have one id, a third have none; each text is edited by the next in order of id and hash."""
    from pyspark.sql import functions as F

    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text number {i} with {i * i} words " * (1 + i % 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    listed = [(-(1 << 63) if r.doc_id is None else r.doc_id, r.h % (1 << 64), r.text, r.doc_id) for r in df.select("*", F.xxhash64("text").alias("h")).collect()]
    listed.sort()
    want = []
    for k, (_, _, t, i) in enumerate(listed):
        nxt = listed[(k + 1) % len(listed)][2]
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    out = edit_fingerprints(df)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in out.collect())
    parts = out.select("doc_id", "edited_sha256", F.spark_partition_id().alias("p")).where("doc_id is null").groupBy("p").agg(F.count("edited_sha256").alias("n")).collect()
    assert len(parts) > 1 and max(r.n for r in parts) < 250


def test_a_very_long_text(spark):
    texts = ["word " * 1_000_000, "x" * 5_000_000, "end"]
    got = {r.doc_id: r for r in edit_fingerprints(frame(spark, texts)).collect()}
    assert [got[i].n_chars for i in range(3)] == [len(t) for t in texts] and got[0].near_edited > 0.7
