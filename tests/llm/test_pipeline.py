import random

import corpus_pipeline
import pytest

pytest.importorskip("public_tokenizers")
from .test_jaccard import brute as brute_groups
from .test_quality import brute as brute_quality
from .test_repeats import brute_words


def table(spark, path):
    r = random.Random(11)
    parts = {"en": ["th", "e", "ing", "ou", "wh"], "de": ["ch", "ung", "ß", "ei", "sch"]}
    word = lambda k: "".join(r.choice(parts[k]) for _ in range(r.randint(2, 5)))
    text = lambda k, n: [word(k) for _ in range(n)]
    passage = text("en", 80)
    rows = []
    for i in range(60):
        k = r.choice(["en", "de"])
        t = text(k, r.choice([4, 30, 120, 300]))
        if i % 5 == 0:
            t += passage
        rows.append((i, " ".join(t), k))
    for i in range(60, 80):
        t = rows[i - 55][1].split()
        t[len(t) // 2] = "edit"
        rows.append((i, " ".join(t), rows[i - 55][2]))
    rows += [(90, None, "en"), (91, "12 34 !!", "en"), (92, "", None), (93, "the same words " * 20, "en"), (94, rows[7][1], None), (95, rows[12][1], "en")]
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")


def test_stages(spark, tmp_path):
    table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_copies", "passages", "packing"] and corpus_pipeline.ORACLE_SQL is None
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:-1]]
    for d in seen[1:-1]:
        assert d.columns == docs.columns
    assert set(rows[0]) - set(rows[1]) == {90, 91, 92}
    assert set(rows[2]) == {i for i, r in rows[1].items() if not brute_quality(r.text)[-1]}
    groups = brute_groups([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, _, c in groups if i == c} and len(rows[3]) < len(rows[2])
    want = {i: n - gone for i, n, gone, _ in brute_words([(i, r.text) for i, r in rows[3].items()])}
    assert {i: len(r.text.split()) for i, r in rows[4].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[4].values()) and sum(want.values()) < sum(len(r.text.split()) for r in rows[3].values())
    assert {r.doc_id for r in seen[-1].collect()} == set(rows[4])
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert {r.doc_id for r in got.select(*key).collect()} == set(rows[4])


def test_shared_lines_do_not_pass_the_rules(spark, tmp_path):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"Home | About us\n{own(i)}", "en", "s", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.rules(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(i, own(i), len(own(i))) for i in range(60)}


def test_near_copies_without_ids_or_with_reused_ids(spark, tmp_path):
    text = lambda k: " ".join(f"{k}{j}" for j in range(60))
    rows = [(None, text("a") + f" {i}") for i in range(4)] + [(7, text("b")), (7, text("c")), (7, text("b") + " more"), (8, text("c"))] + [(None, text("d")), (9, text("d"))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [rows[0], rows[4], rows[5], rows[9]]


def test_extra_columns_with_clashing_names(spark, tmp_path):
    names = ["score", "n_words", "kept_text", "lang_pred", "row", "first", "host", "others", "line"]
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, own(i % 10), "en", f"s{i % 2}", 0, *range(len(names))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            assert {tuple(r)[5:] for r in docs.collect()} == {tuple(range(len(names)))}
    assert {r.doc_id for r in out.collect()} == set(range(10))


def test_passes_read_the_same_partitions_when_cores_come_or_go(spark, tmp_path):
    from gridloom.llm.substring import deduplicated

    from .data import corpus, frame

    frame(spark, corpus(9), 7).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = deduplicated(docs)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        got = sorted(str(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got == sorted(str(r) for r in deduplicated(docs).collect())
