import base64
import hashlib

from gridloom.llm.warc import archived, lookup, opened, read_back, round_trip, seek_table


def pages(spark):
    body = ["<p>a</p>", "<p>a</p>", None, "", "x" * 5000, "é\r\n\r\nWARC/1.1\r\n\r\n", "<p>a</p>", "y" * 900] + [f"<b>{i}</b>" for i in range(40)]
    return body, spark.createDataFrame([(i, None if i == 4 else f"http://x/{i}", h, i) for i, h in enumerate(body)], "page_id long, url string, html string, sha1 int").repartition(3)


def test_round_trip(spark, tmp_path):
    body, df = pages(spark)
    raw = [(h or "").encode() for h in body]
    got = {r.page_id: r for r in round_trip(df, f"file://{tmp_path}/a", frame_bytes=700, bundle_bytes=1500).collect()}
    assert len(got) == len(body)
    for i, b in enumerate(raw):
        top = max(j for j, x in enumerate(raw) if x == b)
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    least = {r.page_id: r.record_type for r in round_trip(df, f"file://{tmp_path}/b", least_bytes=1).collect()}
    assert least[2] == "response" == least[3] and least[0] == "revisit"


def test_index_and_seek_table(spark, tmp_path):
    body, df = pages(spark)
    index = archived(df, f"file://{tmp_path}/c", frame_bytes=700)
    assert read_back(index).count() == len(body)
    for r in index.collect():
        head, payload = lookup(r)
        assert head["WARC-Record-ID"] == f"<urn:x-page:{r.page_id}>"
        if head["WARC-Type"] == "response":
            assert payload == (body[r.page_id] or "").encode()
        fs, path = opened(r.bundle)
        with fs.open_input_file(path) as f:
            table = seek_table(f, f.size())
        assert table[r.frame][:2] == (r.frame_offset, r.frame_bytes) and r.offset + r.length <= table[r.frame][2]


def test_odd_tables(spark, tmp_path):
    _, df = pages(spark)
    assert round_trip(df.limit(0), f"file://{tmp_path}/d").collect() == []
    twice = spark.createDataFrame([(1, "u", "z"), (1, "u", "z"), (None, None, "z"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in round_trip(twice, f"file://{tmp_path}/e").collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
