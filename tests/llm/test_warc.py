import base64
import hashlib
import random

import pytest
from tessera.llm import warc as R

PAGES = [(1, "http://www.B.example/x?b=2&a=1#f", "same", 0), (2, "https://b.example:443/x", "same", 0), (3, None, None, 0), (4, "http://a.example", "", 0), (5, "not a url\n", "é" * 1000, 0), (6, "http://b.example/x", "same", 0), (7, "http://[bad", "x\r\n\r\ny" * 50, 0)]


def test_round_trip(spark, tmp_path):
    spark.createDataFrame(PAGES * 1, "page_id long, url string, html string, offset int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in R.query(spark, str(tmp_path)).collect()}
    by_payload = {}
    for i, _, h, _ in PAGES:
        by_payload.setdefault((h or "").encode(), []).append(i)
    for payload, ids in by_payload.items():
        for i in ids:
            r, top = got[i], max(ids)
            assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
    assert len(got) == len(PAGES)


def test_history_is_in_order(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h{rng.randrange(4)}.example/{rng.randrange(5)}", str(rng.random())) for i in range(300)]
    runs = R.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5))
    assert runs.select("file").distinct().count() == 5
    lines = [(r.urlkey, r.ts, r.page_id, r.file, r.offset, r.length) for r in R.merge_runs(runs).collect()]
    assert len(lines) == 300 and lines == sorted(lines, key=R._order)


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted([(rng.choice("abc"), "t", rng.randrange(9), "f", rng.randrange(99), 1) for _ in range(rng.randrange(30))], key=R._order) for _ in range(k)]
        assert list(R.LoserTree(runs)) == sorted([x for r in runs for x in r], key=R._order)


def test_repeated_rows_nulls_and_none(spark):
    pages = spark.createDataFrame([(1, "u", "p"), (1, "u", "p"), (None, "v", "p"), (None, "w", "q")], "page_id long, url string, html string")
    runs = R.write(pages)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in R.read(runs.select("file").distinct()).collect())
    assert got == [("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "revisit", 1)]
    assert R.write(pages.limit(0)).count() == 0


@pytest.mark.parametrize("url,key", [("http://www.Example.com/A?b=2&a=1#x", "com,example)/a?a=1&b=2"), ("https://example.com:8080", "com,example:8080)/"), (None, "")])
def test_url_key(url, key):
    assert R.url_key(url) == key


def test_query_takes_odd_ids_columns_and_none(spark, tmp_path):
    pages = [(2**63 - 1, "http://a.example/1", "x", "never"), (None, "http://a.example/0", "x", None), (3 * 10**11, None, None, ""), (5, "http://b.example", "y", "2024"), (-7, "http://c.example", "z", "1")]
    schema = "page_id long, url string, html string, ts string"
    for name, rows in (("some", pages), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = R.query(spark, f"{tmp_path}/some")
    assert {r.page_id: (r.record_type, r.refers_to) for r in got.collect()} == {2**63 - 1: ("response", None), None: ("revisit", 2**63 - 1), 3 * 10**11: ("response", None), 5: ("response", None), -7: ("response", None)}
    order = [r.place for r in sorted(got.collect(), key=lambda r: (r.urlkey, r.ts, r.page_id or 0))]
    assert order == list(range(5)) and all(len(r.ts) == 14 for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert R.query(spark, f"{tmp_path}/none").count() == 0


def test_times_are_an_argument(spark):
    pages = spark.createDataFrame([(1, "http://a.example", "p", "2020-02-03 04:05:06"), (2, "http://a.example", "q", None)], "page_id long, url string, html string, seen string")
    assert sorted(r.ts for r in R.write(pages, time="seen").collect()) == ["20200203040506", "20240101000002"]
    assert sorted(r.ts for r in R.write(pages).collect()) == ["20240101000001", "20240101000002"]
