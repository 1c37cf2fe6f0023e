"""Sources, stores and streams, each against its batch form or a plain expectation."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import graph, search
from tessera.sources import files, tables
from tessera.streaming import changes as C


@pytest.fixture
def tree(tmp_path):
    for name, text in {"src/a.ts": "import x from 'y';\nfunction run() { return 1; }\n", "src/deep/b.py": "def f(x):\n    return x\n", "node_modules/c.js": "no", ".hidden/d.js": "no", "e.txt": "no", "bin.js": "a\0b"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
    return str(tmp_path)


def test_scan(spark, tree):
    got = {r.relative_path: r for r in files.scan(spark, tree).collect()}
    assert set(got) == {"src/a.ts", "src/deep/b.py"} and got["src/a.ts"].language == "typescript" and len(got["src/a.ts"].hash) == 64
    assert files.scan(spark, tree, include=["**/*.py"]).count() == 1 and files.scan(spark, tree, exclude=["src/*.ts"]).count() == 1
    assert files.search_names(files.scan(spark, tree), "B.").count() == 1
    total, by = files.directory_stats(files.scan(spark, tree))
    assert total.first().n_files == 2 and by.count() == 2
    assert files.texts(spark, f"{tree}/src").count() == 2
    engine = Engine.of_tree(spark, tree)
    assert engine.keyword("return").count() == 2 and engine.chunks().count() == 2 and engine.hybrid("function run").count() >= 1
    assert engine.analyzed_query("what is class Foo").first().type == "mixed"


@pytest.mark.parametrize("glob,path,ok", [("**/x/**", "a/x/b", True), ("**/x/**", "x/b", True), ("*.ts", "a/b.ts", False), ("**/*.ts", "b.ts", True), ("a?.js", "ab.js", True)])
def test_globs(glob, path, ok):
    import re

    assert bool(re.match(files.glob_pattern(glob), path)) == ok


def test_collections(spark, tmp_path):
    c = tables.Collections(spark, "vectors_test")
    c.drop("p")
    c.create("p", 2)
    row = lambda i, v, t: (i, v, {"language": "go"}, t)
    rows = spark.createDataFrame([row("1", [1.0, 0.0], "2024-01-01"), row("1", [0.0, 1.0], "2024-01-02"), row("2", [1.0, 1.0], "2024-01-01")], "id string, vector array<float>, payload map<string,string>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    c.upsert("p", rows)
    assert {r.id: list(r.vector) for r in c.table("p").collect()} == {"1": [0.0, 1.0], "2": [1.0, 1.0]} and c.info("p")["points"] == "2" and c.info("p")["dim"] == "2"
    c.delete("p", spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in c.ids("p", F.col("payload")["language"] == "go").collect()] == ["2"]
    c.drop("p")
    assert not c.exists("p") and "p" not in c.names()


def test_graph_rows(spark):
    f = spark.createDataFrame([("pr", "a.ts", "ts", ["x", "y"])], "project string, path string, language string, imports array<string>")
    k = spark.createDataFrame([("a.ts", "function", "run"), ("a.ts", "class", "Foo")], "path string, kind string, name string")
    v, e = tables.graph_of_files(f, k)
    assert v.groupBy("tag").count().count() == 5 and {r.type: r["count"] for r in e.groupBy("type").count().collect()} == {"BELONGS_TO": 1, "CONTAINS": 2, "IMPORTS": 2}
    assert graph.counts(v, e).where("name IS NULL").count() == 2
    new = tables.update_properties(v, spark.createDataFrame([("a.ts", {"language": "js", "k": "v"})], "id string, properties map<string,string>"))
    assert new.where("id = 'a.ts'").first().properties == {"language": "js", "k": "v"}
    v2, e2 = tables.delete_vertices(v, e, spark.createDataFrame([("a.ts",)], "id string"))
    assert v2.count() == v.count() - 1 and e2.count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x")], "id int, tags array<string>, s string")
    tables.export(df, f"{tmp_path}/j", "json")
    tables.export(df, f"{tmp_path}/c", "csv")
    assert spark.read.json(f"{tmp_path}/j").first().s == "x" and spark.read.csv(f"{tmp_path}/c", header=True).first().tags == '["a"]'
    back = tables.mappings_from_json(tables.mappings_to_json(df), "id int, tags array<string>, s string")
    assert back.collect() == df.collect()


def _stream(spark, rows, schema, path):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        del k
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _run(df, path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_change_stream_equals_batch(spark, tmp_path):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [[("a", t(1), "h1"), ("b", t(2), "h1"), ("a", t(3), "h1")], [("a", t(5), "h2"), ("b", t(6), None), ("c", t(7), None)]]
    typed = lambda df: df.select("path", F.col("ts").cast("timestamp").alias("ts"), "hash")
    schema = "path string, ts string, hash string"
    batch = C.classify(typed(spark.createDataFrame(rows[0] + rows[1], schema)))
    key = lambda df: sorted((r.path, str(r.ts), r.kind, str(r.previous), str(r.current)) for r in df.collect())
    want = key(batch)
    assert [x[2] for x in want] == ["created", "modified", "created", "deleted"]
    got = _run(C.classify_stream(typed(_stream(spark, rows, schema, tmp_path))), tmp_path, "changes_out")
    assert key(got) == want


def test_debounce_and_windows_stream(spark, tmp_path):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [[("a", t(1), 1.0), ("a", t(3), 2.0), ("a", t(30), 3.0), ("b", t(2), 4.0), ("z", t(900), 0.0)]]
    schema = "path string, ts string, value double"
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = C.debounce(typed(spark.createDataFrame(rows[0], schema)))
    want = sorted((r.path, r.value, r.n_events) for r in batch.collect())
    assert want == [("a", 2.0, 2), ("a", 3.0, 1), ("b", 4.0, 1), ("z", 0.0, 1)]
    stream = typed(_stream(spark, rows, schema, tmp_path))
    assert sorted((r.path, r.value, r.n_events) for r in _run(C.debounce(stream, late="1 second"), tmp_path, "debounced").collect()) == want[:3]
    windows = _run(C.windowed(stream, "10 seconds", late="1 second").select("start", "n", "total"), tmp_path, "windowed")
    assert sorted((r.n, r.total) for r in windows.collect()) == [(1, 3.0), (3, 7.0)]


def test_index_batch(spark):
    store = {"rows": spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int"), "dead": 0}
    run = C.index_batch(lambda: store["rows"], lambda df: store.update(rows=df), lambda df: store.update(dead=df.count()))
    run(spark.createDataFrame([("a", 2, "modified"), ("b", None, "deleted"), ("c", 3, "created"), (None, 4, "created")], "path string, v int, kind string"), 0)
    assert {r.path: r.v for r in store["rows"].collect()} == {"a": 2, "c": 3} and store["dead"] == 1


def test_priority(spark):
    df = spark.createDataFrame([("deleted", 10, "go"), ("created", 2_000_000, "text"), ("modified", 5000, "text")], "kind string, size long, language string")
    assert [r.p for r in df.select(C.priority(F.col("kind"), F.col("size"), F.col("language")).alias("p")).collect()] == [4, 0, 2]


def test_batches_count_over_ranges(spark):
    rows = [(i * 7919 % 1009, (i * i) % 5 if i % 50 else None) for i in range(1000)]
    got = C.batches(spark.createDataFrame(rows, "seq long, priority int"), 50)
    assert "Window" not in got._jdf.queryExecution().toString()
    want = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], -r[0]), reverse=True)
    assert {(r.seq, r.priority): r.batch for r in got.collect()} == {r: k // 50 for k, r in enumerate(want)}
    assert got.columns == ["seq", "priority", "batch"]


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [[("a", i, float(i % 3 > 0)) for i in range(25)] + [("b", i, 0.1) for i in range(9)], [("a", 25 + i, 1.0) for i in range(20)] + [("b", 9 + i, 0.2) for i in range(2)]]
    schema = "key string, seq long, relevance double"
    want = {r.key: (round(r.weight, 9), round(r.confidence, 9), r.batches) for r in search.adapted_weights(spark.createDataFrame(rows[0] + rows[1], schema)).collect()}
    stream = C.adapt_stream(_stream(spark, rows, schema, tmp_path))
    q = stream.writeStream.format("memory").queryName("adapted").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("adapted").orderBy("batches").collect():
        last[r.key] = (round(r.weight, 9), round(r.confidence, 9), r.batches)
    assert last == want and want["a"][2] == 4 and want["b"][2] == 1


def test_engine_of_files(spark, tree):
    engine = Engine.of_tree(spark, tree)
    more = spark.createDataFrame([("src/a.ts", "class New {}", "typescript", "x"), ("n.go", "func f() {}", "go", "x")], "doc_id string, text string, lang string, source string")
    new = engine.with_files(more)
    assert new.docs.count() == 3 and new.docs.where("doc_id = 'src/a.ts'").first().text == "class New {}"
    assert new.without(more.select("doc_id")).docs.count() == 1 and new.projects().count() == 2
    assert {r.source: r.n_files for r in new.status().collect()}["x"] == 2
    assert engine.concept("api", threshold=None).count() == 2
    found = files.scan(spark, tree)
    assert files.largest(found, 1).first().relative_path == "src/a.ts" and {r.extension for r in files.by_extension(found).collect()} == {"ts", "py"}


def test_rules_from_yaml():
    pytest.importorskip("yaml")
    from tessera.operators import rules

    text = "rules:\n  - id: a\n    severity: ERROR\n    message: m\n    pattern-regex: 'x+'\n  - id: b\n    pattern: $X\n"
    assert rules.from_yaml(text) == [{"id": "a", "severity": "ERROR", "message": "m", "pattern": "x+"}] and rules.from_yaml("") == []
