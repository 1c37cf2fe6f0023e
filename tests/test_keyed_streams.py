import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from tessera.operators import search
from tessera.sources import tables
from tessera.sources.keyed import Keyed
from tessera.streaming import changes as C


@pytest.fixture
def database(spark):
    name = f"keyed_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def files(spark, keyed):
    where = spark.sql(f"DESCRIBE DATABASE {keyed.database}").where("info_name = 'Location'").first().info_value.removeprefix("file:")
    return {f: os.path.getmtime(f) for f in glob.glob(f"{where}/{keyed.plain}/*/*.parquet")}


def rows_of(keyed):
    return {r.id: r.v for r in keyed.read().collect()}


def made(spark, database, n=200, buckets=16):
    k = Keyed(spark, database, f"t{uuid.uuid4().hex[:6]}", ["id"])
    k.create("id STRING, v INT, ts INT", buckets)
    k.apply(spark.range(n).selectExpr("CAST(id AS STRING) id", "CAST(id AS INT) v", "1 AS ts"), order="ts")
    return k


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v int, ts int")


def test_a_change_rewrites_the_buckets_that_it_touches(spark, database):
    k = made(spark, database)
    before = files(spark, k)
    k.apply(frame(spark, ("5", 50, 2), ("5", 51, 3), ("5", 49, 1)), order="ts")
    after = files(spark, k)
    assert len(before) == 16 and len(set(before.items()) & set(after.items())) == 15
    want = {str(i): i for i in range(200)} | {"5": 51}
    assert rows_of(k) == want
    k.apply(frame(spark, ("5", 1, 9), ("new", 2, 1), (None, 3, 1)), spark.createDataFrame([("6",), ("5",), ("absent",)], "id string"), "ts")
    del want["6"]
    assert rows_of(k) == want | {"5": 1, "new": 2, None: 3}


def test_buckets_that_lose_all_rows(spark, database):
    k = made(spark, database, 30)
    k.apply(deletes=spark.range(1, 30).selectExpr("CAST(id AS STRING) id"))
    assert rows_of(k) == {"0": 0} and len(files(spark, k)) == 1
    k.replace(frame(spark, ("x", 1, 1)))
    assert rows_of(k) == {"x": 1}
    k.replace(frame(spark))
    assert rows_of(k) == {} and k.apply(None, None) and k.apply(frame(spark))
    k.clear()
    assert rows_of(k) == {}


def test_an_epoch_is_taken_once(spark, database):
    k = made(spark, database, 10)
    assert k.epoch("s") == -1
    assert k.apply(frame(spark, ("1", 100, 2)), stream="s", epoch=0) and k.epoch("s") == 0
    before = files(spark, k)
    assert not k.apply(frame(spark, ("1", 200, 2)), stream="s", epoch=0) and files(spark, k) == before and rows_of(k)["1"] == 100
    assert k.apply(frame(spark, ("1", 300, 2)), stream="other", epoch=0) and k.apply(None, None, stream="s", epoch=1) and k.epoch("s") == 1


def test_a_writer_that_dies(spark, database, monkeypatch):
    k = made(spark, database, 10)
    real = Keyed._settle

    def dies(self, *args):
        raise KeyboardInterrupt

    # With the stage complete: the next one finishes it.
    monkeypatch.setattr(Keyed, "_settle", dies)
    with pytest.raises(KeyboardInterrupt):
        k.apply(frame(spark, ("1", 100, 2)), spark.createDataFrame([("2",)], "id string"), stream="s", epoch=4)
    monkeypatch.setattr(Keyed, "_settle", real)
    assert spark.table(k.name).where("id = '1'").first().v == 1
    got = rows_of(k)
    assert got["1"] == 100 and "2" not in got and k.epoch("s") == 4 and not k.apply(frame(spark, ("1", 5, 5)), stream="s", epoch=4)
    # With half a stage: it is dropped.
    monkeypatch.setattr(Keyed, "_set", dies)
    with pytest.raises(KeyboardInterrupt):
        k.apply(frame(spark, ("1", 7, 7)), stream="s", epoch=5)
    monkeypatch.undo()
    assert rows_of(k)["1"] == 100 and k.epoch("s") == 4
    assert k.apply(frame(spark, ("1", 7, 7)), stream="s", epoch=5) and rows_of(k)["1"] == 7


def stores(spark, database):
    c = tables.Collections(spark, database)
    c.create("v", 2, buckets=4)
    s = tables.Spaces(spark, f"{database}_")
    s.create("g", buckets=4)
    vector = C.Store(c.keyed("v"), lambda b: b.select(F.col("path").alias("id"), F.array(F.col("size").cast("float"), F.lit(1.0).cast("float")).alias("vector"), "ts"), lambda b: b.select(F.col("path").alias("id")), "ts")
    vertex = C.Store(s.keyed("g", "vertices"), lambda b: b.select(F.lit("file").alias("tag"), F.col("path").alias("id"), F.create_map(F.lit("size"), F.col("size").cast("string")).alias("properties")), lambda b: b.select(F.col("path").alias("id")))
    state = lambda: ({r.id: r.vector[0] for r in c.table("v").collect()}, {r.id: r.properties["size"] for r in s.vertices("g").collect()})
    return c, s, vector, vertex, state


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, size int, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_two_stores_take_each_epoch_once(spark, database):
    c, s, vector, vertex, state = stores(spark, database)
    dead = C.DeadLetters(spark, database)
    run = C.index_epochs([vector, vertex], "files", dead, wait=0)
    day = "2024-01-01"
    first = batch(spark, ("a", 1, "created", day), ("b", 2, "created", day), (None, 9, "created", day))
    run(first, 0)
    assert state() == ({"a": 1.0, "b": 2.0}, {"a": "1", "b": "2"}) and dead.read().count() == 1
    then = files(spark, vector.table), files(spark, vertex.table)
    run(first, 0)
    run(batch(spark, ("a", 77, "modified", day)), 0)  # an epoch is known by its number
    assert state() == ({"a": 1.0, "b": 2.0}, {"a": "1", "b": "2"}) and (files(spark, vector.table), files(spark, vertex.table)) == then
    run(batch(spark, ("a", None, "deleted", day), ("c", 3, "created", day), ("b", 5, "modified", day)), 1)
    assert state() == ({"b": 5.0, "c": 3.0}, {"b": "5", "c": "3"})
    assert {(r.epoch, r.store) for r in dead.read().collect()} <= {(0, None)}
    s.drop("g")


def test_a_failure_between_the_two_stores(spark, database, monkeypatch):
    c, s, vector, vertex, state = stores(spark, database)
    real, day, calls = Keyed.apply, "2024-01-01", []

    def fails(self, *args, **more):
        if self.plain == "vertices":
            calls.append(1)
            raise OSError("no graph")
        return real(self, *args, **more)

    run = C.index_epochs([vector, vertex], "files", wait=0)
    rows = batch(spark, ("a", 1, "created", day))
    monkeypatch.setattr(Keyed, "apply", fails)
    with pytest.raises(OSError):
        run(rows, 0)
    assert state() == ({"a": 1.0}, {}) and len(calls) == 3
    monkeypatch.undo()
    before = files(spark, vector.table)
    run(rows, 0)  # the stream begins again with the same epoch
    assert state() == ({"a": 1.0}, {"a": "1"}) and files(spark, vector.table) == before
    # With dead letters the stream goes on, and a replay of the epoch leaves one copy of them.
    dead = C.DeadLetters(spark, database)
    run = C.index_epochs([vector, vertex], "files", dead, wait=0)
    monkeypatch.setattr(Keyed, "apply", fails)
    run(batch(spark, ("d", 4, "created", day)), 1)
    run(batch(spark, ("d", 4, "created", day)), 1)
    assert [(r.epoch, r.store) for r in dead.read().collect()] == [(1, f"{database}_g.vertices")]
    s.drop("g")


def test_a_stream_into_two_stores(spark, database, tmp_path):
    c, s, vector, vertex, state = stores(spark, database)
    for k, rows in enumerate([[("a", 1, "created", "2024-01-01"), ("b", 1, "created", "2024-01-01")], [("a", 2, "modified", "2024-01-02"), ("b", None, "deleted", "2024-01-02")]]):
        batch(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del k
    for _ in range(2):  # started again, it finds nothing to do
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(C.index_epochs([vector, vertex], "files", wait=0)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None and state() == ({"a": 2.0}, {"a": "2"})
    assert vector.table.epoch("files") == 1
    s.drop("g")


# ---- state with timers


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def source(spark, path, parts, schema):
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
        df.write.parquet(f"{path}/made/{k}")
        os.makedirs(f"{path}/in", exist_ok=True)
        (one,) = glob.glob(f"{path}/made/{k}/*.parquet")
        os.rename(one, f"{path}/in/{k}.parquet")
        os.utime(f"{path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(df, path, mode="append"):
    name = f"out_{uuid.uuid4().hex[:6]}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def at(second):
    return f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def test_changes_out_of_order_across_batches(rocks, tmp_path):
    r = random.Random(3)
    events = [(f"p{k % 3}", at(10 + 7 * k), r.choice(["h1", "h2", None])) for k in range(40)]
    late = sorted(range(40), key=lambda k: k + r.randrange(0, 6))  # up to 42 seconds out of order
    parts = [[events[k] for k in late[a : a + 8]] for a in range(0, 40, 8)] + [[("end", at(3000), "h")], [("end", at(6000), "i")]]
    schema = "path string, ts string, hash string"
    whole = rocks.createDataFrame([e for p in parts for e in p], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda rows: sorted((x.path, str(x.ts), x.kind, str(x.previous), str(x.current)) for x in rows if x.path != "end")
    want = key(C.classify(whole).collect())
    got = run(C.classify_stream(source(rocks, tmp_path, parts, schema), late="2 minutes"), tmp_path)
    assert len(want) > 15 and key(got) == want


def test_a_silent_path_is_forgotten(rocks, tmp_path):
    parts = [[("a", at(0), "h"), ("b", at(0), "h")], [("b", at(500), "h")], [("c", at(1500), "h")], [("a", at(1600), "h"), ("b", at(1600), "h")], [("c", at(4000), "i")], [("c", at(6000), "j")]]
    got = run(C.classify_stream(source(rocks, tmp_path, parts, "path string, ts string, hash string"), late="10 seconds", keep="20 minutes"), tmp_path)
    assert sorted((x.path, x.kind) for x in got if x.path != "c") == [("a", "created"), ("a", "created"), ("b", "created")]


def test_feedback_out_of_order_equals_batch(rocks, tmp_path):
    r = random.Random(5)
    events = [("a" if k % 3 else "b", at(10 + k), k, r.choice([0.1, 0.9, 0.5, 1.0])) for k in range(120)]
    order = sorted(range(120), key=lambda k: k + r.randrange(0, 20))
    parts = [[events[k] for k in order[a : a + 40]] for a in range(0, 120, 40)] + [[("end", at(3000), 0, 0.5)], [("end", at(6000), 1, 0.5)]]
    schema = "key string, ts string, seq long, relevance double"
    whole = rocks.createDataFrame(events, schema)
    want = {x.key: (round(x.weight, 9), round(x.confidence, 9), x.batches) for x in search.adapted_weights(whole).collect()}
    last = {}
    for x in sorted(run(C.adapt_stream(source(rocks, tmp_path, parts, schema), late="1 minute"), tmp_path, "update"), key=lambda x: x.batches):
        last[x.key] = (round(x.weight, 9), round(x.confidence, 9), x.batches)
    del last["end"]
    assert last == want
