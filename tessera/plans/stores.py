"""Queries over two stores of one set: ``documents`` as vectors, ``labels`` as graph; and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search, sync
from tessera.plans.common import r6, table


def _mapping(spark, d):
    v = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("entity_id"), F.col("doc_id").alias("id"))
    g = table(spark, d, "labels").select(F.col("doc_id").alias("entity_id"), (F.col("doc_id") * 10).alias("id"))
    return sync.mapping(v, g)


def _status(spark, d):
    return _mapping(spark, d).groupBy("sync_status").agg(F.count("*").alias("n"))


def _issues(spark, d):
    return sync.issues(_mapping(spark, d), F.col("graph_id") % 70 == 0)


def _rates(spark, d):
    return sync.rates(sync.issues(_mapping(spark, d)), F.col("entity_id") % 3 == 0).withColumn("resolved_pct", r6("resolved_pct"))


def _repaired(spark, d):
    a = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", "lang")
    return sync.repaired(a, table(spark, d, "documents").select("doc_id", F.upper("lang").alias("lang")), "doc_id")


def _parts(spark, d):
    old = table(spark, d, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_retailprice")
    new = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return old, new


def _split(spark, d):
    old, new = _parts(spark, d)
    update, create = sync.split(new, old, "p_partkey")
    return update.select("p_partkey", F.lit("update").alias("action")).union(create.select("p_partkey", F.lit("create")))


def _upsert(spark, d):
    old, new = _parts(spark, d)
    return sync.upsert(old, new, "p_partkey").select("p_partkey", "p_name")


def _delete(spark, d):
    old, new = _parts(spark, d)
    return sync.delete(old, new, "p_partkey").select("p_partkey")


def _changed(spark, d):
    digest = lambda t: F.sha2(t, 256).alias("hash")
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), digest(F.col("text")))
    before = table(spark, d, "documents").select(F.col("doc_id").alias("path"), digest(F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("text"))))
    return sync.changed(now, before, "path", "hash").select("path")


def _symbols(spark, d):
    place = lambda key, line: [(F.col(key) % 40).alias("file_path"), line.cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line")]
    hits = table(spark, d, "supplier").select(*place("s_suppkey", F.col("s_suppkey") % 7), F.lit(0.6).alias("score")).distinct()
    symbols = table(spark, d, "part").select(*place("p_partkey", F.col("p_size") % 9), F.lit(0.5).alias("score"), F.col("p_partkey").alias("symbol"))
    got = search.add_symbol_hits(hits, symbols)
    return got.select("file_path", "start_line", "symbol", r6("score").alias("score"))


def _adapted(spark, d):
    f = table(spark, d, "events").select((F.col("user_id") % 6).alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("relevance"))
    return search.adapted_weights(f).select("key", r6("weight").alias("weight"), r6("confidence").alias("confidence"), "batches")


QUERIES = {
    "sync_status": _status, "consistency_issues": _issues, "issue_rates": _rates, "repaired_store": _repaired, "upsert_split": _split, "upsert": _upsert,
    "delete_rows": _delete, "changed_rows": _changed, "symbol_hits": _symbols, "adaptive_weights": _adapted,
}
_MAP = """m AS (SELECT coalesce(v.doc_id, g.doc_id) AS entity_id, v.doc_id AS vector_id, g.doc_id * 10 AS graph_id FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) v FULL JOIN labels g ON v.doc_id = g.doc_id)"""
_ISSUES = "i AS (SELECT entity_id, 'missing_vector' AS issue, 'medium' AS severity FROM m WHERE vector_id IS NULL UNION ALL SELECT entity_id, 'missing_graph', 'medium' FROM m WHERE graph_id IS NULL)"
SQL = {
    "sync_status": f"WITH {_MAP} SELECT CASE WHEN vector_id IS NOT NULL AND graph_id IS NOT NULL THEN 'synced' WHEN vector_id IS NOT NULL THEN 'vector_only' WHEN graph_id IS NOT NULL THEN 'graph_only' ELSE 'conflict' END AS sync_status, count(*)::BIGINT AS n FROM m GROUP BY 1",
    "consistency_issues": f"WITH {_MAP}, {_ISSUES} SELECT * FROM i UNION ALL SELECT entity_id, 'data_mismatch', 'high' FROM m WHERE vector_id IS NOT NULL AND graph_id % 70 = 0",
    "issue_rates": f"WITH {_MAP}, {_ISSUES} SELECT issue, severity, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE entity_id % 3 = 0) * 100.0::DOUBLE / count(*), 6) AS resolved_pct FROM i GROUP BY ALL",
    "repaired_store": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE upper(lang) END AS lang FROM documents",
    "upsert_split": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'update' ELSE 'create' END AS action FROM part WHERE p_partkey % 2 = 0",
    "upsert": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0",
    "delete_rows": "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 <> 0",
    "changed_rows": "SELECT doc_id AS path FROM documents WHERE doc_id % 4 = 0 AND text <> ''",
    "symbol_hits": """WITH h AS (SELECT DISTINCT s_suppkey % 40 AS file_path, s_suppkey % 7 AS start_line FROM supplier), s AS (SELECT p_partkey % 40 AS file_path, (p_size % 9)::BIGINT AS start_line, p_partkey AS symbol FROM part),
n AS (SELECT file_path, start_line, count(*) AS n FROM s GROUP BY ALL)
SELECT h.file_path, h.start_line, NULL::BIGINT AS symbol, round(CASE WHEN n IS NULL THEN 0.6 ELSE least(1.0, 0.6 + 0.1 * n) END, 6)::DOUBLE AS score FROM h LEFT JOIN n USING (file_path, start_line)
UNION ALL SELECT file_path, start_line, symbol, 0.4 FROM s WHERE (file_path, start_line) NOT IN (SELECT (file_path, start_line) FROM h)""",
    "adaptive_weights": """WITH f AS (SELECT user_id % 6 AS key, event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS r, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) - 1 AS n FROM events), b AS (SELECT key, n // 10 AS b, avg(r) AS m, count(*) AS c FROM f GROUP BY ALL),
l AS (SELECT key, list(CASE WHEN m >= 0.7 THEN 0.05 WHEN m <= 0.3 THEN -0.1 ELSE 0 END::DOUBLE ORDER BY b) AS rs FROM b WHERE c = 10 GROUP BY key)
SELECT key, round(list_reduce(list_concat([0.5::DOUBLE], rs), lambda w, r: greatest(0.0::DOUBLE, least(1.0::DOUBLE, w * (1 + r)))), 6) AS weight, round(list_reduce(list_concat([0.5::DOUBLE], rs), lambda c, r: least(1.0::DOUBLE, c + 0.1::DOUBLE * abs(r))), 6) AS confidence, len(rs)::BIGINT AS batches FROM l""",
}
