"""Queries over ``events``: statistics, trends, windows, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.common import r6, table
from tessera.streaming import changes as C

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
SECONDS = 15 * 86400.0


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _rounded(df, *names):
    return df.select(*[r6(c).alias(c) if c in names or (not names and t == "double") else F.col(c) for c, t in df.dtypes])


def _stats(spark, d):
    return _rounded(M.query_stats(M.within(_events(spark, d), START, END), SECONDS, (), "value", F.col("event_type") == "view", F.col("event_type") == "error"))


def _stats_by_type(spark, d):
    return _rounded(M.query_stats(_events(spark, d), 30 * 86400.0, ("event_type",), "value"))


def _top(spark, d):
    named = _events(spark, d).withColumn("name", F.concat(F.lit("query_"), F.col("event_id").cast("string"), F.lit("_user "), F.col("user_id").cast("string")))
    return _rounded(M.top_queries(named, "name"))


def _trend(spark, d):
    return _rounded(M.trend(_events(spark, d), "user_id", ("ts", "event_id")))


def _health(spark, d):
    return _rounded(M.health(_events(spark, d), "value"))


def _batches(spark, d):
    rows = _events(spark, d).select("event_type", F.abs("value").alias("seconds"), (F.col("event_id") % 100 + 1).alias("processed"), (F.col("event_id") % 7).alias("failed"), (F.col("event_id") % 13).cast("double").alias("memory_delta"))
    return _rounded(M.batch_stats(rows, ("event_type",)))


def _last(spark, d):
    return M.last_rows(_events(spark, d), 3, ("ts", "event_id"), ("user_id",)).select("user_id", "event_id")


def _newest(spark, d):
    return M.last_rows(_events(spark, d), 50, ("ts", "event_id")).select("event_id", "event_type")


def _moving(spark, d):
    return M.moving_average(_events(spark, d), "user_id", ("ts", "event_id"), "value").select("event_id", r6("moving_avg").alias("moving_avg"))


def _ema(spark, d):
    return _rounded(M.exponential_average(_events(spark, d), "user_id", ("ts", "event_id"), "value", 0.3))


def _failures(spark, d):
    return M.failure_counter(_events(spark, d), "user_id", ("ts", "event_id"), F.col("event_type").isin("error", "click"))


def _ab(spark, d):
    rows = _events(spark, d).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    return _rounded(M.ab_test(rows, "variant", F.col("event_type") == "click"))


RULES = [("slow", "p95_time", 50.0, "warning"), ("very slow", "p99_time", 90.0, "critical"), ("busy", "throughput", 0.0001, "info")]


def _alerts(spark, d):
    return _rounded(M.alerts(M.query_stats(_events(spark, d), 30 * 86400.0, ("event_type",), "value"), RULES).select("event_type", "alert", "severity", "value", "limit"))


def _change(spark, d):
    e = _events(spark, d)
    agg = lambda x: x.groupBy("event_type").agg(F.avg("value").alias("latency"), F.count("*").cast("double").alias("volume"))
    return _rounded(M.change(agg(e.where("ts < '2024-01-15'")), agg(e.where("ts >= '2024-01-15'")), "event_type", "latency", "volume"))


def _capacity(spark, d):
    use = _events(spark, d).groupBy(F.when(F.col("user_id") % 3 == 0, "cpu").when(F.col("user_id") % 3 == 1, "memory").otherwise("storage").alias("resource")).agg(F.avg("value").alias("used"))
    return _rounded(M.capacity(use))


def _retention(spark, d):
    return M.since(_events(spark, d), "2024-01-30 00:00:00", 7).groupBy("event_type").agg(F.count("*").alias("n"))


def _real_time(spark, d):
    return _rounded(C.windowed(_events(spark, d), "5 minutes", None, None, ("event_type",)).select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total"))


def _sliding(spark, d):
    return _rounded(C.windowed(_events(spark, d), "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "n", "total"))


def _paths(spark, d):
    return _events(spark, d).select(F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"), "ts", "event_id", "event_type", F.abs("value").alias("size"))


def _debounce(spark, d):
    got = C.debounce(_paths(spark, d).drop("size", "event_type"), "6 hours")
    return got.select("path", F.unix_timestamp("ts").alias("ts"), "event_id", "n_events")


def _observations(spark, d):
    h = F.when(F.col("event_type") == "error", None).otherwise((F.col("event_id") % 3).cast("string"))
    one = _paths(spark, d).groupBy("path", "ts").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    return one.select("path", "ts", h.alias("hash"))


def _classify(spark, d):
    return C.classify(_observations(spark, d)).select("path", F.unix_timestamp("ts").alias("ts"), "kind", "previous", "current")


def _priority(spark, d):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "created").otherwise("modified")
    rows = _paths(spark, d).select("event_id", C.priority(kind, F.col("size") * 10, F.when(F.col("event_id") % 2 == 0, "python").otherwise("text")).alias("priority"))
    return C.batches(rows, 50, "priority", "event_id").select("event_id", "priority", F.col("batch").cast("long").alias("batch"))


def _history(spark, d):
    return C.history(_events(spark, d).select(F.col("event_type").alias("path"), F.struct("ts", "event_id").alias("ts")), 5).select("path", F.col("ts.event_id").alias("event_id"))


def _props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


def _exposition(spark, d):
    g = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("value")).select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "value")
    return M.exposition(g)


def _costs(spark, d):
    e = _events(spark, d)
    return _rounded(e.select("event_id", M.query_cost(F.lit(1), F.abs("value") / 1000, F.when(F.col("event_type") == "error", "graph").when(F.col("event_type") == "view", "semantic").otherwise("keyword"), F.col("event_id") % 2 == 0).alias("cost")))


QUERIES = {
    "query_stats": _stats, "query_stats_by_type": _stats_by_type, "top_queries": _top, "trend_by_user": _trend, "system_health": _health, "batch_stats": _batches,
    "last_n_window": _last, "newest_events": _newest, "moving_average": _moving, "ema_fold": _ema, "failure_counter": _failures, "ab_test_ctr": _ab,
    "alerts_bottlenecks": _alerts, "period_change": _change, "capacity_projection": _capacity, "retention": _retention, "real_time_window": _real_time,
    "sliding_window": _sliding, "session_debounce": _debounce, "change_classify": _classify, "event_priority": _priority, "path_history": _history,
    "json_props": _props, "prometheus_lines": _exposition, "query_cost": _costs,
}

_STATS = """count(*)::BIGINT AS n_queries, round(coalesce(avg(value), 0), 6) AS avg_time, round(coalesce(quantile_disc(value, 0.95), 0), 6) AS p95_time, round(coalesce(quantile_disc(value, 0.99), 0), 6) AS p99_time,
  round({hit}, 6)::DOUBLE AS hit_rate, round(count(*) / {sec}::DOUBLE, 6) AS throughput, round({err}, 6)::DOUBLE AS error_rate"""
_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"
_PATHS = "p AS (SELECT '/f/' || user_id AS path, ts, event_id, event_type, abs(value) AS size FROM events)"
SQL = {
    "query_stats": f"SELECT {_STATS.format(hit='avg((event_type = $$view$$)::INT)', sec=SECONDS, err='avg((event_type = $$error$$)::INT)')} FROM events WHERE ts BETWEEN '{START}' AND '{END}'",
    "query_stats_by_type": f"SELECT event_type, {_STATS.format(hit='0.0', sec=30 * 86400.0, err='0.0')} FROM events GROUP BY event_type",
    "top_queries": "SELECT 'user ' || user_id AS query, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_time FROM events GROUP BY 1 ORDER BY n DESC, query LIMIT 10",
    "trend_by_user": f"""WITH m AS (SELECT *, {_RANK} <= 10 AS recent FROM events), a AS (SELECT user_id, count(*)::BIGINT AS n, avg(value) AS avg_time, min(value) AS min_time, max(value) AS max_time,
  avg(value) FILTER (WHERE recent) AS recent_avg, avg(value) FILTER (WHERE NOT recent) AS older_avg FROM m GROUP BY user_id)
SELECT user_id, n, round(avg_time, 6) AS avg_time, round(min_time, 6) AS min_time, round(max_time, 6) AS max_time, round(recent_avg, 6) AS recent_avg, round(older_avg, 6) AS older_avg,
  CASE WHEN (recent_avg - older_avg) / nullif(older_avg, 0) > 0.1 THEN 'degrading' WHEN (recent_avg - older_avg) / nullif(older_avg, 0) < -0.1 THEN 'improving' ELSE 'stable' END AS trend FROM a""",
    "system_health": "SELECT round(avg(value), 6) AS avg_value, round(max(value), 6) AS peak_value FROM events",
    "batch_stats": """WITH b AS (SELECT event_type, abs(value) AS seconds, event_id % 100 + 1 AS processed, event_id % 7 AS failed, (event_id % 13)::DOUBLE AS memory_delta FROM events)
SELECT event_type, count(*)::BIGINT AS n_batches, round(avg(seconds), 6) AS avg_seconds, round(quantile_disc(seconds, 0.95), 6) AS p95_seconds, round(quantile_disc(seconds, 0.99), 6) AS p99_seconds,
  round(avg(processed / nullif(seconds, 0)) FILTER (WHERE processed / nullif(seconds, 0) > 0), 6) AS avg_throughput, round(avg(failed / nullif(processed, 0)::DOUBLE), 6) AS avg_error_rate, round(sum(processed)::DOUBLE / sum(memory_delta) * 1000, 6) AS memory_efficiency FROM b GROUP BY event_type""",
    "last_n_window": f"SELECT user_id, event_id FROM (SELECT *, {_RANK} AS r FROM events) WHERE r <= 3",
    "newest_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events",
    "ema_fold": "WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS vs FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(vs, lambda s, x: 0.3::DOUBLE * x + 0.7::DOUBLE * s), 6) AS ema FROM v",
    "failure_counter": """WITH v AS (SELECT user_id, list(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE -1 END ORDER BY ts, event_id) AS vs FROM events GROUP BY user_id)
SELECT user_id, list_reduce(list_concat([0], vs), lambda s, x: greatest(0, s + x))::BIGINT AS failures FROM v""",
    "ab_test_ctr": """WITH a AS (SELECT count(*) FILTER (WHERE user_id % 2 = 0)::BIGINT AS "n_A", count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'click')::BIGINT AS "clicks_A", count(*) FILTER (WHERE user_id % 2 = 1)::BIGINT AS "n_B", count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'click')::BIGINT AS "clicks_B" FROM events)
SELECT *, round("clicks_A" / "n_A"::DOUBLE, 6) AS "ctr_A", round("clicks_B" / "n_B"::DOUBLE, 6) AS "ctr_B", CASE WHEN "n_A" > 100 AND "n_B" > 100 THEN CASE WHEN "clicks_A" / "n_A"::DOUBLE > "clicks_B" / "n_B"::DOUBLE THEN 'A' ELSE 'B' END END AS winner FROM a""",
    "alerts_bottlenecks": """WITH s AS (SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) / 2592000.0::DOUBLE AS rate FROM events GROUP BY event_type), a AS (
  SELECT event_type, 'slow' AS alert, 'warning' AS severity, p95 AS value, 50.0::DOUBLE AS "limit" FROM s UNION ALL SELECT event_type, 'very slow', 'critical', p99, 90.0 FROM s UNION ALL SELECT event_type, 'busy', 'info', rate, 0.0001 FROM s)
SELECT event_type, alert, severity, round(value, 6) AS value, round("limit", 6) AS "limit" FROM a WHERE a.value > a."limit" """,
    "period_change": """WITH b AS (SELECT event_type, avg(value) AS l, count(*)::DOUBLE AS v FROM events WHERE ts < '2024-01-15' GROUP BY 1), n AS (SELECT event_type, avg(value) AS l, count(*)::DOUBLE AS v FROM events WHERE ts >= '2024-01-15' GROUP BY 1)
SELECT event_type, round((n.l - b.l) * 100.0 / b.l, 6) AS latency_change, round((n.v - b.v) * 100.0 / b.v, 6) AS volume_change FROM b FULL JOIN n USING (event_type)""",
    "capacity_projection": """WITH u AS (SELECT CASE user_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' ELSE 'storage' END AS resource, avg(value) AS used FROM events GROUP BY 1)
SELECT resource, round(used, 6) AS used, round(used * CASE WHEN resource = 'storage' THEN 1.5 ELSE 1.3 END, 6)::DOUBLE AS projected, used * CASE WHEN resource = 'storage' THEN 1.5 ELSE 1.3 END > 80 AS scale_up FROM u""",
    "retention": "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1",
    "real_time_window": "SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "sliding_window": """WITH w AS (SELECT unnest([epoch(date_trunc('hour', ts))::BIGINT, epoch(date_trunc('hour', ts))::BIGINT - 3600]) AS start, value FROM events) SELECT start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM w GROUP BY start""",
    "session_debounce": f"""WITH {_PATHS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY path ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS burst FROM g)
SELECT path, floor(epoch(max(ts)))::BIGINT AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*)::BIGINT AS n_events FROM s GROUP BY path, burst""",
    "change_classify": f"""WITH {_PATHS}, o AS (SELECT path, ts, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM p GROUP BY ALL),
h AS (SELECT path, ts, CASE WHEN event_type = 'error' THEN NULL ELSE (event_id % 3)::VARCHAR END AS hash FROM o), l AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts) AS previous FROM h),
k AS (SELECT *, CASE WHEN previous IS NULL AND hash IS NOT NULL THEN 'created' WHEN hash IS NULL AND previous IS NOT NULL THEN 'deleted' WHEN hash <> previous THEN 'modified' END AS kind FROM l)
SELECT path, floor(epoch(ts))::BIGINT AS ts, kind, previous, hash AS current FROM k WHERE kind IS NOT NULL""",
    "event_priority": f"""WITH {_PATHS}, k AS (SELECT event_id, greatest(0, least(4, CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 1 ELSE 2 END + CASE WHEN size * 10 < 1024 THEN 1 WHEN size * 10 > 1048576 THEN -1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END))::INT AS priority FROM p)
SELECT event_id, priority, ((row_number() OVER (ORDER BY priority DESC, event_id) - 1) // 50)::BIGINT AS batch FROM k""",
    "path_history": "SELECT event_type AS path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5",
    "json_props": "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "prometheus_lines": """SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "query_cost": "SELECT event_id, round((100 + 200 * (abs(value) / 1000) + CASE event_type WHEN 'error' THEN 200 WHEN 'view' THEN 150 ELSE 100 END) * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 1.5 END, 6)::DOUBLE AS cost FROM events",
}
