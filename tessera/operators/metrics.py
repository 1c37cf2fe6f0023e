"""Operational metrics over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(value: str, percent: int) -> Column:
    """The value at rank ceil(percent / 100 * n), exactly; partial counts by value are merged, not values."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def within(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows between two times, both included."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def since(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Rows younger than ``days`` at ``as_of``."""
    return df.where(F.col(ts) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def query_stats(df: DataFrame, seconds: float, by: tuple[str, ...] = (), value: str = "value", hit: Column | None = None, empty: Column | None = None) -> DataFrame:
    """Count, mean, p95, p99, hit rate, throughput and error rate; zeros over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        zero(F.avg(value)).alias("avg_time"),
        zero(nearest_rank(value, 95)).alias("p95_time"),
        zero(nearest_rank(value, 99)).alias("p99_time"),
        zero(share(hit) if hit is not None else F.lit(0.0)).alias("hit_rate"),
        (F.count("*") / seconds).alias("throughput"),
        zero(share(empty) if empty is not None else F.lit(0.0)).alias("error_rate"),
    )


def top_queries(df: DataFrame, name: str, value: str = "value", k: int = 10) -> DataFrame:
    """The k most frequent names, without a leading ``query_<digits>_`` and cut to 50 characters."""
    bare = F.substring(F.regexp_replace(F.col(name), r"^query_\d+_", ""), 1, 50)
    return df.groupBy(bare.alias("query")).agg(F.count("*").alias("n"), F.avg(value).alias("avg_time")).orderBy(F.desc("n"), "query").limit(k)


def trend(df: DataFrame, by: str, order: tuple[str, ...], value: str = "value", last: int = 10) -> DataFrame:
    """(by, n, avg, min, max, recent, older, trend): the mean of the last ten against that of the rest, by more than a tenth."""
    recent = F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order])) <= last
    marked = df.select(by, value, recent.alias("recent"))
    got = marked.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(value).alias("avg_time"), F.min(value).alias("min_time"), F.max(value).alias("max_time"),
        F.avg(F.when(F.col("recent"), F.col(value))).alias("recent_avg"), F.avg(F.when(~F.col("recent"), F.col(value))).alias("older_avg"),
    )
    change = (F.col("recent_avg") - F.col("older_avg")) / F.nullif(F.col("older_avg"), F.lit(0.0))
    return got.withColumn("trend", F.when(change > 0.1, "degrading").when(change < -0.1, "improving").otherwise("stable"))


def health(df: DataFrame, *values: str) -> DataFrame:
    return df.agg(*[x for v in values for x in (F.avg(v).alias(f"avg_{v}"), F.max(v).alias(f"peak_{v}"))])


def batch_stats(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of batches (seconds, processed, failed, memory_delta): means, percentiles, positive throughput, items per memory."""
    rate = F.try_divide(F.col("processed"), F.col("seconds"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_batches"),
        F.avg("seconds").alias("avg_seconds"),
        nearest_rank("seconds", 95).alias("p95_seconds"),
        nearest_rank("seconds", 99).alias("p99_seconds"),
        F.avg(F.when(rate > 0, rate)).alias("avg_throughput"),
        F.avg(F.try_divide(F.col("failed"), F.col("processed"))).alias("avg_error_rate"),
        (F.try_divide(F.sum("processed").cast("double"), F.sum("memory_delta")) * 1000).alias("memory_efficiency"),
    )


def adaptive_batching(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of size changes (old_size, new_size, old_rate, new_rate): how many, the mean new size, the sum of changes, and the share after which the rate rose."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_changes"),
        F.avg("new_size").alias("avg_size"),
        F.sum(F.abs(F.col("new_size") - F.col("old_size"))).alias("total_change"),
        F.avg(F.when(F.col("new_rate") > F.col("old_rate"), 1.0).otherwise(0.0)).alias("improved_share"),
    )


def last_rows(df: DataFrame, n: int, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows, of each key if keys are given."""
    newest = [F.desc(c) for c in order]
    if not by:
        return df.orderBy(*newest).limit(n)
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*newest))).where(F.col("_rank") <= n).drop("_rank")


def moving_average(df: DataFrame, by: str, order: tuple[str, ...], value: str, rows: int = 10) -> DataFrame:
    return df.withColumn("moving_avg", F.avg(value).over(W.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)))


def _folded(df: DataFrame, by: str, order: tuple[str, ...], value: Column) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return df.groupBy(by).agg(F.transform(ordered, lambda x: x["_v"]).alias("_vs"))


def exponential_average(df: DataFrame, by: str, order: tuple[str, ...], value: str, alpha: float = 0.1) -> DataFrame:
    """alpha * new + (1 - alpha) * current in order, from the first value on. One key's values are one row."""
    folded = _folded(df, by, order, F.col(value).cast("double"))
    rest = F.slice("_vs", 2, F.greatest(F.size("_vs") - 1, F.lit(0)))
    return folded.select(by, F.aggregate(rest, F.element_at("_vs", 1), lambda s, x: alpha * x + (1 - alpha) * s).alias("ema"))


def failure_counter(df: DataFrame, by: str, order: tuple[str, ...], failed: Column) -> DataFrame:
    """One up on failure, one down on success, never under zero; its end, by running sums instead of a fold.

    The counter is the sum of all steps less the least running sum below zero.
    """
    step = F.when(failed, 1).otherwise(-1)
    run = F.sum(step).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    got = df.withColumn("_step", step).withColumn("_run", run).groupBy(by).agg(F.sum("_step").alias("total"), F.min("_run").alias("least"))
    return got.select(by, (F.col("total") - F.least(F.col("least"), F.lit(0))).cast("long").alias("failures"))


def ab_test(df: DataFrame, variant: str, clicked: Column, least: int = 100) -> DataFrame:
    """Impressions, clicks and rate of variants A and B; a winner only if both have more than ``least``; a tie is B's."""
    per = lambda v: [F.count_if(F.col(variant) == v).alias(f"n_{v}"), F.count_if((F.col(variant) == v) & clicked).alias(f"clicks_{v}")]
    got = df.agg(*per("A"), *per("B"))
    rate = lambda v: F.when(F.col(f"n_{v}") > 0, F.col(f"clicks_{v}") / F.col(f"n_{v}")).otherwise(0.0)
    enough = (F.col("n_A") > least) & (F.col("n_B") > least)
    return got.withColumn("ctr_A", rate("A")).withColumn("ctr_B", rate("B")).withColumn("winner", F.when(enough & (rate("A") > rate("B")), "A").when(enough, "B"))


def alerts(stats: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """``stats`` times the rules (name, column, limit, severity) that it breaks: one row an alert."""
    found = F.array(*[F.when(F.col(c) > limit, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.col(c).cast("double").alias("value"), F.lit(float(limit)).alias("limit"))) for name, c, limit, severity in rules])
    return stats.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(*stats.columns, "a.*")


def recommendations(stats: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """``stats`` times the rules (name, test, advice) that hold: one row an advice."""
    found = F.array(*[F.when(test, F.struct(F.lit(name).alias("reason"), F.lit(advice).alias("advice"))) for name, test, advice in rules])
    return stats.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(*stats.columns, "a.*")


def change(before: DataFrame, now: DataFrame, by: str, *values: str) -> DataFrame:
    """Percent change of each value between two aggregates by key."""
    pct = lambda v: F.try_divide((F.col(f"n.{v}") - F.col(f"b.{v}")) * 100.0, F.col(f"b.{v}")).alias(f"{v}_change")
    return before.alias("b").join(now.alias("n"), by, "full_outer").select(by, *[pct(v) for v in values])


def capacity(usage: DataFrame, growth: dict[str, float] | None = None, limit: float = 80.0) -> DataFrame:
    """Each gauge's projection (1.3 times, storage 1.5 times) and whether it passes the limit."""
    growth = growth or {"cpu": 1.3, "memory": 1.3, "storage": 1.5, "network": 1.3}
    table = F.create_map(*[F.lit(x) for kv in growth.items() for x in kv])
    projected = F.col("used") * F.coalesce(F.try_element_at(table, F.col("resource")), F.lit(1.3))
    return usage.withColumn("projected", projected).withColumn("scale_up", F.col("projected") > limit)


def exposition(gauges: DataFrame) -> DataFrame:
    """Rows (name, labels map, value) as lines of the Prometheus text format."""
    label = lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), label), ",")
    return gauges.select(F.concat("name", F.when(labels == "", "").otherwise(F.concat(F.lit("{"), labels, F.lit("}"))), F.lit(" "), F.col("value").cast("string")).alias("line"))


def batch_size(base: int, free_share: Column, least: int = 10, most: int = 500) -> Column:
    """A batch size that follows free memory."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(base * free_share)))


def query_cost(n_words: Column, complexity: Column, strategy: Column, parallel: Column) -> Column:
    """100 and 200 a point of complexity, and what the strategy costs; half as much again if not parallel."""
    step = F.when(strategy == "semantic", 150).when(strategy == "graph", 200).otherwise(100)
    return (100 + 200 * complexity + step) * F.when(parallel, 1.0).otherwise(1.5)


def any_true(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
