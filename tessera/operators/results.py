"""Result sets: one shape for all searches, order, pages, summaries, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import terms

#: What stands for a missing value in a hit.
DEFAULTS = {"score": 0.5, "file_path": "", "content": "", "start_line": 0, "end_line": 0, "language": "unknown", "chunk_type": "unknown"}


def normal(hits: DataFrame, source: str) -> DataFrame:
    """Hits of any search as rows of one shape. A score, text or line that is missing, empty or 0 gets the default, as does a column that the hits lack."""
    given = lambda c: F.nullif(F.col(c), F.lit(type(DEFAULTS[c])(0))) if c in hits.columns else F.lit(None)
    fields = [F.coalesce(given(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    return hits.select("id", *fields, F.lit(source).alias("source"))


def first_at_place(hits: DataFrame, order: str = "seq", place: tuple[str, ...] = ("file_path", "line", "col")) -> DataFrame:
    """Of hits at one place the first by ``order``; sorted by score, path (by code point), line and column."""
    rest = [c for c in hits.columns if c not in place]
    first = hits.groupBy(*place).agg(F.min_by(F.struct(*rest), F.col(order)).alias("h")).select(*place, *[F.col(f"h.{c}").alias(c) for c in rest])
    return first.orderBy(F.desc("score"), *place)


def relevance(name: Column, description: Column, query: Column) -> Column:
    """3 if the name holds the query, 2 if the description does, else 1."""
    return F.when(F.contains(name, query), 3).when(F.contains(description, query), 2).otherwise(1)


def page(rows: DataFrame, *order, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order, which should be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def suggestions(queries: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, place, suggestion, confidence, category): up to ``most`` a query, by confidence, then as they come up."""
    q, words = F.col(text), F.filter(terms(F.col(text)), lambda t: F.length(t) > 2)
    one = lambda s, c, k: F.struct(F.lit(c).alias("confidence"), (s if isinstance(s, Column) else F.lit(s)).alias("suggestion"), F.lit(k).alias("category"))
    none = F.array().cast("array<struct<confidence:double,suggestion:string,category:string>>")
    says = lambda *w: F.exists(F.array(*[F.lit(x) for x in w]), lambda x: F.contains(q, x))
    patterns = F.when(says("error", "bug"), F.array(one("exception handling", 0.7, "pattern"))).otherwise(none)
    concepts = F.when(says("how", "what"), F.array(one("implementation", 0.6, "concept"))).otherwise(none)
    found = F.slice(F.concat(F.transform(words, lambda t: one(t, 0.8, "term")), patterns, concepts), 1, most)  # falling confidence
    got = queries.select(key, F.posexplode(found).alias("place", "s"))
    return got.select(key, (F.col("place") + 1).cast("long").alias("place"), "s.suggestion", "s.confidence", "s.category")


def summary(hits: DataFrame) -> DataFrame:
    """(n, avg_score, languages): the languages sorted."""
    return hits.agg(F.count("*").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def strategies(runs: DataFrame, name: str = "strategy") -> DataFrame:
    """How often each strategy ran; none given counts as hybrid."""
    return runs.groupBy(F.coalesce(name, F.lit("hybrid")).alias("strategy")).agg(F.count("*").alias("n"))


def batch_totals(runs: DataFrame, seconds: str = "seconds", found: str = "n_results") -> DataFrame:
    """(n_queries, total_seconds, avg_seconds, results_per_second, success_share) of queries that ran as a batch."""
    return runs.agg(
        F.count("*").alias("n_queries"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("avg_seconds"),
        F.try_divide(F.sum(found).cast("double"), F.sum(seconds)).alias("results_per_second"),
        F.avg(F.when(F.col(found) > 0, 1.0).otherwise(0.0)).alias("success_share"),
    )


def recent_success(runs: DataFrame, order: tuple[str, ...], last: int = 100, status: str = "status", seconds: str = "seconds") -> DataFrame:
    """(n, success_pct, avg_seconds) over the last runs."""
    newest = runs.orderBy(*[F.desc(c) for c in order]).limit(last)
    return newest.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col(status) == "completed", 100.0).otherwise(0.0)), F.lit(0.0)).alias("success_pct"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("avg_seconds"))


def queue_status(events: DataFrame, by: str = "priority", seconds: str = "seconds") -> DataFrame:
    """(priority, n, avg_seconds)."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.avg(seconds).alias("avg_seconds"))


def for_a_model(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, summary): each query's hits as one JSON object, for a language model: how many, their mean score, languages and files, and the best by score."""
    hit = F.struct("score", "file_path", "start_line")
    place = F.row_number().over(W.partitionBy(key).orderBy(hit.desc_nulls_last()))
    # Three hits of a query are gathered, however many it has.
    best = F.reverse(F.sort_array(F.collect_list(F.when(F.col("_place") <= 3, hit))))
    per = hits.withColumn("_place", place).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.sort_array(F.collect_set("language")).alias("languages"), best.alias("best"))
    return per.select(key, F.to_json(F.struct("n", "avg_score", "languages", "best")).alias("summary"))
