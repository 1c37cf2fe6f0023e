"""Vector search: exact nearest rows, dimension adaptation, and a hashing embedder."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import METRICS

#: Smaller is nearer for these.
DISTANCES = ("euclid", "manhattan")


def payload_filter(**wanted) -> Column:
    """Conjunction over columns: a list asks for one of its values, a scalar for equality, None for nothing."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)), "contains": lambda c, v: F.contains(c, F.lit(v)),
}


def field_filter(conditions: list[tuple[str, str, object]]) -> Column:
    """Conjunction of (field, operator, value)."""
    return reduce(lambda a, b: a & b, [OPERATORS[op](F.col(field), v) for field, op, v in conditions], F.lit(True))


def knn(rows: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, threshold: float | None = None, exclude: list | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector. Filters stand below the ranking; the ranking is one bounded heap a partition."""
    if where is not None:
        rows = rows.where(where)
    if exclude:
        rows = rows.where(~F.col(key).isin(exclude))
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", METRICS[metric](F.col(vector), literal))
    near = metric in DISTANCES
    if threshold is not None:
        scored = scored.where(F.col("score") <= threshold if near else F.col("score") >= threshold)
    return scored.orderBy(F.col("score").asc() if near else F.col("score").desc(), key).limit(k)


def knn_of_row(rows: DataFrame, row_id, **options) -> DataFrame:
    """As ``knn``, for the vector of a row, which is one row read by its id."""
    key, vector = options.get("key", "vec_id"), options.get("vector", "embedding")
    found = rows.where(F.col(key) == row_id).select(vector).first()
    if found is None:
        return rows.withColumn("score", F.lit(None).cast("double")).limit(0)
    return knn(rows, list(found[0]), **options)


#: Rows, or queries, that a task compares at a time.
BLOCK = 4096


def _best_of(k: int):
    """Of a block of rows and a block of unit query vectors, each query's k most similar rows."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def units(table: pa.Table) -> np.ndarray:
        x = np.array(table.column("v").to_pylist(), np.float64).reshape(len(table), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def best(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_ids": [], "scores": []}
        if len(rows) and len(queries):
            rows = rows.sort_by("vec_id")
            ids, x, asked = rows.column("vec_id").to_numpy(), units(rows), queries.column("query_id").to_numpy()
            for q, s in zip(asked, np.round(units(queries) @ x.T, 12), strict=True):
                order = np.argsort(-s, kind="stable")[: k + 1]
                order = order[ids[order] != q][:k]
                found["query_id"].append(q)
                found["vec_ids"].append(ids[order])
                found["scores"].append(s[order])
        return pa.table(found, schema)

    return best


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine neighbours of each row of ``queries`` among ``rows``, whose ids are unique.

    Queries against rows in blocks of about BLOCK: every block of queries meets every block of rows as one product of
    matrices, a block returns each query's best k, and the blocks' best are merged; no pair leaves its task.
    """
    n_rows, n_queries = (max(1, -(-df.count() // BLOCK)) for df in (rows, queries))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), deal(n_rows).alias("i"), every(n_queries).alias("j"))
    q = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"), every(n_rows).alias("i"), deal(n_queries).alias("j"))
    found = r.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInArrow(_best_of(k), "query_id long, vec_ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.transform(F.arrays_zip("scores", "vec_ids"), lambda p: F.struct((-p["scores"]).alias("s"), p["vec_ids"].alias("i"))).alias("best"))
    merged = pairs.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    got = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return got.select("query_id", F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"), (F.col("at") + 1).cast("int").alias("rank"))


# ---- dimensions

def stride(v: Column, to: int, n: int) -> Column:
    """Every floor(n / to)-th component."""
    step = max(1, n // to)
    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), lambda i: F.get(v, i * step))


def interpolate(v: Column, to: int, n: int) -> Column:
    """Linear interpolation between the neighbours of each new place."""
    scale = (n - 1) / (to - 1) if to > 1 else 0.0

    def at(i: Column) -> Column:
        x = i * F.lit(scale)
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, F.lit(n - 1))
        return F.get(v, lo) * (1 - (x - lo)) + F.get(v, hi) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)


def truncate(v: Column, to: int, n: int) -> Column:
    return F.slice(v, 1, to)


def zero_pad(v: Column, to: int, n: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), max(0, to - n)))


def average_pool(v: Column, to: int, n: int) -> Column:
    size = max(1, n // to)
    mean = lambda i: F.aggregate(F.slice(v, i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x) / size
    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), mean)


ADAPTERS = {"stride": stride, "interpolation": interpolate, "truncation": truncate, "padding": zero_pad, "pooling": average_pool}
#: The dimension that suits a kind of content.
DIMENSIONS = {"code": 768, "documentation": 1536, "comment": 512, "string": 384, "identifier": 256}


#: Quality and performance of each way.
GRADES = {"stride": (0.89, 0.75), "interpolation": (0.85, 0.88), "truncation": (0.82, 0.95), "padding": (0.78, 0.98), "pooling": (0.86, 0.82)}


def best_adapter(quality: float = 0.7, performance: float = 0.3) -> str:
    """The way of the best weighted grade, of equal ones the first; grades are compared to nine places."""
    return max(GRADES, key=lambda k: round(GRADES[k][0] * quality + GRADES[k][1] * performance, 9))


def adapt(v: Column, to: int, n: int, how: str | None = None) -> Column:
    """A vector of n components in ``to`` components, by the best way if none is named."""
    return ADAPTERS[how or best_adapter()](v.cast("array<double>"), to, n)


def dimensions_for(kind: Column) -> Column:
    """The dimension that suits a kind of content; of others that of code."""
    table = F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DIMENSIONS["code"]))


#: Words that a concept stands for.
CONCEPTS = {
    "authentication": ("login", "security", "authorization", "user", "password"),
    "database": ("sql", "query", "table", "schema", "connection"),
    "api": ("endpoint", "request", "response", "http", "service"),
    "ui": ("interface", "component", "view", "render", "element"),
}


def expanded(concept: Column, context: Column | None = None) -> Column:
    """The words of a concept, or the concept itself, then the context."""
    table = F.create_map(*[x for k, v in CONCEPTS.items() for x in (F.lit(k), F.lit(" ".join(v)))])
    words = F.coalesce(F.try_element_at(table, F.lower(concept)), concept)
    return words if context is None else F.concat_ws(" ", words, context)


def snippets(rows: DataFrame, query: list[float], kind: str | None = None, k: int = 10, **options) -> DataFrame:
    """``knn`` among the rows whose chunk_type is snippet, of one snippet_type if named."""
    return knn(rows, query, k, where=payload_filter(chunk_type="snippet", snippet_type=kind), **options)


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: signed token hashes, summed and scaled to length 1; zeros for no tokens, and for null."""
    tokens = F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")

    def summed(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.zeros(0, np.int64) if h is None else np.asarray(h, np.int64)  # noqa: PLW2901
            raw = np.bincount(h % dim, weights=np.where(h < 0, -1.0, 1.0), minlength=dim)
            length = np.sqrt((raw * raw).sum())
            out.append(raw / length if length > 0 else raw)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(summed, "array<double>")(F.transform(tokens, lambda t: F.xxhash64(t)))
