"""Two stores of one entity set: status, issues, repair, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mapping(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """(entity_id, vector_id, graph_id, sync_status) of two tables (entity_id, id)."""
    v = vectors.select("entity_id", F.col("id").alias("vector_id"))
    g = graph.select("entity_id", F.col("id").alias("graph_id"))
    return v.join(g, "entity_id", "full_outer").withColumn("sync_status", status(F.col("vector_id"), F.col("graph_id")))


def status(vector_id: Column, graph_id: Column) -> Column:
    v, g = vector_id.isNotNull(), graph_id.isNotNull()
    return F.when(v & g, "synced").when(v, "vector_only").when(g, "graph_only").otherwise("conflict")


def issues(mappings: DataFrame, mismatch: Column | None = None) -> DataFrame:
    """(entity_id, issue, severity): a missing vector, a missing node, data that differ."""
    issue = lambda test, name, severity: F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    both = F.col("vector_id").isNotNull() & F.col("graph_id").isNotNull()
    found = [issue(F.col("vector_id").isNull(), "missing_vector", "medium"), issue(F.col("graph_id").isNull(), "missing_graph", "medium")]
    found.append(issue(both & (mismatch if mismatch is not None else F.lit(False)), "data_mismatch", "high"))
    return mappings.select("entity_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("entity_id", "x.*")


def repaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the rows that only ``right`` has."""
    return left.unionByName(right.join(left.select(key), key, "left_anti").select(*left.columns))


def split(incoming: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to update, rows to create)."""
    known = existing.select(key)
    return incoming.join(known, key, "left_semi"), incoming.join(known, key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Last write wins: of several incoming rows of a key the one of largest ``order``."""
    if order:
        incoming = incoming.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key), key, "left_anti")


def changed(now: DataFrame, before: DataFrame, path: str, digest: str) -> DataFrame:
    """Rows whose (path, digest) was not there before."""
    return now.join(before.select(path, digest), [path, digest], "left_anti")


def rates(found: DataFrame, resolved: Column) -> DataFrame:
    """Issues by kind and severity, with the share resolved in percent."""
    share = F.count_if(resolved) * 100.0 / F.count("*")
    return found.groupBy("issue", "severity").agg(F.count("*").alias("n"), share.alias("resolved_pct"))


def open_issues(found: DataFrame, project: str | None = None, severity: str | None = None) -> DataFrame:
    """Issues (project, severity, detected_at, ...) of a project and a severity, the newest first."""
    for name, value in (("project", project), ("severity", severity)):
        found = found.where(F.col(name) == value) if value is not None else found
    return found.orderBy(F.desc("detected_at"))


def select(mappings: DataFrame, project=None, kind: str | None = None, unsynced: bool = False) -> DataFrame:
    """Mappings (project, kind, sync_status, ...) of a project, of a kind, and only those that are not in both stores."""
    for name, value in (("project", project), ("kind", kind)):
        mappings = mappings.where(F.col(name) == value) if value is not None else mappings
    return mappings.where("sync_status <> 'synced'") if unsynced else mappings


def repairs(mappings: DataFrame, mismatch: Column | None = None) -> DataFrame:
    """(entity_id, action) for every issue: a missing side is written from the other one, data that differ are written anew from the vector side, an entity on neither side is dropped from the mapping."""
    v, g = F.col("vector_id").isNotNull(), F.col("graph_id").isNotNull()
    differs = mismatch if mismatch is not None else F.lit(False)
    action = F.when(~v & ~g, "drop_mapping").when(~v, "write_vector").when(~g, "write_graph").when(differs, "rewrite_graph")
    return mappings.select("entity_id", action.alias("action")).where("action IS NOT NULL")


def repaired_mapping(mappings: DataFrame) -> DataFrame:
    """The mappings after all repairs: a missing side gets the entity's own id, entities on neither side are gone."""
    left = mappings.where("vector_id IS NOT NULL OR graph_id IS NOT NULL")
    own = lambda c: F.coalesce(F.col(c), F.col("entity_id")).alias(c)
    return left.select("entity_id", own("vector_id"), own("graph_id"), F.lit("synced").alias("sync_status"))


def delete_files(paths: DataFrame, vectors: DataFrame, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both stores without the files (path): their vectors (path, ...), their vertices (id, path, ...) and the edges (src, dst, ...) at either end of these."""
    gone = vertices.join(paths, "path", "left_semi").select("id")
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return vectors.join(paths, "path", "left_anti"), vertices.join(paths, "path", "left_anti"), kept.select(*edges.columns)
