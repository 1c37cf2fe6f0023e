"""Findings of static analysis: one shape, filters, what stands around them in graph and vectors, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.vector import knn_batch


def normal(raw: DataFrame) -> DataFrame:
    """Raw findings (check_id, path, line, end_line, col, message, severity) as (finding_id, rule, file, line, end_line, col, message, severity); what is missing gets a default."""
    or_else = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("" if isinstance(v, str) else 0)), F.lit(v))
    line = or_else("line", 1)
    name = F.concat_ws("-", or_else("check_id", "unknown-rule"), or_else("path", "unknown"), line.cast("string"))
    return raw.select(
        name.alias("finding_id"), or_else("check_id", "unknown-rule").alias("rule"), or_else("path", "unknown-file").alias("file"),
        line.alias("line"), F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), line).alias("end_line"), or_else("col", 1).alias("col"),
        or_else("message", "No message provided").alias("message"), severity(F.col("severity")).alias("severity"),
    )


def severity(given: Column) -> Column:
    """ERROR, WARNING or INFO in capitals or small letters; all else is INFO."""
    return F.when(given.isin("ERROR", "error"), "ERROR").when(given.isin("WARNING", "warning"), "WARNING").otherwise("INFO")


def select(findings: DataFrame, severity: str | None = None, rule: str | None = None, file: str | None = None) -> DataFrame:
    """The findings of a severity, a rule, a file; what is not named is not asked for."""
    for name, value in (("severity", severity), ("rule", rule), ("file", file)):
        findings = findings.where(F.col(name) == value) if value is not None else findings
    return findings


def risk_factors(findings: DataFrame) -> DataFrame:
    """(critical_issues, diverse_issues, fixable_issues) of findings (severity, rule, fix)."""
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return findings.agg(some(F.col("severity") == "ERROR").alias("critical_issues"), (F.count_distinct("rule") > 5).alias("diverse_issues"), some(F.col("fix").isNotNull()).alias("fixable_issues"))


def context_metrics(findings: DataFrame) -> DataFrame:
    """Of findings (severity, security, control_flow, data_flow, context_score): how many have each context, the mean score, errors and warnings. A missing score counts 0."""
    n = lambda c: F.count_if(F.col(c).isNotNull())
    return findings.agg(
        n("security").alias("security_issues"), n("control_flow").alias("control_flow_issues"), n("data_flow").alias("data_flow_issues"),
        F.coalesce(F.avg(F.coalesce("context_score", F.lit(0.0))), F.lit(0.0)).alias("avg_context_score"),
        F.count_if(F.col("severity") == "ERROR").alias("critical_issues"), F.count_if(F.col("severity") == "WARNING").alias("high_severity_issues"),
    )


def security_summary(issues: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: issues (severity, issue) by severity and in all, distinct kinds, and distinct sources and sinks of tainted flows (source, sink)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    a = issues.agg(*[n(s) for s in ("critical", "high", "medium", "low")], F.count("*").alias("n_issues"), F.count_distinct("issue").alias("n_kinds"))
    b = flows.agg(F.count_distinct("source").alias("taint_sources"), F.count_distinct("sink").alias("taint_sinks"))
    return a.crossJoin(b)  # a row each


def remediation(severity: Column, n_cwe: Column) -> Column:
    """How hard a finding is to mend, and how open to attack."""
    difficulty = F.when(severity == "ERROR", "High").when(severity == "WARNING", "Medium").otherwise("Low")
    return F.struct(difficulty.alias("difficulty"), F.when(n_cwe > 0, "High").otherwise("Medium").alias("exploitability"))


def related_files(findings: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(finding_id, related_file): up to k files, by name, that import, include or depend on a finding's file or the other way."""
    near = edges.where(F.col("type").isin("imports", "depends_on", "includes")).select("src", "dst")
    near = near.union(near.select("dst", "src")).distinct()
    best = near.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("n") <= k)
    return findings.select("finding_id", F.col("file").alias("src")).join(best, "src").select("finding_id", F.col("dst").alias("related_file"))


def call_context(findings: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(finding_id, function, calls, called_by) for the functions (file, name, start_line, end_line) around a finding's line, with distinct callees and callers of the edges (src, dst), sorted."""
    inside = "f.file = g.file AND f.line BETWEEN g.start_line AND g.end_line"
    around = findings.alias("f").join(functions.alias("g"), F.expr(inside)).select("f.finding_id", F.col("g.name").alias("function"))
    names = lambda c: F.sort_array(F.collect_set(c))
    named = around.select("function").distinct()
    out = calls.join(named, F.col("src") == F.col("function"), "left_semi").groupBy(F.col("src").alias("function")).agg(names("dst").alias("calls"))
    into = calls.join(named, F.col("dst") == F.col("function"), "left_semi").groupBy(F.col("dst").alias("function")).agg(names("src").alias("called_by"))
    none = F.array().cast("array<string>")
    got = around.join(out, "function", "left").join(into, "function", "left")
    return got.select("finding_id", "function", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))


def dependencies(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """(finding_id, dependency): what a finding's file imports or depends on."""
    deps = edges.where(F.col("type").isin("imports", "depends_on")).select(F.col("src").alias("file"), F.col("dst").alias("dependency")).distinct()
    return findings.select("finding_id", "file").join(deps, "file").select("finding_id", "dependency")


def similar_code(findings: DataFrame, rows: DataFrame, similar: int = 5, docs: int = 3) -> DataFrame:
    """(finding_id, part, vec_id, score, rank): the nearest chunks, and among them the nearest that are documentation and that are fixes.

    Findings have (finding_id, embedding), rows (vec_id, embedding, kind). All three parts come from searches over
    the rows of their kind, each by blocks.
    """
    asked = findings.select(F.col("finding_id").alias("vec_id"), "embedding")
    parts = (("similar", rows, similar), ("documentation", rows.where("kind = 'documentation'"), docs), ("fix", rows.where("kind = 'fix'"), docs))
    found = [knn_batch(r, asked, k).select(F.col("query_id").alias("finding_id"), F.lit(p).alias("part"), "vec_id", "score", "rank") for p, r, k in parts]
    return found[0].union(found[1]).union(found[2])
