"""Security patterns over source lines, and summaries of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.graph import closure
from tessera.operators.rules import required

#: Issue, severity and patterns, in any case.
PATTERNS = (
    ("sql_injection", "high", (r"SELECT.*FROM.*WHERE.*\+", r"INSERT.*INTO.*VALUES.*\+", r"UPDATE.*SET.*WHERE.*\+", r"DELETE.*FROM.*WHERE.*\+", r"query\s*\([^)]*\+", r"execute\s*\([^)]*\+")),
    ("xss", "high", (r"innerHTML\s*=\s*[^;]+", r"outerHTML\s*=\s*[^;]+", r"document\.write\s*\([^)]+\)", r"eval\s*\([^)]+\)", r"setTimeout\s*\([^)]+\)", r"setInterval\s*\([^)]+\)")),
    ("command_injection", "critical", (r"exec\s*\([^)]*\+", r"spawn\s*\([^)]*\+", r"system\s*\([^)]*\+", r"shell\s*\([^)]*\+", r"cmd\s*\([^)]*\+")),
    ("path_traversal", "high", (r"readFile\s*\([^)]*\+", r"writeFile\s*\([^)]*\+", r"open\s*\([^)]*\+", r"fs\.readFile\s*\([^)]*\+", r"fs\.writeFile\s*\([^)]*\+", r"\.\./")),
    ("xxe", "high", (r"<!ENTITY", r"SYSTEM\s*[\"']", r"PUBLIC\s*[\"']", r"DOCTYPE", r"xml\s+version")),
    ("ssrf", "high", (r"http://.*localhost", r"http://.*127\.0\.0\.1", r"http://.*0\.0\.0\.0", r"file://", r"ftp://")),
)
SOURCES = ("req.body", "req.params", "req.query", "request.body", "input", "user_input", "form_data", "post_data")
SINKS = ("query", "execute", "exec", "innerHTML", "document.write", "eval", "Function", "setTimeout", "setInterval")
SECRETS = ("password", "secret", "key", "token", "credential")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).select(key, (F.col("n") + 1).cast("long").alias("line_no"), "line")


def scan(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, issue, severity, pattern, line_no, start_col, end_col): each pattern's first match in each line.

    All patterns are tested on a line in one pass; no table of rules is joined. Only lines that hold a text which some
    pattern requires are tested.
    """
    needs = {required(p) for _, _, patterns in PATTERNS for p in patterns}
    lines = lines_of(docs, key, text)
    if all(needs):
        shortest = sorted(n for n in needs if not any(m in n for m in needs - {n}))
        lines = lines.where(F.exists(F.array(F.lower("line")), lambda small: X.contains_any(small, shortest)))
    tests, n = [], 0
    for issue, severity, patterns in PATTERNS:
        for p in patterns:
            p = f"(?i){p}"
            hit = F.regexp_extract(F.col("line"), f"({p})", 1)
            at = F.regexp_instr(F.col("line"), F.lit(p))
            tests.append(F.when(F.col("line").rlike(p), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(n).alias("pattern"), at.alias("start_col"), (at + F.length(hit)).alias("end_col"))))
            n += 1
    found = lines.select(key, "line_no", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x"))
    return found.select(key, "x.issue", "x.severity", "x.pattern", "line_no", F.col("x.start_col").cast("long").alias("start_col"), F.col("x.end_col").cast("long").alias("end_col"))


def flows(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, source, sink) for each tainted source and sink that a text names both."""
    given = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(text), w))
    both = docs.select(key, given(SOURCES).alias("sources"), given(SINKS).alias("sinks"))
    return both.select(key, F.explode("sources").alias("source"), "sinks").select(key, "source", F.explode("sinks").alias("sink"))


def secrets(docs: DataFrame, key: str = "page_id", text: str = "html", most_lines: int | None = None) -> DataFrame:
    """(key, name, line_no): lines that name something secret; with ``most_lines``, texts of more lines are left out."""
    if most_lines is not None:
        docs = docs.where(F.size(F.split(text, "\n")) <= most_lines)
    names = F.filter(F.array(*[F.lit(s) for s in SECRETS]), lambda s: F.contains(F.lower("line"), s))
    return lines_of(docs, key, text).select(key, "line_no", F.explode(names).alias("name"))


def missing_check(condition: Column) -> Column:
    return ~condition.rlike("(?i)validate|sanitize|escape|encode|filter")


def tainted(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """Variables that taint reaches along def-use edges (src, dst) from those of ``uses`` (id, code) that read a source."""
    dirty = uses.where(F.exists(F.array(*[F.lit(s) for s in SOURCES]), lambda s: F.contains(F.col("code"), s))).select("id")
    return closure(dirty, edges).select("id")


# ---- findings

def by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, k: int = 5) -> DataFrame:
    return by(findings, "rule").orderBy(F.desc("n"), "rule").limit(k)


def high_risk_files(findings: DataFrame, least: int = 3) -> DataFrame:
    return findings.groupBy("file").agg(F.count_if(F.col("severity") == "ERROR").alias("n_errors")).where(F.col("n_errors") >= least)


def overall_risk(findings: DataFrame) -> DataFrame:
    """The share of errors, its grade, and what adds to the risk."""
    got = findings.agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("n_errors"), F.count_distinct("rule").alias("n_rules"),
    )
    ratio = F.when(F.col("n") > 0, F.col("n_errors") / F.col("n")).otherwise(0.0)
    grade = F.when(ratio > 0.2, "high").when(ratio > 0.1, "medium-high").when(ratio > 0.05, "medium").when(ratio > 0.01, "low-medium").otherwise("low")
    return got.select("n", "n_errors", "n_rules", ratio.alias("ratio"), grade.alias("risk"), (F.col("n_errors") > 0).alias("has_errors"), (F.col("n_rules") > 5).alias("many_rules"))


def cvss(n_cwe: Column, severity: Column) -> Column:
    step = F.when(severity == "ERROR", 1.0).when(severity == "WARNING", 0.7).otherwise(0.3)
    return F.least(F.lit(10.0), 0.5 * n_cwe + 5 * step)


def same_rule(findings: DataFrame, k: int = 5) -> DataFrame:
    """(finding_id, other_file): up to k other files, by name, in which a finding's rule fires."""
    files = findings.select("rule", F.col("file").alias("other_file")).distinct()
    ranked = files.withColumn("n", F.row_number().over(W.partitionBy("rule").orderBy("other_file"))).where(F.col("n") <= k + 1).drop("n")
    pairs = findings.select("finding_id", "rule", "file").join(ranked, "rule").where(F.col("file") != F.col("other_file"))
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("finding_id").orderBy("other_file"))).where(F.col("n") <= k).select("finding_id", "other_file")
