"""Literal cases of code units, rule texts, findings, result sets, graph patterns and spaces."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dedup, findings, graph, results, rules, search, sync, vector
from tessera.sources import tables
from tessera.streaming import changes

CODE = """class A extends B.C {
  size = 1;
  run(a) {
    if (a) {
      return 1;
    }
  }
}
function f(x: int, y = 2): Promise<int> {
  const g = (z) => z;
  return x;
}
function open(a) {
  never closed
let last = 1;"""


def test_code_units_and_symbols(spark):
    docs = spark.createDataFrame([(1, CODE), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.type, r.name): r for r in chunking.code_units(docs).collect()}
    a, f, g, o = got["class", "A"], got["function", "f"], got["function", "g"], got["function", "open"]
    assert (a.base, a.n_methods, a.n_properties, a.start_line, a.end_line) == ("B.C", 1, 1, 1, 8)
    assert (f.parameters, f.return_type, f.start_line, f.end_line) == (["x", "y"], "Promise<int>", 9, 12)
    assert (g.start_line, g.end_line, g.return_type) == (10, 10, "unknown") and (o.start_line, o.end_line) == (13, 15) and len(got) == 4
    scope = {(r.kind, r.name): r.scope for r in chunking.symbols(docs).collect()}
    assert scope["function", "g"] == "f" and scope["variable", "last"] == "open" and scope["class", "A"] is None


def test_lines_of_repeated_nodes(spark):
    docs = spark.createDataFrame([(1, "f(1);\n\nf(1);\nif (a) {\n b(2) }\nf(1);")], "doc_id long, text string")
    got = [(r.node, r.start_line) for r in chunking.syntax_nodes(docs).orderBy("seq").collect()]
    assert [x for x in got if x[0] == "f(1)"] == [("f(1)", 1), ("f(1)", 3), ("f(1)", 6)] and ("b(2)", 5) in got


RULE = """
rule "AsyncRule" {
  description: "Finds async functions"
  target: "function_declaration"

  condition {
    contentPattern: "async"
    complexity: greaterThan(5)
  }

  action {
    type: extract
    parameters: {
      includeComments: true
      depth: 3, name: "x"
    }
  }
}
"""


def test_rule_texts(spark):
    rule = rules.parse(RULE)
    assert (rule["name"], rule["description"], rule["target"]) == ("AsyncRule", "Finds async functions", "function_declaration")
    assert rule["conditions"] == [{"type": "contentPattern", "operator": "equals", "value": "async"}, {"type": "complexity", "operator": "greaterThan", "value": "5"}]
    assert rule["actions"] == [{"type": "extract", "parameters": {"includeComments": True, "depth": "3", "name": "x"}}] and rules.validate(rule) == []
    for bad in ("", "rule x {}", RULE.replace("target:", "aim:"), "@" + RULE, RULE[:-3]):
        with pytest.raises(ValueError):
            rules.parse(bad)
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, version int, source string")
    assert {r.name: r.source for r in rules.versioned(versions).collect()} == {"a": "y", "b": "z"}


def test_findings(spark):
    raw = spark.createDataFrame([(None, None, None, None, None, None, None), ("r", "p", 3, 0, 2, "m", "error"), ("r", "p", 0, 9, 0, "", "High")], "check_id string, path string, line int, end_line int, col int, message string, severity string")
    got = sorted(tuple(r) for r in findings.normal(raw).collect())
    assert got == [("r-p-1", "r", "p", 1, 9, 1, "No message provided", "INFO"), ("r-p-3", "r", "p", 3, 3, 2, "m", "ERROR"), ("unknown-rule-unknown-1", "unknown-rule", "unknown-file", 1, 1, 1, "No message provided", "INFO")]
    none = spark.createDataFrame([], "severity string, rule string, fix string")
    assert tuple(findings.risk_factors(none).first()) == (False, False, False)


def test_results(spark):
    hits = spark.createDataFrame([(1, 0.0, "a", 1, 1, 2), (2, 0.9, "a", 1, 1, 1), (3, 0.2, "b", 1, 1, 3)], "id long, score double, file_path string, line int, col int, seq int")
    assert [r.id for r in results.first_at_place(hits).collect()] == [2, 3]
    shaped = {r.id: r for r in results.normal(hits.drop("line", "col"), "graph").collect()}
    assert shaped[1].score == 0.5 and shaped[2].score == 0.9 and shaped[1].language == "unknown" and shaped[1].start_line == 0
    asked = spark.createDataFrame([(1, "how to fix a Bug bug now quickly please")], "item_id long, text string")
    assert [r.suggestion for r in results.suggestions(asked, "item_id", "text").orderBy("place").collect()] == ["how", "fix", "bug", "bug", "now"]


def test_scores_of_zero_count_as_half(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (0.3,)], "s double").select(search.given(F.col("s")).alias("x"))
    assert [r.x for r in rows.collect()] == [0.5, 0.5, 0.3]


def test_reranking_and_adapters(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id long, score double")
    got = search.reranked(hits, {"semantic": F.when(F.col("id") == 1, 1.0).otherwise(0.0)}, "semantic").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 0.65), (2, 0.63)]
    assert vector.best_adapter() == "interpolation" and vector.best_adapter(1, 0) == "stride" and vector.best_adapter(0, 1) == "padding"


def test_graph_patterns(spark):
    v = spark.createDataFrame([("a", "X", {"k": "1"}), ("b", "Y", {"k": "2"}), ("c", "X", {})], "id string, tag string, properties map<string,string>")
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("s", "a", "c")], "type string, src string, dst string")
    assert [tuple(r) for r in graph.match(v, e, "X", "r", "Y", "", "X").collect()] == [("a", "b", "c")]
    assert [r.id for r in graph.find(v, "X", k="1").collect()] == ["a"]
    ids = v.select("id")
    assert {tuple(r) for r in graph.distances(ids, e).collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 1)}
    assert {(r.id, r.kind) for r in graph.dependencies(ids.where("id = 'b'"), e, inward=True).collect()} == {("a", "direct")}
    one = graph.analysis(ids.where("id = 'a'"), e).first()
    assert (one.n_nodes, one.n_edges, one.n_components, one.by_type) == (3, 3, 1, {"r": 2, "s": 1})


def test_fuzzy_decides_long_chains(spark):
    base = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(k, " ".join([f"x{i}" for i in range(2 * k)] + base[2 * k :])) for k in range(40)], "doc_id long, text string")
    kept = {r.id for r in dedup.fuzzy(docs).where("kept").collect()}
    assert kept == set(range(0, 40, 2))


def test_exact_keeps_short_and_first(spark):
    long = "a text of over fifty characters, which is as long as it must be"
    rows = [(3, long), (1, long + " "), (2, "short"), (4, "short"), (5, None)]
    got = {r.doc_id: r.kept for r in dedup.exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 3: False, 2: True, 4: True, 5: True}


def test_spaces_and_replace(spark):
    s = tables.Spaces(spark, "space_test_")
    s.drop("g")
    s.create("g")
    v = tables.by_tag({"A": spark.createDataFrame([(1, "x")], "id long, name string"), "B": spark.createDataFrame([(2, 5)], "id long, size int")})
    s.insert("g", vertices=v)
    assert s.size("g") == {"vertices": 2, "edges": 0} and "g" in s.names()
    assert {r.id: r.properties for r in s.vertices("g").collect()} == {"1": {"name": "x", "size": None}, "2": {"name": None, "size": "5"}}
    s.clear("g")
    assert s.size("g")["vertices"] == 0
    s.drop("g")
    c = tables.Collections(spark, "vectors_swap")
    for n in ("q", "q__new", "q__old"):
        c.drop(n)
    c.create("q__new", 2)
    c.recover("q")  # what a broken replace left behind takes its place
    assert c.exists("q") and not c.exists("q__new")
    c.drop("q")


def test_failed_writes_are_tried_again_and_given_up(spark):
    tries, dead = [], []

    def write(df):
        tries.append(1)
        raise OSError

    store = spark.createDataFrame([("a", 1)], "path string, v int")
    batch = spark.createDataFrame([("b", 2, "created")], "path string, v int, kind string")
    changes.index_batch(lambda: store, write, lambda df: dead.append(df.count()), wait=0)(batch, 0)
    assert len(tries) == 3 and dead == [0, 1]
    with pytest.raises(OSError):
        changes.index_batch(lambda: store, write, wait=0)(batch, 0)


def test_repairs_and_cascades(spark):
    m = spark.createDataFrame([(1, 1, None), (2, None, 2), (3, None, None), (4, 4, 40)], "entity_id long, vector_id long, graph_id long")
    assert {r.entity_id: r.action for r in sync.repairs(m, F.col("graph_id") != F.col("vector_id")).collect()} == {1: "write_graph", 2: "write_vector", 3: "drop_mapping", 4: "rewrite_graph"}
    assert sorted(tuple(r) for r in sync.repaired_mapping(m).collect()) == [(1, 1, 1, "synced"), (2, 2, 2, "synced"), (4, 4, 40, "synced")]


def test_context_of_times_to_come(spark, tmp_path):
    """The query takes recency as it is, the operator alone stops at 1."""
    from math import exp

    from tessera.plans import reports

    spark.createDataFrame([(i, "orantion x") for i in (50_001, 61_003)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.score for r in reports.QUERIES["rerank_hybrid"](spark, str(tmp_path)).collect()}
    for i in (50_001, 61_003):
        context = (0.2 if i % 3 == 0 else 0) + 0.1 * exp((1704067200 + i * 3600 - 1717200000) / 86400 / 365)
        want = (i % 100) / 100 * (1 - (0.3 + 0.2 + 0.1)) + 0.3 * (1 / 3) + 0.2 * (min(i % 13 / 10, 1) + (0.2 if i % 2 == 0 else 0)) + 0.1 * context
        assert abs(got[i] - want) < 2e-6
    late = search.context_part(F.lit("class"), F.lit(True), F.lit("2034-01-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    assert spark.range(1).select(late).first()[0] == 1.0
