"""Literal cases for operators that the tables rarely exercise."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import chunking, dedup, graph, metrics, rules, search, security, sync, vector


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_similarities(spark):
    a, b = arr(1.0, 2.0, 3.0), arr(4.0, 5.0, 6.0)
    assert round(one(spark, S.cosine(a, b)), 4) == 0.9746 and one(spark, S.cosine(arr(1.0, 0.0), arr(0.0, 1.0))) == 0 and one(spark, S.cosine(a, arr(0.0, 0.0, 0.0))) == 0
    assert round(one(spark, S.euclidean(a, b)), 4) == 5.1962 and one(spark, S.dot(a, b)) == 32 and one(spark, S.manhattan(a, b)) == 9
    with pytest.raises(Exception, match="differ in length"):
        one(spark, S.dot(a, arr(1.0)))
    assert one(spark, S.jaccard(arr("a", "b", "c"), arr("b", "c", "d"))) == 0.5
    empty = F.array().cast("array<string>")
    assert one(spark, S.jaccard(empty, empty)) == 0 and one(spark, S.contextual(empty, empty)) == 1 and one(spark, S.contextual(empty, arr("a"))) == 0
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert round(one(spark, S.ensemble([F.lit(0.8), F.lit(0.4)], [1, 1])), 6) == 0.6 and one(spark, S.ensemble([], [])) == 0
    with pytest.raises(ValueError):
        S.ensemble([F.lit(1.0)], [])
    assert one(spark, S.path_proximity(F.lit("a/b/x.ts"), F.lit("a/b/y.ts"))) == 1 and one(spark, S.path_proximity(F.lit("a/bc/x"), F.lit("a/bd/x"))) == 0.75
    assert one(spark, S.feature_map(F.create_map(F.lit("k"), F.lit(1.0)), F.create_map(F.lit("k"), F.lit(2.0), F.lit("z"), F.lit(9.0)))) == 0.5


CODE = """import { a } from 'x';
class Foo extends Bar { }
function run(x) {
  if (x > 1 && ready) {
    return items.filter(i => i.ok).map(i => i.id);
  }
  try { go(x) } catch (e) { throw new Error(e); }
}
// @example usage
run(1);

export const z = 1;
"""


def test_syntax_and_rules(spark):
    docs = spark.createDataFrame([(1, CODE), (2, "")], "doc_id long, text string")
    nodes = chunking.syntax_nodes(docs)
    found = {(r.type, r.start_line) for r in nodes.collect()}
    assert {("import_statement", 1), ("class_declaration", 2), ("function_declaration", 3), ("if_statement", 4), ("throw_statement", 7), ("export_statement", 12)} <= found
    hit = {(r.rule, r.type) for r in rules.match(nodes).collect()}
    assert {("control_structure", "if_statement"), ("error_handling", "throw_statement"), ("functional_programming", "call_expression"), ("comment_marked", "comment")} <= hit
    assert chunking.search_nodes(nodes, "//class_declaration", "Foo").count() == 1
    assert chunking.marked_snippets(docs).first().content == "run(1);"
    assert chunking.compare(nodes, 1, 2).first().classes == 1
    rule = {"name": "r", "target": "if_statement", "conditions": [{"type": "contentPattern", "value": "ready"}, {"type": "complexity", "operator": "greaterThan", "value": "2"}]}
    assert rules.validate(rule) == [] and nodes.where(rules.custom(rule)).count() == 1
    assert rules.validate({"name": "", "conditions": [{"type": "no"}]}) == ["name is missing", "target is missing", "no condition type 'no'"]


def test_scalar_text(spark):
    c = F.lit("if (a && b) { f(x); } else { g(); }")
    assert one(spark, X.complexity(c)) == 4 and one(spark, X.complexity(F.lit("if"))) == 1
    assert one(spark, X.rolling_hash(F.lit("hello world, a long one"))) == java_hash("hello world, a long one")
    assert one(spark, X.has_side_effects(F.lit("x = 1"))) and not one(spark, X.has_side_effects(F.lit("const y = Math.max(1, 2)")))
    assert one(spark, X.language_of_path(F.lit("src/A.TSX"))) == "typescript" and one(spark, X.language_of_content(F.lit("def f(x)"))) == "python"
    q = F.lit("find class Foo and function bar in main.ts")
    assert one(spark, X.query_type(q)) == "structural" and one(spark, X.intent(F.lit("fix the bug"))) == "debugging"
    assert [e.value for e in one(spark, X.entities(q))] == ["main", "bar", "Foo"]
    assert one(spark, X.expansions(arr("error", "data"), X.entities(F.lit("x")), F.lit(True))) == ["exception", "bug", "issue", "information", "content"]
    assert one(spark, X.preprocess(F.lit("a  // b\nc"))) == "a" and one(spark, X.preprocess(F.lit("a  // b\nc"), fix_order=True)) == "a c"
    valid = "function run(x) {\n  const y = x + 1;\n  return y * 2;\n}"
    assert one(spark, X.valid_snippet(F.lit(valid), F.lit("logic_block"), F.lit("javascript"))) and not one(spark, X.valid_snippet(F.lit("// only\n// words\n// here and there too"), F.lit("logic_block"), F.lit("javascript")))


def java_hash(s):
    h = 0
    for ch in s:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_scores(spark):
    w = one(spark, search.fusion_weights(F.lit("what class")))
    assert math.isclose(sum(w), 1.0) and math.isclose(w.graph / w.vector, 0.4 / 0.5)
    assert one(spark, search.recency(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-31").cast("timestamp"))) == pytest.approx(math.exp(-1))
    assert one(spark, search.snippet_score(F.lit(0.5), F.lit("error_handling"), F.lit(2), X.language_features(F.lit("async await ...")), F.lit("simple error"))) == 1.0
    assert one(spark, search.contributions({"a": F.lit(0.5), "b": F.lit(0.25)})) == (67, 33)
    assert [h.term for h in one(spark, search.highlights(F.lit("Alpha beta"), F.lit("alpha gamma"), F.lit(0.9)))] == ["alpha", ""]
    assert one(spark, search.linear_model({"semanticScore": F.lit(9.0)})) == 1.0 and one(spark, search.symbol_score(F.lit("getUser"), F.lit("get"))) == 0.9
    assert one(spark, search.graph_relevance(F.lit("p"), F.lit("f"), F.lit(None), F.lit(True))) == pytest.approx(0.9)


def test_hybrid_and_rerank(spark):
    h = lambda *r: spark.createDataFrame(list(r), "id long, score double")
    got = {r.id: r.score for r in search.hybrid({"semantic": h((1, 0.5), (2, 1.0)), "keyword": h((2, 1.0), (3, 1.0))}).collect()}
    assert got == {1: pytest.approx(0.2), 2: pytest.approx(0.7), 3: pytest.approx(0.3)}
    assert {r.id: r.score for r in search.apply_rerank(h((1, 0.1), (2, 0.2)), h((1, 0.9))).collect()} == {1: 0.9, 2: 0.2}


def test_fuzzy_is_greedy(spark):
    base = [f"w{i}" for i in range(40)]
    far = lambda n: " ".join(base[n:] + [f"x{i}" for i in range(n)])
    docs = spark.createDataFrame([(1, far(0)), (2, far(1)), (3, far(2)), (4, far(0)), (5, "other words here")], "doc_id long, text string")
    kept = {r.id for r in dedup.fuzzy(docs).where("kept").collect()}
    assert kept == {1, 3, 5}


def test_graph_cases(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert graph.shortest_path(1, 4, e).first().path == [1, 2, 3, 4] and graph.shortest_path(4, 1, e).count() == 0
    assert [r.cycle for r in graph.cycles(e).collect()] == [[1, 2, 3]] and graph.cycles(e, compat=True).count() == 3
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert sum(r.rank for r in graph.pagerank(e).collect()) == pytest.approx(1)
    assert {r.id: r.dominators for r in graph.dominators(1, e).collect()}[4] == [1, 2, 3, 4]
    f = spark.createDataFrame([("main", False), ("a", False), ("b", True), ("c", False)], "name string, exported boolean")
    assert [r.name for r in graph.dead_code(f, spark.createDataFrame([("a",)], "callee string")).collect()] == ["c"]


def test_graph_beyond_fifty_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(53)] + [(53, 0), (53, 53), (90, 53)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "id long")
    assert graph.depth(start, chain).first().depth == 53
    uses = spark.createDataFrame([(0, "x = req.body"), (1, "y")], "id long, code string")
    assert sorted(r.id for r in security.tainted(chain, uses).collect()) == list(range(54))
    assert {r.id: r.dominators for r in graph.dominators(0, chain).collect()} == {i: list(range(i + 1)) for i in range(54)}


def test_dominators_of_joins_and_loops(spark):
    e = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 1), (4, 5), (2, 5), (5, 6), (6, 3), (7, 6), (6, 0), (0, 0)]
    got = {r.id: r.dominators for r in graph.dominators(0, spark.createDataFrame(e, "src long, dst long")).collect()}

    def reached(cut):
        seen, todo = set(), [0] if cut != 0 else []
        while todo:
            seen.add(x := todo.pop())
            todo += [b for a, b in e if a == x and b != cut and b not in seen]
        return seen

    assert got == {v: [d for d in range(8) if v not in reached(d)] for v in reached(None)} | {0: [0]}


def test_secrets_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "x\n" * 1200 + "a Token")], "page_id long, html string")
    assert [tuple(r) for r in security.secrets(docs).collect()] == [(1, 1201, "token")]


def test_consistency_literals(spark):
    m = spark.createDataFrame([("1", "v", "g"), ("2", None, "g"), ("3", "v", None), ("4", None, None)], "entity_id string, vector_id string, graph_id string")
    found = sync.issues(m).collect()
    assert len(found) == 4 and {r.severity for r in found} == {"medium"}
    assert [r.x for r in m.select(sync.status(F.col("vector_id"), F.col("graph_id")).alias("x")).collect()] == ["synced", "graph_only", "vector_only", "conflict"]


def test_metrics_cases(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("value"))
    assert metrics.query_stats(df, 10.0).first().p95_time == 95 and metrics.query_stats(df.limit(0), 10.0).first().avg_time == 0
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate([1, 1, 0, 0, 0, 1])], "k string, seq long, bad int")
    assert metrics.failure_counter(rows, "k", ("seq",), F.col("bad") == 1).first().failures == 1
    g = spark.createDataFrame([("n", {"b": 'x"y', "a": "1"}, 2)], "name string, labels map<string,string>, value long")
    assert metrics.exposition(g).first().line == 'n{a="1",b="x\\"y"} 2'


def test_security_cases(spark):
    page = "const q = query('a' + b)\nel.innerHTML = req.body\npassword = 1\nopen('../x' + y)"
    docs = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = {(r.issue, r.line_no) for r in security.scan(docs).collect()}
    assert got == {("sql_injection", 1), ("xss", 2), ("path_traversal", 4)}
    assert ("req.body", "innerHTML") in {(r.source, r.sink) for r in security.flows(docs).collect()}
    assert [(r.name, r.line_no) for r in security.secrets(docs).collect()] == [("password", 3)]


def test_vector_cases(spark):
    v = arr(*[float(i) for i in range(8)])
    assert one(spark, vector.adapt(v, 4, 8, "stride")) == [0, 2, 4, 6] and one(spark, vector.adapt(v, 4, 8, "pooling")) == [0.5, 2.5, 4.5, 6.5]
    assert one(spark, vector.adapt(v, 10, 8, "padding")) == [*range(8), 0, 0] and one(spark, vector.adapt(v, 15, 8)) == pytest.approx([i / 2 for i in range(15)])
    e = one(spark, vector.hashing_embedding(F.lit("alpha beta alpha")))
    assert sum(x * x for x in e) == pytest.approx(1) and one(spark, vector.hashing_embedding(F.lit(""))) == [0.0] * 64
    rows = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "id long, name string, n int")
    assert [r.id for r in rows.where(vector.field_filter([("n", "gte", 4), ("name", "in", ["a", "b"])])).collect()] == [2]
