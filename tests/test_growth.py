"""What a query holds, reads or shuffles must follow its input, and each step is worked out once."""

import contextlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import graph, structure


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_nodes_leave_python_in_pieces(spark):
    text = "function f(a) { if (a) { go(a); } }\n" * 100
    n = 4 * structure.HELD // len(text)
    batch = (pa.array([None, *[text] * n, ""]), pa.array(["javascript"] * (n + 2)))
    pieces = list(structure._trees(iter([batch])))
    assert sum(map(len, pieces)) == n + 2 and max(map(len, pieces)) <= structure.HELD // len(text) + 2
    docs = spark.range(600).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit(text), F.col("id").cast("int") % 5)).alias("text"))
    got = {r.id: r.n for r in structure.tree(docs.coalesce(1), "id").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: 300 * (i % 5) for i in range(600) if i % 7 and i % 5}


def test_paths_parse_each_text_once(spark, tmp_path):
    from tessera.plans import code

    spark.range(7).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = code.QUERIES["source_paths"](spark, str(tmp_path))
    assert plan(got).count("ArrowEvalPython [") == 1
    assert {r.query for r in got.collect()} == {q for q in code.PATHS if q != "/*/try"}  # none of the texts has one


def test_distances_of_many_alike_keep_few_rows_between(spark, monkeypatch):
    n = 300  # leaves at each of two nodes that meet in one
    edges = [(f"a{k}", "a") for k in range(n)] + [(f"b{k}", "b") for k in range(n)] + [("a", "r"), ("b", "r")]
    ids = ["a", "b", "alone"] + [f"{x}{k}" for x in "ab" for k in range(n)]
    rows, saved = [], graph.saved

    def counted(df):
        made = saved(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(graph, "saved", counted)
    e = graph.both_ways(spark.createDataFrame(edges, "src string, dst string"))
    got = {(r.start, r.id): r.distance for r in graph.distances(spark.createDataFrame([(i,) for i in ids], "id string"), e, 4).collect()}
    near = lambda x: (x[0], len(x) > 1)
    want = {(x, y): near(x)[1] + near(y)[1] + 2 * (x[0] != y[0]) for x in ids for y in ids if x != y and "alone" not in (x, y)}
    assert got == want and max(rows) <= 4 * n + 8  # the edges; pairs only in the result


def test_kinds_and_calls_read_each_text_once(spark, tmp_path, monkeypatch):
    from tessera.operators import chunking
    from tessera.plans import code

    spark.range(7).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    kinds = code.QUERIES["nodes_by_kind"](spark, str(tmp_path))
    assert plan(kinds).count("FileScan") == 1
    nodes = code.nodes(spark, str(tmp_path))
    want = {(r.id, k): r.n for k in chunking.KINDS for r in chunking.nodes_of(nodes, k).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert {(r.id, r.kind): r.n for r in kinds.collect()} == want
    parsed, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: parsed.append(plan(df).count("ArrowEvalPython [")) or saved(df))
    for name in ("resolved_calls", "cyclomatic_by_file"):
        parsed.clear()
        assert plan(code.QUERIES[name](spark, str(tmp_path))).count("ArrowEvalPython [") + sum(parsed) == 1


def test_rounds_shuffle_what_is_sent_and_no_edges(spark, monkeypatch):
    edges = [(f"a{k}", f"b{k * k % 7}") for k in range(30)] + [(f"b{k}", f"c{k % 3}") for k in range(7)] + [("x", "y"), ("x", None)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    want = {x: x for e in edges for x in e if x}
    for _ in want:
        for a, b in edges[:-1]:
            want[a] = want[b] = min(want[a], want[b])
    joins = []
    for name in ("saved", "bucketed"):
        step = getattr(graph, name, None)
        note = lambda df, *more, step=step: joins.append((p.count("Exchange hashpartitioning"), "agg" in p.lower()) if (p := plan(df)).count("Join") else (0, False)) or step(df, *more)
        monkeypatch.setattr(graph, name, note, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.communities(frame)
        rounds = [n for n, agg in joins if agg]
        assert rounds[-2:] == [1, 1]  # votes, by the node that they are for
        joins.clear()
        assert {r.id: r.component for r in graph.components(frame).collect()} == want
        rounds = [n for n, agg in joins if agg][1:]  # behind the numbering
        assert rounds and max(rounds) == 1, joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_nodes_that_lead_nowhere_are_met_once(spark, monkeypatch):
    ends = [(f"m{k % 3}", f"z{j}") for j in range(200) for k in (j, j + j % 2)]
    edges = [("r", f"m{k}") for k in range(3)] + [("m0", "n"), ("m1", "n"), ("n", "o"), ("o", "y"), ("lost", "z0"), ("lost", "gone")] + ends
    rows = []
    for name in ("saved", "bucketed"):
        step = getattr(graph, name, None)
        monkeypatch.setattr(graph, name, lambda df, *more, step=step: rows.append((m := step(df, *more)).count()) or m, raising=False)
    got = graph.dominators("r", spark.createDataFrame(edges, "src string, dst string"))
    want = {"r": ["r"], "n": ["n", "r"], "o": ["n", "o", "r"], "y": ["n", "o", "r", "y"]} | {f"m{k}": [f"m{k}", "r"] for k in range(3)}
    want |= {f"z{j}": sorted([f"z{j}", "r"] + ([] if j % 2 else [f"m{j % 3}"])) for j in range(200)}
    assert {x.id: x.dominators for x in got.collect()} == want
    assert sum(n > 150 for n in rows) <= 6  # before in each of the rounds


def test_texts_are_searched_once_a_pattern(spark, tmp_path):
    from tessera.functions import text as X
    from tessera.operators import chunking
    from tessera.plans import code

    spark.range(7).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    for name, patterns in (("expression_rules", chunking.EXPRESSIONS), ("code_snippets", chunking.NODE_PATTERNS)):
        searched = [x for x in plan(code.QUERIES[name](spark, str(tmp_path))).split("Generate ") if "posexplode(" in x][-1]
        assert searched.count("regexp_extract_all(") == len(patterns) and "split(" not in searched and "RLIKE" not in searched
    docs = spark.createDataFrame([(1, "if (a) {\n b;\n}\n\u00e9if (b) c;\nxif (d) e; try { if (f) g }"), (2, None), (3, "")], "doc_id long, text string")
    rows = lambda lines: chunking.syntax_nodes(docs, lines=lines).select("doc_id", "seq", "type", "node").collect()
    assert rows(True) == rows(False) and [r.node for r in rows(False) if r.type == "if_statement"] == ["if (a) {\n b;\n}", "if (b) c;", "if (f) g }"]
    assert "A-Z" not in X.ascii_edges(r"\bif\b|\b\w+\b")


def test_unit_counts_take_no_trees_and_scans_test_few_lines(spark, tmp_path):
    from tessera.operators import chunking, security
    from tessera.plans import code

    spark.range(7).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    python = [x for x in plan(code.QUERIES["code_metrics"](spark, str(tmp_path))).splitlines() if "ArrowEvalPython [" in x]
    assert len(python) == 1 and "_types(" in python[0]
    docs = code.source(spark, str(tmp_path)).union(spark.createDataFrame([(99, "javascript", None), (100, "java", "")], "id long, language string, text string"))
    units = chunking.code_units(docs, "id", language=F.col("language"))
    want = {r.id: (r.f, r.c) for r in units.groupBy("id").agg(F.count_if(F.col("type") == "function").alias("f"), F.count_if(F.col("type") == "class").alias("c")).collect()}
    got = docs.select("id", chunking.count_units(F.col("text"), F.col("language")).alias("u")).select("id", "u.*").collect()
    assert len(got) == 9 and {r.id: (r.n_functions, r.n_classes) for r in got} == {r.id: want.get(r.id, (0, 0)) for r in got} and len(want) == 7
    texts = ["SELECT a FROM b WHERE c +", "sYsTeM 'x'", "x.INNERHTML = y", "a ../b", "nothing here", "<!entity", "xml version", "http://a.LocalHost", "ſelect a from b where c+"]
    found = security.scan(spark.createDataFrame([(1, "\n".join(texts)), (2, None)], "page_id long, html string"))
    assert "exists(array(lower(" in plan(found)
    assert [(r.issue, r.line_no) for r in found.orderBy("line_no", "pattern").collect()] == [
        ("sql_injection", 1), ("xxe", 2), ("xss", 3), ("path_traversal", 4), ("xxe", 6), ("xxe", 7), ("ssrf", 8),
    ]


def test_features_are_worked_out_once_for_both_sides(spark, tmp_path, monkeypatch):
    from tessera.plans import corpus

    texts = [(0, "if (a) { b; }", "x"), (1, "if (a) { b; }", "x"), (2, None, None), (3, "class A { }", "y"), (5, "", "y")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    steps, saved = [], corpus.saved
    monkeypatch.setattr(corpus, "saved", lambda df: steps.append(plan(df)) or saved(df))
    got = corpus.QUERIES["structural_similarity"](spark, str(tmp_path))
    assert [p.count("FileScan") for p in steps] == [1] and "RLIKE" in steps[0] and "RLIKE" not in plan(got)
    rows = {r.doc_id: r.similarity for r in got.collect()}
    assert set(rows) == {0, 1, 2} and rows[0] == 1.0 and all(0 <= v < 1 for k, v in rows.items() if k and v is not None)


def test_flows_walk_only_what_leads_from_definitions_to_uses(spark, monkeypatch):
    others = [(f"p{k}", f"s{k % 5}") for k in range(200)] + [(f"s{k}", "r") for k in range(5)]  # these lead to the use, from no definition
    edges = [("a", "n"), ("a", "n"), ("n", "r"), ("n", "m"), ("m", "n"), ("b", "x"), ("x", "y"), ("a", None), (None, "r"), ("r", "q"), *others]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    walked, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda starts, e, *more: walked.append(e.count()) or reach(starts, e, *more))
    defs = frame([("a", "v"), ("b", "v"), ("r", "v"), ("a", "w"), ("p7", "u")], "id string, name string")
    got = graph.flows(defs, frame([("r", "v"), ("m", "w"), ("n", "v")], "id string, name string"), frame(edges, "src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == [("v", "a", "n"), ("v", "a", "r"), ("w", "a", "m")]
    assert walked == [4]  # a to n, n to r, n to m, m to n


def test_pairs_are_told_apart_by_number(spark, tmp_path):
    from tessera.plans import graphs

    for name, columns in (("customer", "c_custkey long, c_nationkey int"), ("supplier", "s_suppkey long, s_nationkey int"), ("nation", "n_nationkey int, n_regionkey int")):
        spark.createDataFrame([(1, 2)], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, 2), (1, 2), (None, 2), (None, 2), (3, None)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = graphs.edges(spark, str(tmp_path))
    assert "keys=[l_partkey" in plan(e)
    rows = sorted((r.src or "", r.dst or "") for r in e.where("type = 'CONTAINS'").collect())
    assert rows == [("", "s2"), ("p1", "s2"), ("p3", "")]
