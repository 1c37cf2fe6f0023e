"""Queries over edges that the star schema implies: customers to nations to regions, orders to parts, suppliers to nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.common import r6, table


def edges(spark, d):
    """(type, src, dst): BELONGS_TO customer, supplier -> nation -> region; CONTAINS part -> supplier."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = lambda t, kind, a, b: table(spark, d, t).select(F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"))
    up = e("customer", "BELONGS_TO", name("c", "c_custkey"), name("n", "c_nationkey")).union(e("supplier", "BELONGS_TO", name("s", "s_suppkey"), name("n", "s_nationkey"))).union(e("nation", "BELONGS_TO", name("n", "n_nationkey"), name("r", "n_regionkey")))
    held = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()  # numbers take less room than names
    return up.union(held.select(F.lit("CONTAINS").alias("type"), name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")))


def calls(spark, d):
    """(src, dst): a call graph with cycles over the n parts: function i calls (10 i + 3) mod n and (i * i + 1) mod n."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    n = p.count()
    return p.select(F.col("i").alias("src"), ((10 * F.col("i") + 3) % n).alias("dst")).union(p.select("i", (F.col("i") * F.col("i") + 1) % n)).distinct()


def downward(spark, d):
    """(src, dst): from one root to the regions, their nations, these nations' suppliers and the parts they offer."""
    e = edges(spark, d).where("substr(src, 1, 1) <> 'c'")
    down = e.where("type = 'BELONGS_TO'").select(F.col("dst").alias("src"), F.col("src").alias("dst")).union(e.where("type = 'CONTAINS'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return down.union(table(spark, d, "region").select(F.lit("w"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def _degrees(spark, d):
    return G.degrees(edges(spark, d)).where("degree >= 20")


def _critical(spark, d):
    return G.degrees(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(3).select("id", "degree")


def _khop(spark, d):
    s = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return G.k_hop(s, edges(spark, d), 3)


def _reach(spark, d):
    s = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return G.reach(s, edges(spark, d), 3)


def _impact(spark, d):
    s = table(spark, d, "region").where("r_regionkey = 0").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return G.impact(s, edges(spark, d), 2).groupBy("distance").agg(F.count("*").alias("n"))


def _shortest(spark, d):
    return G.shortest_path(0, 33, calls(spark, d), 10).select("distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _paths(spark, d):
    got = G.all_paths(0, 33, calls(spark, d), 6, 1000)
    return got.select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _cycles(compat):
    def run(spark, d):
        return G.cycles(calls(spark, d), 5, compat).select(F.col("length").cast("long").alias("length"), F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))

    return run


def _components(spark, d):
    return G.components(edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


def _pagerank(spark, d):
    return G.pagerank(calls(spark, d), 20).select("id", r6("rank").alias("rank"))


def _ranked(spark, d):
    return G.ranked(G.pagerank(edges(spark, d), 5)).select("id", F.col("place").cast("long").alias("place"), r6("rank").alias("rank"))


def _communities(spark, d):
    return G.communities(edges(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


def _functions(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 9 == 1).alias("exported"))


def _dead(spark, d):
    f = _functions(spark, d).select(F.col("name").cast("string").alias("name"), "exported")
    return G.dead_code(f, calls(spark, d).select(F.col("dst").cast("string").alias("callee"))).select("name")


def _entries(spark, d):
    return G.entry_points(_functions(spark, d).select(F.col("name").cast("string").alias("name"), "exported")).select("name")


def _depth(spark, d):
    return G.depth(_ids(spark, 0), calls(spark, d))


def _summary(spark, d):
    e = edges(spark, d)
    return G.summary(G.nodes(e), e).withColumn("avg_degree", r6("avg_degree"))


def _counts(spark, d):
    e = edges(spark, d)
    v = G.nodes(e).select(F.substring("id", 1, 1).alias("tag"), "id")
    return G.counts(v, e)


def _risk(spark, d):
    g = G.degrees(calls(spark, d))
    return g.select("id", G.risk(F.col("n_in"), F.col("n_out"), F.col("id") % 12).alias("risk"))


def _dominators(spark, d):
    got = G.dominators("w", downward(spark, d))
    return got.select("id", F.array_join("dominators", ",").alias("dominators"))


def _spans(spark, d):
    """Orders as functions: a file, a name and lines."""
    return table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("file"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 1000).alias("start_line"), (F.col("o_orderkey") % 1000 + F.col("o_custkey") % 50).alias("end_line"))


def _dominator_tree(spark, d):
    return G.dominator_tree("w", downward(spark, d))


def _flow(spark, d):
    """(graph, root, src, dst): for each order a graph over its lines: each line leads to the next, and to the line that its part points at."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("long").alias("src"), "l_partkey")  # noqa: E741
    ends = F.explode(F.array(F.col("src") + 1, 1 + F.col("l_partkey") % 7))
    return l.select("graph", F.lit(1).cast("long").alias("root"), "src", ends.alias("dst"))


def _dominator_trees(spark, d):
    return G.dominator_trees(_flow(spark, d))


def _enclosing(spark, d):
    s = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("file"), F.col("p_size").cast("long").alias("line")).distinct()
    return G.enclosing(s, _spans(spark, d))


def _hot(spark, d, *more):
    """Rows of orders by file, of which one file has a third."""
    file = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").select(file.cast("long").alias("file"), *[F.expr(x) for x in more])


HOT_SPANS = ("o_orderkey AS name", "o_orderkey * 53 % 1000003 AS start_line", "o_orderkey * 53 % 1000003 + o_orderkey % 50 * (o_custkey % 7) AS end_line")


def _hot_enclosing(spark, d):
    sites = _hot(spark, d, "o_orderkey * 37 % 1000003 AS line")
    return G.enclosing(sites, _hot(spark, d, *HOT_SPANS))


def _hot_overlap(spark, d):
    changes = _hot(spark, d, "o_orderkey * 41 % 1000003 AS start_line", "o_orderkey * 41 % 1000003 + o_custkey % 20 AS end_line")
    return G.overlapping(changes, _hot(spark, d, *HOT_SPANS))


def _overlap(spark, d):
    change = table(spark, d, "supplier").select((F.col("s_suppkey") % 100).alias("file"), (F.col("s_suppkey") * 37 % 1000).alias("start_line"), (F.col("s_suppkey") * 37 % 1000 + 5).alias("end_line"))
    return G.overlapping(change, _spans(spark, d))


def _lines(form):
    def run(spark, d):
        n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
        return G.export_lines(n, calls(spark, d), form)

    return run


def vertices(spark, d):
    """(id, tag, properties) of customers, suppliers, nations, regions and parts."""
    v = lambda t, tag, p, key, **props: table(spark, d, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(tag).alias("tag"), F.create_map(*[x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]).alias("properties"))
    rows = v("customer", "Customer", "c", "c_custkey", name="c_name", segment="c_mktsegment").union(v("supplier", "Supplier", "s", "s_suppkey", name="s_name")).union(v("nation", "Nation", "n", "n_nationkey", name="n_name"))
    return rows.union(v("region", "Region", "r", "r_regionkey", name="r_name")).union(v("part", "Part", "p", "p_partkey", name="p_name", brand="p_brand"))


def _named(spark, d, table_name, p, key, test):
    return table(spark, d, table_name).where(test).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"))


def _reach_props(spark, d):
    s = _named(spark, d, "customer", "c", "c_custkey", "c_acctbal < 0")
    got = G.reach(s, edges(spark, d), 3, F.col("type") == "BELONGS_TO", 100)
    return G.with_properties(got, vertices(spark, d), "name").select("start", "id", "distance", "name")


def _match(spark, d):
    got = G.match(vertices(spark, d), edges(spark, d), "Part", "CONTAINS", "Supplier", "BELONGS_TO", "Nation")
    return got.groupBy("n0", "n2").agg(F.count("*").alias("n_suppliers"))


def _found(spark, d):
    return G.find(vertices(spark, d), "Customer", segment="BUILDING").select("id", F.col("properties")["name"].alias("name"))


def _where(spark, d):
    v = vertices(spark, d).select("id", "tag", F.col("properties")["name"].alias("name"))
    return v.where(G.where(("tag", "IN", ["Customer", "Supplier"]), ("name", "CONTAINS", "7"), ("id", "=~", "^[cs]1"))).select("id", "tag")


def _ends(spark, d):
    """Walks of up to three edges from parts to regions, by the names of their ends."""
    v = vertices(spark, d).select("id", F.col("properties")["name"].alias("name"))
    found = G.paths(v.where("substr(id, 1, 1) = 'p' AND name LIKE 'red%'").select("id"), edges(spark, d), 3).join(v.where("name LIKE 'A%'").select("id"), "id", "left_semi")
    return found.where("substr(id, 1, 1) = 'r'").groupBy("id").agg(F.count("*").alias("n"))


def _distances(spark, d):
    return G.distances(_named(spark, d, "nation", "n", "n_nationkey", "true").union(_named(spark, d, "supplier", "s", "s_suppkey", "true")), G.both_ways(edges(spark, d).where("type = 'BELONGS_TO' AND substr(src, 1, 1) <> 'c'")), 6)


def _analysis(spark, d):
    s = _named(spark, d, "supplier", "s", "s_suppkey", "s_acctbal < 0")
    got = G.analysis(s, edges(spark, d), "hierarchy", 2)
    return got.select("n_nodes", "n_edges", r6("avg_degree").alias("avg_degree"), "n_components", F.col("by_type")["BELONGS_TO"].alias("n_belongs"), G.cyclic_estimate(F.col("n_nodes"), F.col("n_edges")).alias("cyclic"))


def _dependencies(inward):
    def run(spark, d):
        s = _named(spark, d, "nation", "n", "n_nationkey", "true")
        return G.dependencies(s, edges(spark, d), 2, inward).groupBy("start", "kind").agg(F.count("*").alias("n"))

    return run


def _neighbours(spark, d):
    got = G.neighbours(calls(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return got.select("id", joined("successors"), joined("predecessors"))


def _references(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 11).alias("refs"))
    hits = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("wanted"), F.col("s_suppkey").alias("id"))
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.references(rows, hits, wanted)


def _node_types(spark, d):
    v = vertices(spark, d)
    label = F.when(F.col("tag") == "Part", F.concat("id", F.lit(".ts"))).otherwise(F.col("id"))
    return v.groupBy(G.node_type(label, F.nullif("tag", F.lit("Region"))).alias("kind")).agg(F.count("*").alias("n"))


def _overview(spark, d):
    v, e = G.overview(vertices(spark, d), edges(spark, d))
    return v.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(e.select(F.lit("edge"), "src", "dst"))


def _tainted(spark, d):
    """Parts as variables: every 50th reads what comes in, and taint follows calls to larger keys."""
    from tessera.operators import security

    uses = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 50, "x = req.body").otherwise("y = 1").alias("code"))
    return security.tainted(calls(spark, d).where("dst > src"), uses)


def _flows(spark, d):
    """Definitions at suppliers below zero and uses at nations, by the letter that their names share."""
    defs = _named(spark, d, "customer", "c", "c_custkey", "c_acctbal < 0").withColumn("name", F.lit("v"))
    uses = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("v").alias("name"))
    return G.flows(defs, uses, edges(spark, d)).groupBy("to_id").agg(F.count("*").alias("n"))


QUERIES = {
    "graph_degree": _degrees, "graph_critical": _critical, "graph_khop": _khop, "graph_reach": _reach, "graph_impact": _impact, "graph_shortest": _shortest, "graph_all_paths": _paths,
    "graph_cycles": _cycles(False), "graph_cycles_compat": _cycles(True), "graph_components": _components, "graph_pagerank": _pagerank, "graph_pagerank_top": _ranked, "graph_communities": _communities,
    "dead_nodes": _dead, "entry_points": _entries, "graph_depth": _depth, "graph_summary": _summary, "graph_counts": _counts, "call_risk": _risk, "dominators": _dominators, "dominator_tree": _dominator_tree, "function_dominators": _dominator_trees,
    "hot_enclosing": _hot_enclosing, "hot_overlapping": _hot_overlap, "enclosing_function": _enclosing, "overlapping_symbols": _overlap, "graph_dot": _lines("dot"), "graph_mermaid": _lines("mermaid"), "graph_json": _lines("json"),
    "graph_reach_filtered": _reach_props, "graph_match": _match, "graph_find": _found, "graph_where": _where, "graph_path_ends": _ends, "graph_distances": _distances, "graph_analysis": _analysis,
    "graph_dependencies": _dependencies(False), "graph_dependents": _dependencies(True), "graph_neighbours": _neighbours, "graph_references": _references, "graph_node_types": _node_types,
    "graph_overview": _overview, "taint_reach": _tainted, "def_use_flows": _flows,
}

_E = """e AS (SELECT 'BELONGS_TO' AS type, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'BELONGS_TO', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'BELONGS_TO', 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT DISTINCT 'CONTAINS', 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""
_C = "np AS (SELECT count(*) AS np FROM part), c AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, (10 * p_partkey + 3) % np AS dst FROM part, np UNION ALL SELECT p_partkey, (p_partkey * p_partkey + 1) % np FROM part, np))"
_V = """v AS (SELECT 'c' || c_custkey AS id, 'Customer' AS tag, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name, NULL FROM region UNION ALL SELECT 'p' || p_partkey, 'Part', p_name, NULL FROM part)"""
_LPA = lambda n: "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS id, src AS c FROM b), " + ", ".join(f"l{k} AS MATERIALIZED (SELECT id, c FROM (SELECT b.src AS id, l.c, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l.c) AS r FROM b JOIN l{k - 1} l ON l.id = b.dst GROUP BY b.src, l.c) WHERE r = 1)" for k in range(1, n + 1))
_DOWN = f"{_E}, dn AS (SELECT dst AS src, src AS dst FROM e WHERE src NOT LIKE 'c%' UNION ALL SELECT 'w', 'r' || r_regionkey FROM region)"
_DEG = "g AS (SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*)::BIGINT AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, 1, 0 FROM {0}) GROUP BY id)"
_STR = "array_to_string([x::VARCHAR FOR x IN {}], '{}')"
_WALK = "w AS (SELECT id AS start, id, 0 AS k FROM s UNION SELECT w.start, e.dst, k + 1 FROM w JOIN e ON e.src = w.id WHERE k < {})"
_PR = lambda n: "v AS (SELECT src AS id FROM {0} UNION SELECT dst FROM {0}), o AS (SELECT src, count(*) AS d FROM {0} GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v), " + ", ".join(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce(g.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM v)) AS r FROM v LEFT JOIN (SELECT x.dst AS id, sum(p.r / o.d) AS s FROM {{0}} x JOIN r{k - 1} p ON p.id = x.src JOIN o ON o.src = x.src GROUP BY x.dst) g ON g.id = v.id)" for k in range(1, n + 1))
_CYC = f"""WITH RECURSIVE {_C}, p AS (SELECT [src, dst] AS path, src AS f, dst AS l FROM c WHERE src <> dst UNION ALL SELECT list_append(path, c.dst), f, c.dst FROM p JOIN c ON c.src = p.l WHERE NOT list_contains(path, c.dst) AND len(path) < 5)
SELECT len(path)::BIGINT AS length, {_STR.format('path', '>')} AS cycle FROM p JOIN c ON c.src = p.l AND c.dst = p.f WHERE {{}} UNION ALL SELECT 1, src::VARCHAR FROM c WHERE src = dst"""
SQL = {
    "graph_degree": f"WITH {_E}, {_DEG.format('e')} SELECT * FROM g WHERE degree >= 20",
    "graph_critical": f"WITH {_E}, {_DEG.format('e')} SELECT id, degree FROM g ORDER BY degree DESC, id LIMIT 3",
    "graph_khop": f"WITH RECURSIVE {_E}, s AS (SELECT 'p' || p_partkey AS id FROM part), {_WALK.format(3)} SELECT DISTINCT start, id FROM w WHERE k = 3",
    "graph_reach": f"WITH RECURSIVE {_E}, s AS (SELECT 'p' || p_partkey AS id FROM part), {_WALK.format(3)} SELECT start, id, min(k)::INT AS distance FROM w GROUP BY ALL",
    "graph_impact": f"WITH RECURSIVE {_E}, w AS (SELECT 'r0' AS id, 0 AS k UNION SELECT e.src, k + 1 FROM w JOIN e ON e.dst = w.id WHERE k < 2), m AS (SELECT id, min(k) AS k FROM w GROUP BY id) SELECT k::INT AS distance, count(*)::BIGINT AS n FROM m GROUP BY k",
    "graph_shortest": f"WITH RECURSIVE {_C}, p AS (SELECT [0::BIGINT] AS path, 0::BIGINT AS l UNION ALL SELECT list_append(path, c.dst), c.dst FROM p JOIN c ON c.src = p.l WHERE NOT list_contains(path, c.dst) AND len(path) <= 10) SELECT len(path)::BIGINT - 1 AS distance, {_STR.format('path', '>')} AS path FROM p WHERE l = 33 ORDER BY len(p.path), p.path LIMIT 1",
    "graph_all_paths": f"WITH RECURSIVE {_C}, p AS (SELECT [0::BIGINT] AS path, 0::BIGINT AS l UNION ALL SELECT list_append(path, c.dst), c.dst FROM p JOIN c ON c.src = p.l WHERE NOT list_contains(path, c.dst) AND len(path) <= 6) SELECT len(path)::BIGINT - 1 AS length, {_STR.format('path', '>')} AS path FROM p WHERE l = 33 AND len(path) > 1",
    "graph_cycles": _CYC.format("list_min(path) = path[1]"),
    "graph_cycles_compat": _CYC.format("true"),
    "graph_components": f"WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), q AS (SELECT DISTINCT src AS id FROM b WHERE src LIKE 'r%'), w AS (SELECT id AS root, id FROM q UNION SELECT root, b.dst FROM w JOIN b ON b.src = w.id), m AS (SELECT root, min(id) AS component, count(*)::BIGINT AS n FROM w GROUP BY root) SELECT DISTINCT component, n FROM m",
    "graph_pagerank": f"WITH {_C}, {_PR(20).format('c')} SELECT id, round(r, 6) AS rank FROM r20",
    "graph_pagerank_top": f"WITH {_E}, b AS (SELECT src, dst FROM e), {_PR(5).format('b')} SELECT id, row_number() OVER (ORDER BY r DESC, id)::BIGINT AS place, round(r, 6) AS rank FROM r5 ORDER BY r DESC, id LIMIT 10",
    "dead_nodes": f"WITH {_C} SELECT p_partkey::VARCHAR AS name FROM part WHERE p_partkey % 9 <> 1 AND p_partkey NOT IN (SELECT dst FROM c)",
    "entry_points": "SELECT p_partkey::VARCHAR AS name FROM part WHERE p_partkey % 9 = 1",
    "graph_depth": f"WITH RECURSIVE {_C}, w AS (SELECT 0::BIGINT AS id, 0 AS k UNION SELECT c.dst, k + 1 FROM w JOIN c ON c.src = w.id WHERE k < 60), m AS (SELECT id, min(k) AS k FROM w GROUP BY id) SELECT max(k)::BIGINT AS depth FROM m",
    "graph_summary": f"WITH {_E}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM v)::BIGINT AS n_nodes, (SELECT count(*) FROM e)::BIGINT AS n_edges, round((SELECT count(*) FROM e) / (SELECT count(*) FROM v)::DOUBLE, 6) AS avg_degree",
    "graph_counts": f"WITH {_E}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT 'node' AS kind, id[1] AS name, count(*)::BIGINT AS n FROM v GROUP BY ROLLUP (id[1]) UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY ROLLUP (type)",
    "call_risk": f"WITH {_C}, {_DEG.format('c')} SELECT id, CASE WHEN id % 12 > 10 OR n_in > 5 OR n_out > 10 THEN 'high' WHEN id % 12 > 5 OR n_in > 2 OR n_out > 5 THEN 'medium' ELSE 'low' END AS risk FROM g",
    "dominators": f"""WITH {_DOWN}, d0 AS (SELECT 'w' AS id, 'w' AS dom), """ + ", ".join(
        f"d{k} AS (SELECT id, dom FROM (SELECT dn.dst AS id, d.dom, count(*) AS n FROM dn JOIN d{k - 1} d ON d.id = dn.src GROUP BY ALL) JOIN (SELECT dst AS id, count(*) AS m FROM dn GROUP BY 1) USING (id) WHERE n = m UNION ALL SELECT DISTINCT dst, dst FROM dn JOIN d{k - 1} d ON d.id = dn.src)" for k in (1, 2, 3, 4)
    ) + " SELECT id, string_agg(dom, ',' ORDER BY dom) AS dominators FROM (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(5)) + ") GROUP BY id",
    "dominator_tree": f"""WITH {_DOWN}, d0 AS (SELECT 'w' AS id, 'w' AS dom), """ + ", ".join(
        f"d{k} AS (SELECT id, dom FROM (SELECT dn.dst AS id, d.dom, count(*) AS n FROM dn JOIN d{k - 1} d ON d.id = dn.src GROUP BY ALL) JOIN (SELECT dst AS id, count(*) AS m FROM dn GROUP BY 1) USING (id) WHERE n = m UNION ALL SELECT DISTINCT dst, dst FROM dn JOIN d{k - 1} d ON d.id = dn.src)" for k in (1, 2, 3, 4)
    ) + ", doms AS (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(5)) + "), deep AS (SELECT id, count(*) - 1 AS depth FROM doms GROUP BY id) SELECT d.id, max(CASE WHEN p.depth = d.depth - 1 THEN o.dom END) AS idom, d.depth FROM deep d JOIN doms o ON o.id = d.id JOIN deep p ON p.id = o.dom GROUP BY d.id, d.depth",
    "function_dominators": """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS graph, l_linenumber::BIGINT AS src, unnest([l_linenumber + 1, 1 + l_partkey % 7])::BIGINT AS dst FROM lineitem),
ns AS (SELECT DISTINCT graph, n FROM (SELECT graph, src AS n FROM e UNION ALL SELECT graph, dst FROM e)),
r AS (SELECT DISTINCT graph, 0::BIGINT AS cut, 1::BIGINT AS n FROM e UNION SELECT graph, n, 1::BIGINT FROM ns WHERE n <> 1 UNION SELECT r.graph, r.cut, e.dst FROM r JOIN e ON e.graph = r.graph AND e.src = r.n WHERE e.dst <> r.cut),
live AS (SELECT graph, n FROM r WHERE cut = 0),
doms AS (SELECT a.graph, a.n, b.n AS dom FROM live a JOIN live b ON a.graph = b.graph WHERE b.n = 1 OR a.n = b.n OR NOT EXISTS (SELECT 1 FROM r WHERE r.graph = a.graph AND r.cut = b.n AND r.n = a.n)),
deep AS (SELECT graph, n, count(*) - 1 AS depth FROM doms GROUP BY ALL)
SELECT d.graph, d.n AS id, max(CASE WHEN p.depth = d.depth - 1 THEN o.dom END) AS idom, d.depth FROM deep d JOIN doms o ON o.graph = d.graph AND o.n = d.n JOIN deep p ON p.graph = o.graph AND p.n = o.dom GROUP BY d.graph, d.n, d.depth""",
    "hot_enclosing": f"WITH h AS (SELECT *, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END)::BIGINT AS file FROM orders), f AS (SELECT file, {', '.join(HOT_SPANS)} FROM h), s AS (SELECT DISTINCT file, o_orderkey * 37 % 1000003 AS line FROM h) SELECT file, line, arg_min(name, (start_line, name)) AS name FROM s JOIN f USING (file) WHERE line BETWEEN start_line AND end_line GROUP BY file, line",
    "hot_overlapping": f"WITH h AS (SELECT *, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END)::BIGINT AS file FROM orders), f AS (SELECT file, {', '.join(HOT_SPANS)} FROM h), c AS (SELECT file, o_orderkey * 41 % 1000003 AS change_start, o_orderkey * 41 % 1000003 + o_custkey % 20 AS change_end FROM h) SELECT file, name, change_start, change_end FROM c JOIN f USING (file) WHERE change_start <= end_line AND change_end >= start_line",
    "enclosing_function": "WITH f AS (SELECT o_custkey % 100 AS file, o_orderkey AS name, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_custkey % 50 AS b FROM orders), s AS (SELECT DISTINCT p_partkey % 100 AS file, p_size::BIGINT AS line FROM part) SELECT file, line, name FROM (SELECT s.file, s.line, name, row_number() OVER (PARTITION BY s.file, s.line ORDER BY a, name) AS r FROM s JOIN f ON s.file = f.file AND s.line BETWEEN a AND b) WHERE r = 1",
    "overlapping_symbols": "WITH f AS (SELECT o_custkey % 100 AS file, o_orderkey AS name, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_custkey % 50 AS b FROM orders), c AS (SELECT s_suppkey % 100 AS file, s_suppkey * 37 % 1000 AS x, s_suppkey * 37 % 1000 + 5 AS y FROM supplier) SELECT f.file, f.name, x AS change_start, y AS change_end FROM c JOIN f ON c.file = f.file AND x <= b AND y >= a",
    "graph_dot": f"WITH {_C} SELECT 0 AS part, 'digraph G {{' AS line UNION ALL SELECT 1, '  \"' || p_partkey || '\" [label=\"' || p_name || '\"];' FROM part UNION ALL SELECT 2, '  \"' || src || '\" -> \"' || dst || '\";' FROM c UNION ALL SELECT 3, '}}'",
    "graph_mermaid": f"WITH {_C} SELECT 0 AS part, 'graph TD' AS line UNION ALL SELECT 1, '  ' || p_partkey || '[' || p_name || ']' FROM part UNION ALL SELECT 2, '  ' || src || ' --> ' || dst FROM c",
    "graph_json": f"""WITH {_C} SELECT 1 AS part, '{{"id":"' || p_partkey || '","label":"' || p_name || '"}}' AS line FROM part UNION ALL SELECT 2, '{{"src":"' || src || '","dst":"' || dst || '"}}' FROM c""",
    "graph_communities": f"WITH {_E}, {_LPA(12)} SELECT c AS community, count(*)::BIGINT AS n FROM l12 GROUP BY c HAVING count(*) >= 2",
    "graph_reach_filtered": f"WITH {_E}, {_V}, s AS (SELECT 'c' || c_custkey AS start, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0), w AS (SELECT start, start AS id, 0 AS distance FROM s UNION ALL SELECT start, n, 1 FROM s UNION ALL SELECT start, r, 2 FROM s) SELECT start, id, distance, name FROM (SELECT * FROM w ORDER BY start, distance, id LIMIT 100) JOIN v USING (id)",
    "graph_match": "SELECT 'p' || l_partkey AS n0, 'n' || s_nationkey AS n2, count(*)::BIGINT AS n_suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "graph_find": "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "graph_where": f"WITH {_V} SELECT id, tag FROM v WHERE tag IN ('Customer', 'Supplier') AND contains(name, '7') AND regexp_matches(id, '^[cs]1')",
    "graph_path_ends": "SELECT 'r' || r_regionkey AS id, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE p_name LIKE 'red%' AND r_name LIKE 'A%' GROUP BY 1",
    "graph_distances": """WITH x AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS n, n_regionkey AS r, 0 AS up FROM nation UNION ALL SELECT 's' || s_suppkey, n_nationkey, n_regionkey, 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT a.id AS start, b.id, (a.up + b.up + CASE WHEN a.n = b.n THEN 0 ELSE 2 END)::INT AS distance FROM x a JOIN x b ON a.r = b.r AND a.id <> b.id""",
    "graph_analysis": f"""WITH {_E}, s AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0), a AS (SELECT id FROM s UNION SELECT dst FROM e JOIN s ON s.id = src), b AS (SELECT id FROM a UNION SELECT dst FROM e JOIN a ON a.id = src), i AS (SELECT e.* FROM e WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b))
SELECT (SELECT count(*) FROM b)::BIGINT AS n_nodes, count(*)::BIGINT AS n_edges, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS avg_degree, (SELECT count(*) FROM b WHERE id LIKE 'r%')::BIGINT AS n_components, count(*) FILTER (WHERE type = 'BELONGS_TO')::BIGINT AS n_belongs, greatest(0, (count(*) - (SELECT count(*) FROM b)) // 2)::BIGINT AS cyclic FROM i""",
    "graph_dependencies": "SELECT 'n' || n_nationkey AS start, 'direct' AS kind, 1::BIGINT AS n FROM nation",
    "graph_dependents": "WITH a AS (SELECT 'n' || s_nationkey AS start, 's' || s_suppkey AS id, 'direct' AS kind FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'direct' FROM customer UNION SELECT 'n' || s_nationkey, 'p' || l_partkey, 'transitive' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT start, kind, count(*)::BIGINT AS n FROM a GROUP BY ALL",
    "graph_neighbours": f"WITH {_C} SELECT coalesce(a.src, b.dst) AS id, s AS successors, p AS predecessors FROM (SELECT src, string_agg(dst, ',' ORDER BY dst) AS s FROM c GROUP BY src) a FULL JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) AS p FROM c GROUP BY dst) b ON a.src = b.dst",
    "graph_references": "SELECT p_size::BIGINT AS wanted, p_partkey AS id FROM part WHERE p_size < 25 UNION SELECT p_partkey % 11, p_partkey FROM part UNION SELECT s_nationkey::BIGINT, s_suppkey FROM supplier",
    "graph_node_types": f"WITH {_V} SELECT CASE tag WHEN 'Part' THEN 'file' WHEN 'Region' THEN 'project' ELSE tag END AS kind, count(*)::BIGINT AS n FROM v GROUP BY 1",
    "graph_overview": f"WITH {_E}, {_V} SELECT 'node' AS part, id AS a, NULL::VARCHAR AS b FROM (SELECT id FROM v ORDER BY id LIMIT 100) UNION ALL SELECT 'edge', src, dst FROM (SELECT * FROM e ORDER BY src, dst, type LIMIT 200)",
    "taint_reach": f"WITH RECURSIVE {_C}, t AS (SELECT p_partkey AS id FROM part WHERE p_size = 50 UNION SELECT c.dst FROM t JOIN c ON c.src = t.id WHERE c.dst > c.src) SELECT id FROM t",
    "def_use_flows": "SELECT 'r' || n_regionkey AS to_id, count(*)::BIGINT AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 GROUP BY 1",
}
