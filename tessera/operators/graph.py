"""Graph analytics over edge tables (src, dst, ...).

Loops run on the driver, a join and an aggregation a step; between steps a written table cuts the lineage, so a lost
executor costs a step at most. Neighbours are only ever aggregated with partial sums on the map side, so a node
of very many edges is no burden. Paths are bounded in length and never revisit a node.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _place(spark: SparkSession) -> str:
    """The path of a new step in the cluster's shared folder.

    Where no folder is set, one of its own on a single machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    if ":" not in folder:
        folder = f"file://{folder}"
    _steps.append(f"{folder.rstrip('/')}/tessera/step-{uuid.uuid4().hex}")
    return _steps[-1]


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared folder, worked out once; lineage ends there."""
    path = _place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The tables of steps that this driver has written, and the names of those in buckets.
_steps: list[str] = []
_named: list[str] = []
#: Rows that a bucket of edges has, about; there are as many buckets as partitions of a shuffle at least.
BUCKET = 1 << 20


def _buckets(df: DataFrame) -> int:
    """How many buckets the rows of a written table and as many again fill."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.count() // BUCKET)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """As ``saved``, in n buckets by ``key``: what is joined or grouped by it is not shuffled again, however often it is read."""
    path = _place(df.sparkSession)
    name = f"tessera_{path[-32:]}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    _named.append(name)
    return df.sparkSession.table(name)


def forget(spark: SparkSession) -> int:
    """Removes the tables of all steps so far, and says how many. Results that are not written yet may still read them."""
    n = len(_steps)
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _steps:
        where = spark._jvm.org.apache.hadoop.fs.Path(_steps.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def typed(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("type").isin(types)) if types else edges


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(id, k), (src, dst) by number, and a number of buckets: the nodes with numbers in the order of their ids, and the edges both ways, each once, in buckets by dst.

    Numbers are shorter than ids, and rounds that join edges with what their ends hold shuffle no edges. A node's edges
    lie in one bucket, on disk. Edges that lack an end are left out.
    """
    e = saved(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    n = _buckets(e)
    names = saved(nodes(e).repartitionByRange(n, "id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("k")))
    end = lambda side, k: names.select(F.col("id").alias(side), F.col("k").alias(k)).hint("shuffle_hash")
    pairs = e.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    return names, bucketed(ways.repartition(n, "dst").distinct(), "dst", n), n


def hop(front: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, id) one step further on, each once."""
    return front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("start", F.col("dst").alias("id")).distinct()


def k_hop(starts: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(start, id) at the end of some walk of exactly k edges."""
    front, edges = starts.select(F.col("id").alias("start"), "id"), saved(edges.select("src", "dst").distinct())
    for _ in range(k):
        front = hop(front, edges)
    return front


def reach(starts: DataFrame, edges: DataFrame, depth: int = 3, where: Column | None = None, most: int | None = None) -> DataFrame:
    """(start, id, distance) of all nodes within ``depth`` edges, the start at 0; by edges that meet ``where``, the first ``most`` by start, distance and id."""
    edges = saved((edges if where is None else edges.where(where)).select("src", "dst").distinct())
    front = starts.select(F.col("id").alias("start"), "id").distinct()
    seen = front.withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        new = hop(front, edges).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = saved(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("distance", F.lit(d)))
    return seen if most is None else seen.orderBy("start", "distance", "id").limit(most)


def with_properties(reached: DataFrame, vertices: DataFrame, *names: str) -> DataFrame:
    """What was reached, with properties of its vertices (id, properties)."""
    props = vertices.select("id", *[F.col("properties")[n].alias(n) for n in names])
    return reached.join(props, "id", "left")


def dependencies(starts: DataFrame, edges: DataFrame, depth: int = 3, inward: bool = False) -> DataFrame:
    """(start, id, distance, kind): what the starts depend on, or what depends on them: direct at one edge, transitive beyond."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if inward else edges
    return reach(starts, e, depth).where("distance > 0").withColumn("kind", F.when(F.col("distance") == 1, "direct").otherwise("transitive"))


#: The edges that each focus of an analysis follows; none named are all.
FOCUS = {"dependencies": ["IMPORTS", "CONTAINS"], "calls": ["CALLS"], "hierarchy": ["BELONGS_TO", "CONTAINS"]}


def analysis(starts: DataFrame, edges: DataFrame, focus: str | None = None, depth: int = 3) -> DataFrame:
    """One row on the part of the graph within ``depth`` edges of the starts: nodes, edges, mean degree, components, and edges of each type as a map."""
    near = reach(starts, typed(edges, FOCUS.get(focus)), depth).select("id").distinct()
    inside = typed(edges, FOCUS.get(focus)).join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    inside = saved(inside.select("type", "src", "dst"))
    kinds = inside.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    joined = components(inside).select("id", "component")
    alone = near.join(joined.select("id"), "id", "left_anti").agg(F.count("*").alias("n_alone"))
    parts = joined.agg(F.count_distinct("component").alias("n_joined"))
    got = summary(near, inside).crossJoin(parts).crossJoin(alone).crossJoin(kinds)  # a row each
    return got.select("n_nodes", "n_edges", "avg_degree", (F.col("n_joined") + F.col("n_alone")).alias("n_components"), "by_type")


def find(vertices: DataFrame, label: str | None = None, **properties) -> DataFrame:
    """Vertices (id, tag, properties) of a tag with these properties."""
    found = vertices if label is None else vertices.where(F.col("tag") == label)
    for name, value in properties.items():
        found = found.where(F.col("properties")[name] == value)
    return found


OPERATORS = {"==": lambda c, v: c == v, "IN": lambda c, v: c.isin(list(v)), "CONTAINS": lambda c, v: F.contains(c, F.lit(v)), "=~": lambda c, v: c.rlike(v)}


def where(*conditions: tuple[str, str, object]) -> Column:
    """The conjunction of (field, operator, value); of none, everything."""
    test = F.lit(True)
    for field, operator, value in conditions:
        test = test & OPERATORS[operator](F.col(field), value)
    return test


def match(vertices: DataFrame, edges: DataFrame, *pattern: str) -> DataFrame:
    """(n0, n1, ...): the ids along each walk whose vertices have the tags and whose edges the types of ``pattern``, such as ("Part", "SOLD_BY", "Supplier"). A tag or type of "" is any."""
    of = lambda k: vertices.where(F.col("tag") == pattern[k]) if pattern[k] else vertices
    walks = of(0).select(F.col("id").alias("n0"))
    for k in range(1, len(pattern), 2):
        step = (edges.where(F.col("type") == pattern[k]) if pattern[k] else edges).select(F.col("src").alias(f"n{k // 2}"), F.col("dst").alias(f"n{k // 2 + 1}"))
        walks = walks.join(step, f"n{k // 2}").join(of(k + 1).select(F.col("id").alias(f"n{k // 2 + 1}")), f"n{k // 2 + 1}")
    return walks.select(*[f"n{k}" for k in range((len(pattern) + 1) // 2)])


def twins(edges: DataFrame, others: DataFrame) -> DataFrame:
    """(id, like): each node, and each id of ``others``, with the least node that has the same nodes before it and the same behind it.

    They are compared by the number of these nodes and sums of their hashes, 128 bits each way, so a node of very many edges is no burden.
    """
    h = lambda c, seed: F.xxhash64(F.lit(seed), F.col(c)).cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    ends = edges.select(F.col("src").alias("id"), *[h("dst", k).alias(f"h{k}") for k in (0, 1)], *[zero.alias(f"h{k}") for k in (2, 3)], F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(edges.select(F.col("dst"), zero, zero, h("src", 2), h("src", 3), F.lit(0), F.lit(1)))
    ends = ends.union(others.select("id", *[zero] * 4, F.lit(0), F.lit(0)))
    marks = ends.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("h0", "h1", "h2", "h3", "o", "i")])
    kind = marks.select("id", F.sha2(F.concat_ws(",", "h0", "h1", "h2", "h3", "o", "i"), 256).alias("mark"))
    return kind.join(kind.groupBy("mark").agg(F.min("id").alias("like")), "mark").select("id", "like")


#: Parts that the pairs of two large classes of nodes are dealt over.
DEALT = 32


def distances(ids: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(start, id, distance) between all pairs of the given ids that are at most ``depth`` edges apart.

    Nodes that the same edges enter and leave are as far from all others, and each pair of them is as far apart as any.
    So two of each such class stand for it, and their distances are dealt out to all pairs at the end: nothing but the
    result grows with the pairs. Two-hop labels: each id knows the nodes up to half the depth ahead of it and, against
    the edges, up to half behind it. A shortest path has a middle, which its start knows as far ahead as its end knows
    it behind, or one edge farther; so pairs meet at such nodes, and nothing is searched over the whole depth. A node
    with one neighbour is inside of no shortest path, so only ends are such.
    """
    edges = saved(edges.select("src", "dst").where("src <> dst").distinct())
    asked = ids.select("id").distinct()
    classes = saved(twins(edges, asked))
    members = saved(classes.join(asked, "id"))
    first = members.groupBy("like").agg(F.min("id").alias("one"))
    second = members.join(first, "like").where("id <> one").groupBy("like").agg(F.min("id").alias("two"))
    stand = saved(first.join(second, "like", "left"))
    ends = saved(stand.select(F.col("one").alias("id")).union(stand.where("two IS NOT NULL").select("two")))
    kept = classes.where("id = like").select("id").union(ends).distinct()
    small = saved(edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    many = both_ways(small).distinct().groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select(F.col("src").alias("dst"))
    inner = saved(small.join(many, "dst", "left_semi").select("src", "dst"))
    back = small.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(many, "dst", "left_semi")
    direct = small.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.lit(1).alias("distance"))
    ahead = saved(reach(ends, inner, (depth + 1) // 2)).select("start", F.col("id").alias("mid"), F.col("distance").alias("a"))
    behind = saved(reach(ends, back, depth // 2)).select(F.col("start").alias("id"), F.col("id").alias("mid"), F.col("distance").alias("b"))
    met = ahead.join(behind, "mid").where("start <> id AND (a = b OR a = b + 1)").select("start", "id", (F.col("a") + F.col("b")).alias("distance"))
    near = saved(met.union(direct.where(F.lit(depth > 0))).groupBy("start", "id").agg(F.min("distance").alias("distance")))
    # From those that stand for a class to all of it: between classes by the first of each, within one by its first two.
    between = near.join(stand.select(F.col("one").alias("start"), F.col("like").alias("from")), "start").join(stand.select(F.col("one").alias("id"), F.col("like").alias("to")), "id").select("from", "to", "distance")
    within = near.join(stand.select(F.col("one").alias("start"), F.col("two").alias("id"), "like"), ["start", "id"]).select(F.col("like").alias("from"), F.col("like").alias("to"), "distance")
    starts = members.select(F.col("id").alias("start"), F.col("like").alias("from")).join(between.union(within), "from").withColumn("_deal", F.pmod(F.xxhash64("start"), F.lit(DEALT)))
    others = members.select("id", F.col("like").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("_deal"))
    return starts.join(others.hint("merge"), ["to", "_deal"]).where("start <> id").select("start", "id", "distance")


def resolved_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, caller, callee): call sites (file, line, name) joined with the last definition (name, file, start_line, seq) of the name and the function around the site."""
    last = functions.groupBy("name").agg(F.max_by(F.concat_ws("#", "file", "name"), "seq").alias("callee"))
    around = enclosing(sites.select("file", "line").distinct(), functions).select("file", "line", F.concat_ws("#", "file", "name").alias("caller"))
    return sites.join(last, "name").join(around, ["file", "line"]).select("file", "line", "caller", "callee")


def references(rows: DataFrame, hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id): rows (id, refs array) that refer to a wanted id, and hits (wanted, id) of the graph, each once."""
    held = rows.select("id", F.explode("refs").alias("wanted")).join(wanted.select(F.col("id").alias("wanted")), "wanted", "left_semi")
    return held.select("wanted", "id").union(hits.select("wanted", "id")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, successors, predecessors) as sorted arrays."""
    names = lambda side, other, out: edges.groupBy(F.col(side).alias("id")).agg(F.sort_array(F.collect_set(other)).alias(out))
    return names("src", "dst", "successors").join(names("dst", "src", "predecessors"), "id", "full_outer")


def node_type(label: Column, kind: Column) -> Column:
    """A label with a dot is a file; else the type given, else a project."""
    return F.when(F.contains(label, F.lit(".")), "file").otherwise(F.coalesce(kind, F.lit("project")))


def cyclic_estimate(n_nodes: Column, n_edges: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((n_edges - n_nodes) / 2)).cast("long")


def cyclomatic(n_nodes: Column, n_edges: Column) -> Column:
    return n_edges - n_nodes + 2


def overview(vertices: DataFrame, edges: DataFrame, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id and the first edges by their ends, for a picture."""
    return vertices.orderBy("id").limit(most_nodes), edges.orderBy("src", "dst", "type").limit(most_edges)


def flows(defs: DataFrame, uses: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, from_id, to_id): definitions (id, name) and the uses (id, name) of the same name that are reached along the flow edges."""
    used = uses.select("name").distinct()
    starts = defs.join(used, "name", "left_semi").select("id").distinct()
    # Only what leads from a definition to a use is walked. The edges stand in buckets, as many as they fill, so that no
    # task holds more the larger the graph is; of them those stay that leave what the definitions reach, each once.
    edges = saved(edges.select("src", "dst"))
    step = bucketed(edges, "src", _buckets(edges))
    ahead = _spread(starts, step.select(F.col("src").alias("id"), "dst"))
    near = saved(step.join(ahead.select(F.col("id").alias("src")), "src", "left_semi").distinct())
    useful = closure(uses.select("id"), near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("id").alias("dst"))
    met = reach(starts, near.join(useful, "dst", "left_semi"), 1 << 30).select(F.col("start").alias("from_id"), F.col("id").alias("to_id"))
    got = met.join(defs.select(F.col("id").alias("from_id"), "name"), "from_id").join(uses.select(F.col("id").alias("to_id"), F.col("name").alias("used")), "to_id")
    return got.where("name = used AND from_id <> to_id").select("name", "from_id", "to_id")


def impact(changed: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Who depends on the changed nodes: reach against the edges."""
    return reach(changed, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth)


def paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(path, id): simple paths of 1 to ``depth`` edges."""
    step = edges.select(F.col("src").alias("id"), "dst").distinct()
    front = starts.select(F.array("id").alias("path"), "id")
    out = None
    for _ in range(depth):
        front = front.join(step, "id").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"))
        out = front if out is None else out.union(front)
    return out


def shortest_path(source, target, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(distance, path) of the shortest path; of several the least by order of its nodes. No row if there is none.

    Breadth first, keeping the least path to each new node: a prefix of a least shortest path is one itself.
    """
    step = edges.select(F.col("src").alias("id"), "dst").distinct()
    front = step.sparkSession.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"))
    seen = front
    for _ in range(depth):
        hit = seen.where(F.col("id") == F.lit(target))
        if not hit.isEmpty():
            break
        further = front.join(step, "id").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = saved(further.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where(F.col("id") == F.lit(target)).select((F.size("path") - 1).cast("long").alias("distance"), "path")


def _halves(front: DataFrame, step: DataFrame, most: int, keep: Column | None = None) -> list[DataFrame]:
    """Simple paths (path, first, last) of 0, 1, ... ``most`` edges (src, dst) on from ``front``."""
    out = [front]
    for _ in range(most):
        grown = out[-1].join(step.select(F.col("src").alias("last"), "dst"), "last").where(~F.array_contains("path", F.col("dst")))
        grown = grown if keep is None else grown.where(keep)
        out.append(saved(grown.select(F.concat("path", F.array("dst")).alias("path"), "first", F.col("dst").alias("last"))))
    return out


def _joined(ahead: DataFrame, behind: DataFrame, on: list[str], closed: bool) -> DataFrame:
    """(path) of halves that end in the same node and share no other; ``closed``: both begin in the same node, which is given once."""
    back = behind.select(*[c for c in on if c != "last"], "last", F.col("path").alias("behind"))
    rest = F.slice(F.reverse("behind"), 2, F.greatest(F.size("behind") - (2 if closed else 1), F.lit(0)))
    inner = F.slice("path", 2, F.size("path") - 1) if closed else F.col("path")
    return ahead.join(back, on).where(~F.arrays_overlap(inner, rest)).select(F.concat("path", rest).alias("path"))


def all_paths(source, target, edges: DataFrame, depth: int = 5, most: int = 10) -> DataFrame:
    """(length, path): simple paths between two nodes, by length, then by their nodes; the first ``most``.

    Lengths are tried in turn until there are enough paths. Those of a length are made of two halves that meet in the
    middle, one from either end, each kept to nodes from which the other end is near enough.
    """
    step = saved(edges.select("src", "dst").where("src <> dst").distinct())
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kind = step.schema["src"].dataType
    one = lambda x: step.sparkSession.range(1).select(F.lit(x).cast(kind).alias("id"))
    near, far = saved(closure(one(source), step, depth)), saved(closure(one(target), back, depth))
    close = near.join(far.withColumnRenamed("distance", "left"), "id").where(F.col("distance") + F.col("left") <= depth).select("id")
    step = saved(step.join(close.withColumnRenamed("id", "src"), "src", "left_semi").join(close.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    begin = lambda x: one(x).select(F.array("id").alias("path"), F.col("id").alias("first"), F.col("id").alias("last"))
    ahead, behind = [begin(source)], [begin(target)]
    found, n = None, 0
    if source == target:
        depth = 0
    for length in range(1, depth + 1):
        h = length // 2
        if len(ahead) <= length - h:
            ahead += _halves(ahead[-1], step.where(F.col("dst") != F.lit(source)), 1)[1:]
        if len(behind) <= h:
            behind += _halves(behind[-1], back.where(F.col("dst") != F.lit(target)), 1)[1:]
        got = saved(_joined(ahead[length - h], behind[h], ["last"], False).select(F.lit(length).cast("long").alias("length"), "path"))
        found = got if found is None else found.union(got)
        n += got.count()
        if n >= most:
            break
    if found is None:
        found = begin(source).select(F.lit(0).cast("long").alias("length"), "path").limit(0)
    return found.orderBy("length", "path").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable, edges taken both ways.

    Every node takes the least label among its own and its neighbours', and labels are followed to their own labels,
    so the distance that a label travels doubles with each round.
    """
    names, e, n = numbered(edges)
    least = lambda label: e.join(label.select(F.col("id").alias("dst"), "component").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
    label = bucketed(e.groupBy(F.col("dst").alias("id")).agg(F.least(F.col("dst"), F.min("src")).alias("component")), "id", n)
    while True:
        lower = bucketed(label.join(least(label), "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component")), "id", n)
        parent = lower.select(F.col("id").alias("component"), F.col("component").alias("grand"))
        new = bucketed(lower.join(parent, "component").select("id", "before", F.least("component", "grand").alias("component")), "id", n)
        if new.where("component <> before").isEmpty():
            break
        label = new
    named = new.select("component").distinct().join(names.select(F.col("k").alias("component"), F.col("id").alias("named")), "component")
    return new.select(F.col("id").alias("k"), "component").join(named, "component").join(names, "k").select("id", F.col("named").alias("component"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): ranks sum to 1; nodes without edges out share theirs among all."""
    e = saved(edges.select("src", "dst"))
    out = e.groupBy("src").agg(F.count("*").alias("n_out"))
    every = saved(nodes(e).join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = every.count()
    ranks = every.select("id", "n_out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(iterations):
        share = ranks.where("n_out IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("n_out")).alias("share"))
        given = e.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("given"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("n_out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = (1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)
        ranks = every.join(given, "id", "left").crossJoin(F.broadcast(lost)).select("id", "n_out", rank.alias("rank"))  # one row
        if k % 4 == 3:
            ranks = saved(ranks)
    return ranks.select("id", "rank")


def communities(edges: DataFrame, iterations: int | None = None, least: int = 2) -> DataFrame:
    """(id, community) by synchronous label propagation (not Louvain): each node takes its neighbours' most frequent label, of several the least; groups under ``least`` are left out.

    It ends when no label changes, or when two states follow each other in turn, as in bipartite graphs: then with the
    one after an even number of rounds. ``iterations`` bounds the rounds, whatever has been reached by then.
    """
    names, e, n = numbered(edges)
    label, k = bucketed(names.select(F.col("k").alias("id"), F.col("k").alias("community"), *[F.lit(None).cast("long").alias(c) for c in ("before", "older")]), "id", n), 0
    final = "community"
    while iterations is None or k < iterations:
        # Votes travel once, by the node that they are for; edges and labels stay where they are.
        votes = e.join(label.select(F.col("id").alias("dst"), "community").hint("shuffle_hash"), "dst").select(F.col("src").alias("id"), "community").repartition(n, "id")
        best = votes.groupBy("id", "community").agg(F.count("*").alias("n")).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best"))
        last = label.select("id", F.col("community").alias("before"), F.col("before").alias("older"))
        label, k = bucketed(best.join(last.hint("shuffle_hash"), "id").select("id", "best.community", "before", "older"), "id", n), k + 1
        if label.where("community <> before").isEmpty():
            break
        if k > 1 and label.where("community <> older").isEmpty():
            final = "community" if k % 2 == 0 else "before"
            break
    label = label.select("id", F.col(final).alias("community"))
    size = label.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    named = size.join(names.select(F.col("k").alias("community"), F.col("id").alias("named")), "community").select("community", "named")
    return label.withColumnRenamed("id", "k").join(named, "community").join(names, "k").select("id", F.col("named").alias("community"))


def cycles(edges: DataFrame, most: int = 5, compat: bool = False) -> DataFrame:
    """(length, cycle) of simple cycles up to ``most`` edges. Each is given once, from its least node on; with ``compat`` once from each of its nodes.

    A cycle is two halves from its first node, along and against the edges, that meet in the middle.
    """
    step = saved(edges.where("src <> dst").select("src", "dst").distinct())
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = edges.where("src = dst").select(F.lit(1).alias("length"), F.array("src").alias("cycle")).distinct()
    # Only nodes that an edge enters and leaves are on cycles.
    first = step.select(F.col("src").alias("id")).join(step.select(F.col("dst").alias("id")), "id", "left_semi").distinct()
    begin = first.select(F.array("id").alias("path"), F.col("id").alias("first"), F.col("id").alias("last"))
    keep = None if compat else F.col("dst") > F.col("first")
    ahead, behind = _halves(begin, step, (most + 1) // 2, keep), _halves(begin, back, most // 2, keep)
    for n in range(2, most + 1):
        got = _joined(ahead[(n + 1) // 2], behind[n // 2], ["first", "last"], True)
        found = found.union(got.select(F.lit(n).alias("length"), F.col("path").alias("cycle")))
    return found


def entry_points(functions: DataFrame) -> DataFrame:
    """Functions (name, exported) where a program may start."""
    return functions.where(F.col("exported") | F.lower("name").isin("main", "start"))


def dead_code(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that nothing calls and that are neither entry nor export."""
    quiet = functions.where(~(F.col("exported") | F.lower("name").isin("main", "start")))
    return quiet.join(calls.select(F.col("callee").alias("name")), "name", "left_anti")


def closure(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, distance) of all that can be reached, breadth first from all starts at once, until nothing new comes or ``most`` edges on."""
    return _spread(starts, saved(edges.select(F.col("src").alias("id"), "dst").distinct()), most)


def _spread(starts: DataFrame, step: DataFrame, most: int | None = None) -> DataFrame:
    """``closure`` along written edges (id, dst)."""
    front = seen = saved(starts.select("id").distinct().withColumn("distance", F.lit(0)))
    d = 0
    while most is None or d < most:
        d += 1
        front = saved(front.join(step, "id").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if d % 8 == 0:
            seen = saved(seen)
    return seen


def depth(entries: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """The largest distance from an entry point, breadth first from all entries at once."""
    return closure(entries, edges, most).agg(F.coalesce(F.max("distance"), F.lit(0)).cast("long").alias("depth"))


def risk(n_in: Column, n_out: Column, complexity: Column) -> Column:
    """How risky a change to a function is."""
    high = (complexity > 10) | (n_in > 5) | (n_out > 10)
    return F.when(high, "high").when((complexity > 5) | (n_in > 2) | (n_out > 5), "medium").otherwise("low")


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, avg_degree)."""
    n, m = vertices.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    both = n.crossJoin(m)  # a row each
    return both.withColumn("avg_degree", F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1)))


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by tag and edges by type, with totals as null names."""
    v = vertices.rollup("tag").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("tag").alias("name"), "n")
    e = edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n")
    return v.union(e)


def dominator_tree(root, edges: DataFrame) -> DataFrame:
    """(id, idom, depth): what can be reached from the root, a row a node, with its immediate dominator (null for the root) and its depth in the tree of these.

    It begins with a tree of first paths. As long as a node's parent is not the nearest common ancestor of all nodes
    before it, it becomes that; the tree in which no parent changes is that of the dominators. Nodes that lead nowhere
    dominate nothing but themselves, so they are left out of these rounds and hung into the tree at the end.
    """
    e = saved(edges.select("src", "dst").where((F.col("src") != F.col("dst")) & (F.col("dst") != F.lit(root))).distinct())
    kind = e.schema["src"].dataType
    leading = saved(e.select(F.col("src").alias("dst")).distinct())
    inner = saved(e.join(leading, "dst", "left_semi").select("src", "dst"))
    tree = front = saved(e.sparkSession.range(1).select(F.lit(root).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(0).cast("long").alias("depth")))
    d = 0
    while not front.isEmpty():
        d += 1
        new = front.select(F.col("id").alias("src")).join(inner, "src").groupBy("dst").agg(F.min("src").alias("parent"))
        front = saved(new.select(F.col("dst").alias("id"), "parent", F.lit(d).cast("long").alias("depth")).join(tree.select("id"), "id", "left_anti"))
        tree = saved(tree.union(front)) if d % 8 == 0 else tree.union(front)
    tree = saved(tree)
    inner = saved(inner.join(tree.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    while True:
        # The nodes that lead to a node, and its parent.
        before = inner.select(F.col("dst").alias("id"), F.col("src").alias("at")).union(tree.where("parent IS NOT NULL").select("id", F.col("parent").alias("at"))).distinct()
        moved = saved(tree.join(_met(before, tree, _buckets(inner)), "id", "left").select("id", "parent", F.coalesce("new", "parent").alias("new")))
        if moved.where("new <> parent").isEmpty():
            break
        tree = _depths(moved.select("id", F.col("new").alias("parent")))
    ends = e.join(leading, "dst", "left_anti").select(F.col("dst").alias("id"), F.col("src").alias("at"))
    hung = _met(ends, tree, _buckets(e)).join(tree.select(F.col("id").alias("new"), "depth"), "new").select("id", F.col("new").alias("idom"), (F.col("depth") + 1).alias("depth"))
    return tree.select("id", F.col("parent").alias("idom"), "depth").union(hung)


def _met(pairs: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """(id, new): the nearest common ancestor, in a tree (id, parent, depth), of the nodes of it that an id is paired with (id, at), each pair once.

    Ancestors are met by depth: of the nodes that an id has come up to, the deepest step up, until one is left. They
    stand in buckets by id, so that only steps up are shuffled.
    """
    above = tree.select(F.col("id").alias("at"), "parent", "depth")
    done = None
    while True:
        met = bucketed(pairs.join(above, "at"), "id", n)
        spread = met.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.min("at").alias("new"))
        alone = spread.where("n = 1").select("id", "new")
        done = alone if done is None else done.union(alone)
        up = F.when(F.col("depth") == F.col("deepest"), F.col("parent")).otherwise(F.col("at"))
        pairs = met.join(spread.where("n > 1").select("id", "deepest").hint("shuffle_hash"), "id").select("id", up.alias("at")).distinct()
        if spread.where("n > 1").isEmpty():
            return done


def _depths(tree: DataFrame) -> DataFrame:
    """(id, parent, depth) of a tree (id, parent), by doubling the steps up."""
    jump = saved(tree.select("id", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not jump.where("up IS NOT NULL").isEmpty():
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        jump = saved(jump.join(far, "up", "left").select("id", "parent", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return jump.select("id", "parent", "depth")


def dominators(root, edges: DataFrame) -> DataFrame:
    """(id, dominators): nodes on every path from the root, itself included, as a sorted array: the ancestors in the tree of immediate dominators, of which ``dominator_tree`` has one a node."""
    tree = saved(dominator_tree(root, edges))
    out = level = tree.where("idom IS NULL").select("id", F.array("id").alias("dominators"))
    d = 0
    while True:  # those of a node are those of the one above it, and itself
        d += 1
        here = tree.where(F.col("depth") == d).select("id", F.col("idom").alias("up"))
        level = saved(here.join(level.withColumnRenamed("id", "up"), "up").select("id", F.concat("dominators", F.array("id")).alias("dominators")))
        if level.isEmpty():
            return out.select("id", F.sort_array("dominators").alias("dominators"))
        out = out.union(level)


def _idoms(top, pairs: list) -> list[tuple]:
    """(id, idom, depth) of one graph: a numbering by depth-first search, then meets by number until nothing changes."""
    ahead, before = {}, {}
    for a, b in pairs:
        if b != top and a != b:
            ahead.setdefault(a, []).append(b)
    number, order, stack = {top: -1}, [], [(top, iter(ahead.get(top, ())))]
    while stack:  # a node is numbered behind all that it leads to
        a, rest = stack[-1]
        b = next((b for b in rest if b not in number), None)
        if b is None:
            number[a] = len(order)
            order.append(a)
            stack.pop()
        else:
            number[b] = -1
            stack.append((b, iter(ahead.get(b, ()))))
    for a in order:
        for b in ahead.get(a, ()):
            before.setdefault(b, []).append(a)

    def meet(x, y):
        while x != y:  # of two nodes the one with the smaller number is deeper
            x, y = (idom[x], y) if number[x] < number[y] else (x, idom[y])
        return x

    idom, changed = {top: top}, True
    while changed:
        changed = False
        for b in reversed(order[:-1]):
            new = functools.reduce(meet, (a for a in before[b] if a in idom))
            changed |= idom.get(b) != new
            idom[b] = new
    depth = {top: 0}
    for b in reversed(order[:-1]):
        path = [b]
        while path[-1] not in depth:
            path.append(idom[path[-1]])
        for k, x in enumerate(reversed(path)):
            depth.setdefault(x, depth[path[-1]] + k)
    return [(b, None if b == top else idom[b], depth[b]) for b in reversed(order)]


def dominator_trees(edges: DataFrame, root: str = "root", by: str = "graph") -> DataFrame:
    """(graph, id, idom, depth) for many graphs (graph, root, src, dst), such as the control flow of each function: a graph's edges are gathered in one row, so it is as large as its function."""
    kind = edges.schema["src"].dataType.simpleString()

    def trees(tops: pd.Series, graphs: pd.Series) -> pd.Series:
        return pd.Series([[{"id": a, "idom": b, "depth": d} for a, b, d in _idoms(top, [(e["src"], e["dst"]) for e in g])] for top, g in zip(tops, graphs, strict=True)], dtype=object)

    gathered = edges.groupBy(by, root).agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("e"))
    tree = F.pandas_udf(trees, f"array<struct<id:{kind},idom:{kind},depth:bigint>>")(F.col(root), F.col("e"))
    return gathered.select(by, F.explode(tree).alias("t")).select(by, "t.*")


def ranked(ranks: DataFrame, k: int = 10, score: str = "rank") -> DataFrame:
    """The k best with their place."""
    best = ranks.orderBy(F.desc(score), "id").limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc(score), "id")))


def stabbed(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str) -> DataFrame:
    """Points times the spans of their key that hold them, with the columns of both but for the spans' key.

    A span lies in at most two bins of the smallest power of two that is as long as itself, and a point looks into one
    bin of each such width. So rows meet by (key, width, bin): a key that holds very many spans is dealt out over its
    bins, and a long span is not copied into many. Either side has more rows than its columns let a planner expect, so
    none is sent whole to the driver to be broadcast.
    """
    level = F.ceil(F.log2(F.greatest(F.col(last) - F.col(first) + 1, F.lit(1)).cast("double"))).cast("int")
    binned = spans.where(F.col(first) <= F.col(last)).withColumn("_level", level)
    bin_of = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    binned = binned.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(first), bin_of(last))))).withColumnRenamed(key, "_key")
    levels = sorted(r[0] for r in binned.select("_level").distinct().collect())  # a few dozen at most
    looks = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_bin", bin_of(at))
    met = looks.join(binned.hint("merge"), (F.col(key) == F.col("_key")) & (looks["_level"] == binned["_level"]) & (looks["_bin"] == binned["_bin"]))
    return met.where(F.col(at).between(F.col(first), F.col(last))).drop("_level", "_bin", "_key")


def enclosing(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Call sites (file, line) with the first function (file, name, start_line, end_line) around them; equal sites are one."""
    met = stabbed(sites.select("file", "line").distinct(), functions.select("file", "name", "start_line", "end_line"), "file", "line", "start_line", "end_line")
    first = met.groupBy("file", "line").agg(F.min(F.struct("start_line", "name")).alias("f"))
    return first.select("file", "line", F.col("f.name").alias("name"))


def overlapping(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose lines overlap those of a change in their file. Of two spans that overlap one begins inside the other, so each pair is met once: where the change begins, or where the symbol does."""
    c = changes.where("start_line <= end_line").select("file", F.col("start_line").alias("change_start"), F.col("end_line").alias("change_end"))
    s = symbols.where("start_line <= end_line").select("file", "name", "start_line", "end_line")
    out = ["file", "name", "change_start", "change_end"]
    begun = stabbed(c, s, "file", "change_start", "start_line", "end_line").select(*out)
    later = stabbed(s, c.withColumn("_after", F.col("change_start") + 1), "file", "start_line", "_after", "change_end").select(*out)
    return begun.union(later)


def export_lines(vertices: DataFrame, edges: DataFrame, form: str = "dot") -> DataFrame:
    """(part, line): the graph as lines of DOT, Mermaid or JSON objects; order them by part and line."""
    v, e = vertices.select(F.col("id").cast("string"), F.col("label").cast("string")), edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    if form == "dot":
        shapes = ("digraph G {", F.format_string('  "%s" [label="%s"];', "id", "label"), F.format_string('  "%s" -> "%s";', "src", "dst"), "}")
    elif form == "json":
        rows = [v.select(F.lit(1).alias("part"), F.to_json(F.struct("id", "label")).alias("line")), e.select(F.lit(2), F.to_json(F.struct("src", "dst")))]
        return rows[0].union(rows[1])
    elif form == "mermaid":
        shapes = ("graph TD", F.format_string("  %s[%s]", "id", "label"), F.format_string("  %s --> %s", "src", "dst"), "")
    else:
        raise ValueError(f"no form {form!r}")
    spark = vertices.sparkSession
    ends = spark.createDataFrame([(0, shapes[0])] + ([(3, shapes[3])] if shapes[3] else []), "part int, line string")
    return ends.union(v.select(F.lit(1), shapes[1])).union(e.select(F.lit(2), shapes[2]))
