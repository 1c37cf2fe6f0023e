"""Approximate nearest neighbours by learned partitions.

A part is split thus: on a bounded sample of its rows a neighbour graph is built and cut into equally large parts with
few edges between them (the part is halved along its main direction, then members are exchanged while that cuts fewer
edges, and so on), and a small network learns where a vector's neighbours lie. Every row of the part is filed under
its most probable new part; a query is sent to its several most probable ones, and the rows that it meets are ranked
by exact inner products in double precision. How many parts a query is sent to follows from the recall on held-out
rows of the sample: few where vectors cluster, most of them where neighbours are hardly nearer than others.

The whole table is one part at first, which is split at every size that has ``2 * part_rows`` rows; any part that still
has over BLOCK rows is split again, by a network of its own, so the number of parts grows with the rows and the depth
with their logarithm. Networks are fitted in tasks, one a part, on at most SAMPLE of its rows; nothing is collected to
the driver but the counts of rows by length and whether a table is empty.

Of rows with equal vectors only the k + 1 of smallest id can be among any query's k nearest, so the others are left
out of the search before it begins, and a vector that a third of the rows share costs nothing. A part that no network
divides is dealt out row by row. A query does not travel once a part: the parts that were split off one part lie
together, by GATHERED rows, and a query comes to such a block once, with the names of the parts that it is to meet there.
A block returns each query's best few of all its parts, which are merged. A query that meets too few rows is sent to
all parts.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold nulls or non-finite numbers
take no part; a repeated vec_id is one query (its least vector), its rows are candidates for others, once each if
their vectors are equal too; equal scores are ordered by vec_id; fewer candidates than asked for are all returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, scratch, table

#: Most rows of a part that its network is fitted on.
SAMPLE = 8192
#: Rows that a new part gets at least, on average, where the caller names no number; parts of the sample have 64.
ROWS_PER_PART = 1024
BLOCK = 2048
#: Rows or queries that one task routes at a time.
ROUTED = 8192
#: Rows, and queries, that a task of the search holds, about.
GATHERED = 8192
NEIGHBOURS = 10
HIDDEN = 128
#: A query is sent to as many parts as found this share of the neighbours of sample rows that training did not see.
RECALL = 0.95
HELD_OUT = 768
SEED = 11


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node; part sizes differ by one at most per halving."""
    label, level = np.zeros(len(x), np.int64), 1
    while level < parts:
        new = label * 2
        for p in range(level):
            own = np.flatnonzero(label == p)
            if len(own) < 2:
                continue
            centred = x[own] - x[own].mean(axis=0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            side = np.zeros(len(own), bool)
            side[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]] = True
            place = np.full(len(x), -1)
            place[own] = np.arange(len(own))
            to = place[graph[own]]
            a, b = np.repeat(np.arange(len(own)), graph.shape[1])[(to >= 0).ravel()], to.ravel()[(to >= 0).ravel()]
            for _ in range(rounds):
                # Edges to the other side less edges to one's own, in both directions.
                sign = np.where(side[a] != side[b], 1.0, -1.0)
                gain = np.bincount(a, sign, len(own)) + np.bincount(b, sign, len(own))
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                n = min(len(left), len(right))
                swap = int(((gain[left[:n]] + gain[right[:n]]) > 0).sum() * 0.5)
                if not swap:
                    break
                side[left[:swap]], side[right[:swap]] = True, False
            new[own] += side
        label, level = new, level * 2
    return label


class Router:
    """Vector to part probabilities: one hidden layer, trained on where a vector's neighbours lie."""

    def __init__(self, scale: float, weights: list[np.ndarray]):
        self.scale, self.weights = scale, weights

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, scale=self.scale, **{f"w{k}": w.astype(np.float32) for k, w in enumerate(self.weights)})
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Router:
        with np.load(io.BytesIO(raw)) as f:
            return cls(float(f["scale"]), [f[f"w{k}"].astype(np.float64) for k in range(4)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x * self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int, epochs: int = 24, batch: int = 256, rate: float = 0.006) -> Router:
    scale = float(np.sqrt(x.shape[1]) / max(np.linalg.norm(x, axis=1).mean(), 1e-12))
    r = np.random.default_rng(SEED)
    d = x.shape[1]
    w = [r.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    if parts == 1:
        return Router(scale, w)
    graph = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    want = np.eye(parts)[label] * 0.5
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 0.5 / graph.shape[1])
    m, v, t, router = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, Router(scale, w)
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            xs = x[own] * scale
            h = np.maximum(xs @ w[0] + w[1], 0)
            dz = (router(x[own]) - want[own]) / len(own)
            dh = (dz @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((xs.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return router


def probes_for(router: Router, rows: np.ndarray, queries: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least number of parts that holds this share of the queries' k nearest among the rows."""
    at, p = router(rows).argmax(axis=1), router(queries)
    near = np.argpartition(-(queries @ rows.T), min(k, len(rows)) - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    hit = np.bincount(np.take_along_axis(rank, at[near], 1).ravel(), minlength=p.shape[1]).cumsum() / near.size
    return int(np.searchsorted(hit, recall) + 1) if p.shape[1] > 1 else 1


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]])
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def parts_for(n: int, sampled: int, part_rows: int) -> int:
    """How many parts n rows are split into, by a sample of so many of them."""
    parts = 1
    while parts * 2 * part_rows <= n and parts * 2 * 64 <= sampled:
        parts *= 2
    return parts


def _fitter(k: int, part_rows: int):
    def fit_part(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        order = np.lexsort((rows.column("vec_id").to_numpy(), rows.column("place").to_numpy()))[:SAMPLE]
        x = _matrix(rows.column("vector"))[order]
        held = min(HELD_OUT, len(x) // 8)
        parts = parts_for(n, len(x) - held, part_rows)
        router = fit(x[held:], parts) if parts > 1 else None
        probes = min(parts, probes_for(router, x[held:], x[:held], k)) if router else 1
        made = {"part": [key[0].as_py()], "parts": [parts], "probes": [probes], "model": [router.dumps() if router else None]}
        return pa.table(made, pa.schema([("part", pa.string()), ("parts", pa.int32()), ("probes", pa.int32()), ("model", pa.binary())]))

    return fit_part


#: Ends the name of a part that is not split any more.
LEAF = "!"


def _router(every: str | None):
    """The best part of each item; with ``every``, the column of the router's row that tells how many, a list of its best parts as ``to``."""

    def route(key: tuple, items: pa.Table, routers: pa.Table) -> pa.Table:
        part, model = key[0].as_py(), routers.column("model")[0].as_py()
        here = items.select(["id", "vector"])
        if model is None or not len(items):
            names, n = np.full((len(items), 1), part + LEAF, object), 1
        else:
            n = routers.column(every)[0].as_py() if every else 1
            best = np.argsort(-Router.loads(model)(_matrix(items.column("vector"))), axis=1, kind="stable")[:, :n]
            names = np.array([f"{part}.{b}" for b in range(best.max() + 1)], object)[best]
        flat = pa.array(names.ravel(), pa.string())
        if every is None:
            return here.append_column("part", flat)
        to = pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1) * names.shape[1], pa.int32()), flat)
        return here.append_column("part", pa.array([part] * len(items), pa.string())).append_column("to", to)

    return route


def _routed(items: DataFrame, routers: DataFrame, every: str | None = None) -> DataFrame:
    """Of ``items`` (id, vector, part) those of the routers' parts, sent on; a task has at most about ROUTED of them."""
    blocks = items.join(routers.select("part"), "part").groupBy("part").agg(F.ceil(F.count("*") / ROUTED).cast("int").alias("blocks"))
    blocks = materialize(blocks, "ann-blocks")
    dealt = items.join(blocks, "part").select("id", "vector", "part", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int").alias("block"))
    each = blocks.select(F.col("part").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth"))
    models = routers.join(each, F.col("part") == F.col("of")).select("parts", "probes", "model", F.col("of"), "nth")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select("id", "vector", "part").schema)
    return dealt.groupBy("part", "block").cogroup(models.groupBy("of", "nth")).applyInArrow(_router(every), schema + (", to array<string>" if every else ""))


def _split(rows: DataFrame, k: int, part_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (vec_id, vector) with their final parts, and the routers (part, parts, probes, model) of each level."""
    filed, levels = rows.select(F.col("vec_id").alias("id"), "vector", F.lit("").alias("part")), []
    while True:
        sizes = materialize(filed.groupBy("part").agg(F.count("*").alias("n")), "ann-sizes")
        wide = materialize(sizes.where(f"part = '' OR (n > {BLOCK} AND NOT endswith(part, '{LEAF}'))"), "ann-wide")
        if wide.isEmpty():
            return filed.withColumnRenamed("id", "vec_id"), levels
        place = F.pmod(F.xxhash64("id", "vector", F.lit(SEED)), F.lit(1 << 30)).alias("place")
        drawn = filed.join(wide, "part").select("part", "n", F.col("id").alias("vec_id"), "vector", place)
        drawn = drawn.where(F.col("place") * F.col("n") < F.lit((1 << 30) * 2 * SAMPLE))
        fitted = drawn.groupBy("part").applyInArrow(_fitter(k, part_rows), "part string, parts int, probes int, model binary")
        levels.append(materialize(fitted, "ann-routers"))
        rest = filed.join(levels[-1].select("part"), "part", "left_anti").select("id", "vector", "part")
        filed = materialize(_routed(filed, levels[-1]).unionByName(rest), "ann-filed")


def _descend(queries: DataFrame, levels: list[DataFrame], every: str) -> DataFrame:
    """(query_id, vector, part, to): ``queries`` (query_id, vector) once for each part that they come to, with the parts split off it that they are sent to. Only parts that are split again are gone into further."""
    sent, out = queries.select(F.col("query_id").alias("id"), "vector", F.lit("").alias("part")), None
    for routers in levels:
        at = materialize(_routed(sent, routers, every), "ann-sent")
        out = at if out is None else out.unionByName(at)
        sent = at.select("id", "vector", F.explode("to").alias("part"))
    return out.withColumnRenamed("id", "query_id")


def _best(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def best(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "ids": [], "scores": []}
        if len(rows) and len(queries):
            names = {name: n for n, name in enumerate(rows.column("part").unique().to_pylist())}
            place = rows.column("part").combine_chunks().dictionary_encode()
            x, ids = _matrix(rows.column("vector")).astype(np.float64), rows.column("vec_id").to_numpy()
            code = np.array([names[name] for name in place.dictionary.to_pylist()])[place.indices.to_numpy()]
            order = np.lexsort((ids, code))
            x, ids, code = x[order], ids[order], code[order]
            first = np.searchsorted(code, np.arange(len(names) + 1))
            asked, qx = queries.column("query_id").to_numpy(), _matrix(queries.column("vector")).astype(np.float64)
            to = queries.column("to").combine_chunks()
            lists = to.flatten().dictionary_encode()
            known = np.array([names.get(name, -1) for name in lists.dictionary.to_pylist()], np.int64)[lists.indices.to_numpy()]
            whose = np.repeat(np.arange(len(asked)), to.value_lengths().to_numpy())
            met = np.zeros((len(asked), len(names)), bool)
            met[whose[known >= 0], known[known >= 0]] = True
            longest, n = np.linalg.norm(x, axis=1).max(), min(k, len(x))
            for at in range(0, len(asked), 256):
                qs, own_ids = qx[at : at + 256], asked[at : at + 256]
                rough = np.full((len(qs), len(x)), -np.inf)
                for part in np.flatnonzero(met[at : at + 256].any(axis=0)):
                    some, span = np.flatnonzero(met[at : at + 256, part]), slice(first[part], first[part + 1])
                    rough[some, span] = qs[some] @ x[span].T
                rough[ids[None, :] == own_ids[:, None]] = -np.inf
                edge = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n] - 1e-9 * np.linalg.norm(qs, axis=1) * longest
                for q, own, row, least in zip(qs, own_ids, rough, edge, strict=True):
                    near = np.flatnonzero((row >= least) & (row > -np.inf))
                    if not len(near):
                        continue
                    s = (x[near] * q).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                    best = np.lexsort((ids[near], -s))[:k]
                    out["query_id"].append(own)
                    out["ids"].append(ids[near[best]])
                    out["scores"].append(-s[best])
        return pa.table(out, schema)

    return best


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of (query_id, ids, scores): the k least of (negated score, id), first of a few blocks each, then of all."""
    least = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k).alias("best")
    pairs = found.select("query_id", F.pmod(F.xxhash64("ids"), F.lit(16)).alias("some"), F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("i")).alias("best"))
    best = pairs.groupBy("query_id", "some").agg(least("best")).groupBy("query_id").agg(least("best"))
    got = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return got.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b")["i"].alias("vec_id"), (-F.col("b")["s"]).alias("score"))


def _search(filed: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores): each block's best, scores negated. ``filed`` has (vec_id, vector, part), ``sent`` (query_id, vector, part, to).

    The parts split off one part are dealt whole into blocks of about GATHERED rows, one that no network divides row by
    row; a query comes once to each block that holds one of its parts.
    """
    whole = ~F.endswith("part", F.lit(LEAF))
    above = F.when(whole, F.regexp_replace("part", r"\.[0-9]+$", "")).otherwise(F.regexp_replace("part", f"{LEAF}$", ""))
    filed = filed.select("vec_id", "vector", "part", above.alias("above"))
    rows_in = filed.groupBy("above").agg(F.ceil(F.count("*") / GATHERED).cast("int").alias("n_rows"))
    queries_in = sent.groupBy(F.col("part").alias("above")).agg(F.ceil(F.count("*") / GATHERED).cast("int").alias("n_queries"))
    sizes = materialize(rows_in.join(queries_in, "above"), "ann-blocks")
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.when(whole, deal("n_rows", "part")).otherwise(deal("n_rows", "vec_id", "vector"))
    left = filed.join(sizes, "above").select("vec_id", "vector", "part", "above", block.alias("row_block"), F.explode(every("n_queries")).alias("query_block"))
    comes = F.when(F.exists("to", lambda p: F.endswith(p, F.lit(LEAF))), every("n_rows")).otherwise(F.array_distinct(F.transform("to", lambda p: deal("n_rows", p))))
    right = sent.withColumnRenamed("part", "above").join(sizes, "above")
    right = right.select("query_id", "vector", "above", "to", "n_rows", deal("n_queries", "query_id").alias("query_block"), F.explode(comes).alias("row_block"))
    here = F.filter("to", lambda p: F.endswith(p, F.lit(LEAF)) | (deal("n_rows", p) == F.col("row_block")))
    right = right.select("query_id", "vector", "above", here.alias("to"), "row_block", "query_block")
    keys = ["above", "row_block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id long, ids array<long>, scores array<double>")


def search(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", part_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``. Parts get ``part_rows`` rows at least, on average."""
    v = F.col(vector)
    v = v if vectors.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    sound = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    dim = sound.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = sound.where(F.size("vector") == dim.dim)
    with scratch(vectors.sparkSession) as work:
        asked = sound.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
        asked = materialize(asked, "ann-queries")
        nearest = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
        rows = materialize(sound.distinct().withColumn("nth", nearest).where(f"nth <= {k + 1}").drop("nth"), "ann-rows")
        n = rows.count()
        filed, levels = _split(rows, k, part_rows or ROWS_PER_PART)
        found = materialize(_merge(_search(filed, _descend(asked, levels, "probes"), k), k), "ann-found")
        short = found.groupBy("query_id").agg(F.count("*").alias("n"))
        short = materialize(asked.join(short, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select("query_id", "vector"), "ann-short")
        if not short.isEmpty():
            again = _merge(_search(filed, _descend(short, levels, "parts"), k), k)
            found = materialize(found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again), "ann-found")
        return work.keep(found).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), part_rows=64)
