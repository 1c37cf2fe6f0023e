"""Queries over ``embeddings`` and searches over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import search, vector
from tessera.operators.graph import saved
from tessera.plans.common import r6, table

QUERY = "the and that tion"
AS_OF = "2024-06-01 00:00:00"


def _near(metric, labels=None, **options):
    def run(spark, d):
        if labels:
            options["where"] = vector.payload_filter(label=labels)
        got = vector.knn_of_row(table(spark, d, "embeddings"), 0, k=10, metric=metric, **options)
        return got.select("vec_id", "label", r6("score").alias("score"))

    return run


def _near_sql(score: str, order: str, where: str = "true") -> str:
    return f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (
  SELECT vec_id, label, {score} AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q WHERE {where})
SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score {order}, vec_id LIMIT 10"""


def _batch(spark, d):
    rows = table(spark, d, "embeddings")
    return vector.knn_batch(rows, rows.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "rank", r6("score").alias("score"))


def _adapt(how, to):
    def run(spark, d):
        v = vector.adapt(F.col("embedding"), to, 64, how)
        rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x"))
        return rows.groupBy("i").agg(r6(F.sum("x")).alias("total"), F.count("*").alias("n"))

    return run


def _label_similarity(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = rows.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    a, b = centre.alias("a"), centre.alias("b")
    pair = a.join(b, F.col("a.label") < F.col("b.label"))
    return pair.select(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), r6(S.cosine(F.col("a.c"), F.col("b.c"))).alias("cosine"), r6(S.euclidean(F.col("a.c"), F.col("b.c"))).alias("euclidean"))


def _keyword(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), search.containment(F.col("text"), F.lit(QUERY)).alias("score"))
    return search.top(docs, 20, 0.3).select("id", "score")


def _keyword_index(spark, d):
    """As ``keyword_containment``, by an inverted index."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.best_of_index(saved(search.inverted(docs)), QUERY, 20, 0.3)[0]


def _benchmark_terms(spark, d):
    """Each benchmark text's words against each document, through the words themselves."""
    words = F.explode(F.array_distinct(X.terms(F.col("text"))))
    asked = table(spark, d, "benchmark").select("item_id", words.alias("word"))
    held = table(spark, d, "documents").select("doc_id", words.alias("word"))
    n = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    hits = asked.join(held, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits")).join(n, "item_id").where("2 * hits >= n")
    return hits.select("item_id", "doc_id", r6(F.col("hits") / F.col("n")).alias("score"))


def _fuzzy_tokens(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.array_distinct(X.terms(F.col("text")))).alias("token")).distinct()
    score = S.fuzzy(F.col("token"), F.lit("orantion"))
    return tokens.select("token", r6(score).alias("score")).where("score > 0.7")


def _semantic_final(spark, d):
    c, q = F.col("text"), F.lit(QUERY)
    modified = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    base = F.when(F.col("doc_id") % 4 == 0, 0.0).when(F.col("doc_id") % 4 > 1, 0.4)
    docs = table(spark, d, "documents").select("doc_id", search.semantic(base, c, q).alias("sem"), search.contextual(c, F.col("lang")).alias("ctx"), search.recency(modified, F.lit(AS_OF).cast("timestamp")).alias("rec"), search.popularity(F.col("doc_id") % 60, F.lit(0)).alias("pop"))
    return docs.select("doc_id", r6(search.final_score(*[F.col(x) for x in ("sem", "ctx", "rec", "pop")])).alias("score"))


def _sides(spark, d):
    vec = vector.knn_of_row(table(spark, d, "embeddings"), 0, k=60).select(F.col("vec_id").alias("id"), "score")
    docs = table(spark, d, "documents")
    key = docs.select(F.col("doc_id").alias("id"), search.containment(F.col("text"), F.lit(QUERY)).alias("score")).where("score > 0.5").orderBy(F.desc("score"), "id").limit(60)
    return vec, key


_SIDES_SQL = f"""q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 60),
k AS (SELECT doc_id AS id, len([t FOR t IN string_split('{QUERY}', ' ') IF contains(lower(text), t)]) / 4.0::DOUBLE AS score FROM documents),
g AS (SELECT * FROM k WHERE score > 0.5 ORDER BY score DESC, id LIMIT 60)"""


def _hybrid(spark, d):
    vec, key = _sides(spark, d)
    got = search.hybrid({"semantic": vec, "keyword": key})
    return search.top(got, 20, 0.2).select("id", r6("semantic_score").alias("semantic_score"), r6("keyword_score").alias("keyword_score"), r6("score").alias("score"))


def _fusion(spark, d):
    vec, key = _sides(spark, d)
    every = W.partitionBy(F.lit(1))
    vec, key = (s.select("id", search.normalized(F.col("score"), every).alias("score")) for s in (vec, key))  # at most 60 rows each
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    both = search.fuse(vec, key).join(docs, "id", "left")
    w = search.fusion_weights(F.lit(QUERY))
    ctx = search.containment(F.coalesce("text", F.lit("")), F.lit(QUERY))
    scored = both.withColumn("ctx", ctx).withColumn("score", F.col("vector_score") * w["vector"] + F.col("graph_score") * w["graph"] + F.col("ctx") * w["contextual"])
    sure = search.confidence(F.col("score"), F.col("vector_score"), F.col("graph_score"), F.col("in_graph"), search.completeness(F.col("lang"), F.col("text")))
    return search.top(scored.withColumn("confidence", sure), 15, 0.05).select("id", r6("score").alias("score"), r6("confidence").alias("confidence"))


def _weights(spark, d):
    items = table(spark, d, "benchmark").select("item_id", search.fusion_weights(F.col("text")).alias("w"))
    return items.select("item_id", *[r6(f"w.{n}").alias(n) for n in search.SOURCES])


def _rerank(spark, d):
    vec, key = _sides(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    words = lambda c: F.array_distinct(X.terms(c))
    parts = {"semantic": (S.jaccard(words(F.col("text")), words(F.lit(QUERY))), 0.3), "graph": (F.lit(None).cast("double"), 0.2), "contextual": (search.containment(F.col("text"), F.lit(QUERY)), 0.1)}
    best = key.orderBy(F.desc("score"), "id").limit(10).join(docs, "id").select("id", search.rerank(F.col("score"), parts).alias("score"))
    return search.apply_rerank(key, best).select("id", r6("score").alias("score"))


def _linear(spark, d):
    f = {"semanticScore": F.length("text") / 65536, "graphScore": (F.col("doc_id") % 10) / 10, "contextualScore": search.containment(F.col("text"), F.lit(QUERY)), "recencyScore": F.lit(0.5)}
    return table(spark, d, "documents").select("doc_id", r6(search.linear_model(f)).alias("score"))


def _symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", search.symbol_score(F.col("p_name"), F.lit("Part 1")).alias("score"))


QUERIES = {
    "knn_cosine_topk": _near("cosine"),
    "knn_dot": _near("dot"),
    "knn_euclid": _near("euclid"),
    "knn_manhattan": _near("manhattan"),
    "knn_filtered": _near("cosine", labels=[1, 2, 3]),
    "knn_threshold_exclude": _near("cosine", threshold=0.1, exclude=[0, 1, 2, 3]),
    "knn_batch_per_query": _batch,
    "dim_truncate": _adapt("truncation", 32),
    "dim_pool": _adapt("pooling", 16),
    "dim_stride": _adapt("stride", 16),
    "dim_interpolate": _adapt("interpolation", 48),
    "dim_pad": _adapt("padding", 80),
    "label_centroid_similarity": _label_similarity,
    "keyword_containment": _keyword,
    "keyword_index": _keyword_index,
    "benchmark_term_overlap": _benchmark_terms,
    "fuzzy_token_match": _fuzzy_tokens,
    "semantic_final_score": _semantic_final,
    "hybrid_fusion": _hybrid,
    "fuse_vector_graph": _fusion,
    "fusion_weights": _weights,
    "rerank_merge": _rerank,
    "ml_linear_score": _linear,
    "symbol_match": _symbols,
}

_COS = "list_cosine_similarity(v, q)"
_TERMS = f"string_split('{QUERY}', ' ')"
_CONTAIN = f"len([t FOR t IN {_TERMS} IF contains(lower(text), t)])"
_SUMS = "SELECT (i - 1)::INT AS i, round(sum(x), 6) AS total, count(*)::BIGINT AS n FROM (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT vec_id, {} AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))) GROUP BY i"
_ANY = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
SQL = {
    "knn_cosine_topk": _near_sql(_COS, "DESC"),
    "knn_dot": _near_sql("list_inner_product(v, q)", "DESC"),
    "knn_euclid": _near_sql("list_distance(v, q)", "ASC"),
    "knn_manhattan": _near_sql("list_sum([abs(v[i] - q[i]) FOR i IN range(1, 65)])", "ASC"),
    "knn_filtered": _near_sql(_COS, "DESC", "label IN (1, 2, 3)"),
    "knn_threshold_exclude": _near_sql(_COS, "DESC", f"vec_id NOT IN (0, 1, 2, 3) AND {_COS} >= 0.1"),
    "knn_batch_per_query": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) AS s FROM e, e q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5""",
    "dim_truncate": _SUMS.format("v[1:32]"),
    "dim_pool": _SUMS.format("[list_sum(v[i * 4 + 1:i * 4 + 4]) / 4 FOR i IN range(0, 16)]"),
    "dim_stride": _SUMS.format("[v[i * 4 + 1] FOR i IN range(0, 16)]"),
    "dim_interpolate": _SUMS.format("[v[floor(i * 63.0 / 47)::INT + 1] * (1 - (i * (63.0::DOUBLE / 47) - floor(i * 63.0 / 47))) + v[least(floor(i * 63.0 / 47)::INT + 2, 64)] * (i * (63.0::DOUBLE / 47) - floor(i * 63.0 / 47)) FOR i IN range(0, 48)]"),
    "dim_pad": _SUMS.format("list_concat(v, [0.0::DOUBLE FOR i IN range(0, 16)])"),
    "label_centroid_similarity": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (
  SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)
SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.c, b.c), 6) AS cosine, round(list_distance(a.c, b.c), 6) AS euclidean FROM c a JOIN c b ON a.label < b.label""",
    "keyword_containment": f"SELECT doc_id AS id, least({_CONTAIN} / 4.0::DOUBLE, 1.0::DOUBLE) AS score FROM documents WHERE {_CONTAIN} / 4.0 >= 0.3 ORDER BY score DESC, id LIMIT 20",
    "keyword_index": f"SELECT doc_id AS id, least({_CONTAIN} / 4.0::DOUBLE, 1.0::DOUBLE) AS score FROM documents WHERE {_CONTAIN} / 4.0 >= 0.3 ORDER BY score DESC, id LIMIT 20",
    "benchmark_term_overlap": r"""WITH w AS (SELECT item_id, unnest(list_distinct(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'))) AS word FROM benchmark),
h AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'))) AS word FROM documents),
n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS hits FROM w JOIN h USING (word) GROUP BY ALL)
SELECT item_id, doc_id, round(hits / n::DOUBLE, 6) AS score FROM m JOIN n USING (item_id) WHERE 2 * hits >= n""",
    # A character that is not ASCII differs from all of the word asked for, whatever it is.
    "fuzzy_token_match": r"""WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+')) AS token FROM documents), a AS (SELECT token, regexp_replace(token, '[^\x00-\x7F]', '~', 'g') AS x FROM t),
s AS (SELECT token, round((greatest(length(x), 8) - levenshtein(x, 'orantion')) / greatest(length(x), 8)::DOUBLE, 6) AS score FROM a) SELECT token, score FROM s WHERE score > 0.7""",
    "semantic_final_score": f"""WITH p AS (SELECT doc_id, least(CASE WHEN doc_id % 4 > 1 THEN 0.4 ELSE 0.5 END + 0.1::DOUBLE * {_CONTAIN}, 1.0) AS sem,
  least(CASE WHEN {_ANY(('function', 'class'))} THEN 0.2 ELSE 0 END + CASE WHEN {_ANY(('import', 'export'))} THEN 0.1 ELSE 0 END + CASE WHEN {_ANY(('//', '*'))} THEN 0.15 ELSE 0 END, 1.0)::DOUBLE AS ctx,
  exp(-((1717200000 - 1704067200 - doc_id * 3600) / 86400.0::DOUBLE) / 365) AS rec, least((doc_id % 60) / 50.0::DOUBLE, 1.0) AS pop FROM documents)
SELECT doc_id, round(sem * 0.5 + ctx * 0.25 + rec * 0.15 + pop * 0.1, 6) AS score FROM p""",
    "hybrid_fusion": f"""WITH {_SIDES_SQL}, b AS (SELECT coalesce(v.id, g.id) AS id, coalesce(v.score, 0) AS s, coalesce(g.score, 0) AS k FROM v FULL JOIN g ON v.id = g.id)
SELECT id, round(s, 6) AS semantic_score, round(k, 6) AS keyword_score, round(0.4::DOUBLE * s + 0.3::DOUBLE * k, 6) AS score FROM b WHERE 0.4 * s + 0.3 * k >= 0.2 ORDER BY 0.4 * s + 0.3 * k DESC, id LIMIT 20""",
    "fuse_vector_graph": f"""WITH {_SIDES_SQL}, nv AS (SELECT id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END AS score FROM v),
ng AS (SELECT id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END AS score FROM g),
b AS (SELECT coalesce(nv.id, ng.id) AS id, coalesce(nv.score, 0) AS s, coalesce(ng.score, 0) AS k, ng.id IS NOT NULL AS ing FROM nv FULL JOIN ng ON nv.id = ng.id),
c AS (SELECT b.*, len([t FOR t IN {_TERMS} IF contains(lower(coalesce(text, '')), t)]) / 4.0::DOUBLE AS ctx, ((lang IS NOT NULL)::INT + (text IS NOT NULL)::INT) / 2.0::DOUBLE AS full_share FROM b LEFT JOIN documents ON doc_id = id),
f AS (SELECT *, (0.4 * s + 0.3 * k + 0.2 * ctx)::DOUBLE AS score FROM c)
SELECT id, round(score, 6) AS score, round(greatest(0, least(1, (score - abs(s - k) * 0.2 + CASE WHEN ing THEN 0.1 ELSE 0 END) * (0.5 + full_share * 0.5))), 6)::DOUBLE AS confidence FROM f WHERE f.score >= 0.05 ORDER BY f.score DESC, id LIMIT 15""",
    "fusion_weights": f"""WITH a AS (SELECT item_id, ({_ANY(search.STRUCTURAL_WORDS)}) AS s, ({_ANY(search.SEMANTIC_WORDS)}) AS m FROM benchmark),
b AS (SELECT item_id, 0.4::DOUBLE - CASE WHEN s THEN 0.1 ELSE 0 END + CASE WHEN m THEN 0.2 ELSE 0 END AS v, 0.3::DOUBLE + CASE WHEN s THEN 0.2 ELSE 0 END - CASE WHEN m THEN 0.1 ELSE 0 END AS g FROM a)
SELECT item_id, round(v / (v + g + 0.3), 6) AS vector, round(g / (v + g + 0.3), 6) AS graph, round(0.2 / (v + g + 0.3), 6) AS contextual, round(0.05 / (v + g + 0.3), 6) AS recency, round(0.05 / (v + g + 0.3), 6) AS popularity FROM b""",
    "rerank_merge": f"""WITH {_SIDES_SQL}, top AS (SELECT * FROM g ORDER BY score DESC, id LIMIT 10), w AS (SELECT top.id, top.score, list_distinct(string_split_regex(lower(text), '\\s+')) AS ws, {_CONTAIN} / 4.0::DOUBLE AS ctx FROM top JOIN documents ON doc_id = id),
n AS (SELECT id, score * (1 - (0.3::DOUBLE + 0.2 + 0.1)) + 0.3 * len(list_intersect(ws, {_TERMS})) / len(list_distinct(list_concat(ws, {_TERMS})))::DOUBLE + 0.1 * ctx AS score FROM w)
SELECT g.id, round(coalesce(n.score, g.score), 6) AS score FROM g LEFT JOIN n USING (id)""",
    "ml_linear_score": f"SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * length(text) / 65536 + 0.2::DOUBLE * (doc_id % 10) / 10 + 0.15::DOUBLE * {_CONTAIN} / 4 + 0.05)), 6) AS score FROM documents",
    "symbol_match": "SELECT p_partkey, (CASE WHEN lower(p_name) = 'part 1' THEN 1.0 WHEN starts_with(lower(p_name), 'part 1') THEN 0.9 WHEN contains(lower(p_name), 'part 1') THEN 0.7 ELSE 0.5 END)::DOUBLE AS score FROM part",
}
