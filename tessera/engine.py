"""The client's view: an index of a source tree or a document table, and what can be asked of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking, dedup, graph, rules, search, security, sync, vector
from tessera.sources import files


class Engine:
    """Chunks, nodes and vectors of a corpus of (doc_id, text, lang, source); all results are DataFrames.

    ``embed`` makes a vector Column of a text Column and a dimension; a model's would be a pandas function.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, embed: Callable[[Column, int], Column] = vector.hashing_embedding):
        self.spark, self.docs, self.embed = spark, docs, embed

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, **options) -> Engine:
        found = files.scan(spark, root, **options)
        return cls(spark, found.select(F.col("relative_path").alias("doc_id"), F.col("content").alias("text"), F.col("language").alias("lang"), F.lit(root).alias("source")))

    def chunks(self, **options) -> DataFrame:
        return chunking.line_chunks(self.docs, **options)

    def nodes(self) -> DataFrame:
        return chunking.syntax_nodes(self.docs)

    def snippets(self) -> DataFrame:
        lang = self.docs.select("doc_id", "lang")
        return rules.snippets(self.nodes().join(lang, "doc_id"), F.col("lang"))

    def duplicates(self, how: str = "exact") -> DataFrame:
        return {"exact": dedup.exact, "semantic": dedup.semantic, "fuzzy": dedup.fuzzy}[how](self.docs)

    def findings(self) -> DataFrame:
        return security.scan(self.docs, "doc_id", "text")

    def keyword(self, query: str, k: int = 10) -> DataFrame:
        scored = self.docs.select(F.col("doc_id").alias("id"), search.containment(F.col("text"), F.lit(query)).alias("score"))
        return search.top(scored, k)

    def semantic(self, query: str, k: int = 10, dim: int = 64, threshold: float | None = None) -> DataFrame:
        """By the engine's embedder; stored vectors go through ``vector.knn``."""
        asked = self.spark.range(1).select(self.embed(F.lit(query), dim).alias("v")).first().v
        rows = self.docs.select(F.col("doc_id").alias("vec_id"), self.embed(F.col("text"), dim).alias("embedding"))
        return vector.knn(rows, asked, k, threshold=threshold)

    def concept(self, name: str, context: str | None = None, k: int = 10, threshold: float = 0.6) -> DataFrame:
        """The texts near the words that a concept stands for."""
        words = vector.expanded(F.lit(name), F.lit(context) if context else None)
        return self.semantic(self.spark.range(1).select(words.alias("w")).first().w, k, threshold=threshold)

    def hybrid(self, query: str, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
        hits = {
            "semantic": self.semantic(query, 100).select(F.col("vec_id").alias("id"), "score"),
            "keyword": self.docs.select(F.col("doc_id").alias("id"), search.containment(F.col("text"), F.lit(query)).alias("score")).where("score > 0"),
        }
        return search.top(search.hybrid(hits, weights, normalize=True), k)

    def analyze(self, edges: DataFrame, depth: int = 3) -> dict[str, DataFrame]:
        return {"degrees": graph.degrees(edges), "components": graph.components(edges), "cycles": graph.cycles(edges, depth + 1), "pagerank": graph.pagerank(edges)}

    def languages(self) -> DataFrame:
        return self.docs.groupBy("lang").agg(F.count("*").alias("n_files"))

    def analyzed_query(self, query: str) -> DataFrame:
        q = F.lit(query.lower())
        words, found = X.keywords(q), X.entities(q)
        return self.spark.range(1).select(X.query_type(q).alias("type"), X.intent(q).alias("intent"), words.alias("keywords"), found.alias("entities"), X.query_complexity(q, words, found).alias("complexity"))

    # ---- the index: what is in it, and changes to it

    def with_files(self, docs: DataFrame) -> Engine:
        """The index with these files written over those of the same doc_id."""
        return Engine(self.spark, sync.upsert(self.docs, docs, "doc_id"), self.embed)

    def without(self, ids: DataFrame) -> Engine:
        """The index without these files (doc_id)."""
        return Engine(self.spark, sync.delete(self.docs, ids, "doc_id"), self.embed)

    def status(self) -> DataFrame:
        """Files, distinct texts and characters of each project."""
        return self.docs.groupBy("source").agg(F.count("*").alias("n_files"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct"), F.sum(F.length("text")).alias("n_chars"))

    def projects(self) -> DataFrame:
        return self.docs.select("source", files.project_id(F.col("source")).alias("project_id")).distinct()
