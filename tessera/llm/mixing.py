"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target and so a repetition rate, and each document is
emitted floor(rate) times plus one more time with the probability of the fraction, decided by a hash of its id.

Sources are ordered by code point with null last; the weights repeat along that order. The targets share
``share`` times all tokens by weight; a target stops at ``cap`` times its source's size and the excess is shared
anew by weight until none is above. That fixed point is min(cap * size, weight * level) for one level, which one
sort of the sources by cap * size / weight finds without iteration.

Sources, a row each, are ordered in one task; its sorts spill, but hundreds of millions of sources would take it long.

Defined cases: null text has size 0; a null source is a source of its own; a source of size 0 has target 0 and its
documents are emitted no time; rows of equal id share one draw, and so do all rows without id, so a source needs ids
to come near its target; an empty table gives an empty result; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, n_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Up to so many sources (each a name and three numbers), their rates are broadcast; beyond, joined by shuffle, with
#: the same result.
BROADCAST_SOURCES = 20_000


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) for rows of (source, size). One row per source is all that leaves the map side."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / heavy)
    # The first source whose cap lies above the level of what is left sets the level of all that follow.
    free = F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(everything)
    target = F.coalesce(F.least(F.col("most"), F.col("weight") * level), F.col("most"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def bernoulli(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(bernoulli(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def with_rates(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with a struct column named by the operator: size, source_size, target, copies.

    The text is read twice, for the sums and for the result, and never shuffled.
    """
    name = f"mix_{uuid.uuid4().hex[:8]}"
    packed, targets, few = _packed(docs, key, weights, share, cap)
    return _rated(packed, targets, few, seed).select("row.*", F.col("rated").alias(name)), name


def _packed(docs: DataFrame, key: str, weights, share: float, cap: float) -> tuple[DataFrame, DataFrame, bool]:
    """(row, row_key, row_source, row_size) for each row of ``docs``, the targets, and whether these may be broadcast. Rows are structs, so that no name of theirs can clash."""
    targets = materialize(source_targets(docs.select("source", n_words().alias("size")), weights, share, cap), "mix-targets")
    packed = docs.select(F.struct("*").alias("row"), docs[f"`{key}`"].alias("row_key"), docs["source"].alias("row_source"), n_words().alias("row_size"))
    return packed, targets, targets.count() <= BROADCAST_SOURCES


def _rated(packed: DataFrame, targets: DataFrame, few: bool, seed: str) -> DataFrame:
    right = F.broadcast(targets) if few else targets
    joined = packed.join(right, F.col("row_source").eqNullSafe(F.col("source")), "left")
    out = F.struct(F.col("row_size").alias("size"), "source_size", "target", copies(F.col("rate"), F.col("row_key"), seed).alias("copies"))
    return joined.select("row", out.alias("rated"))


def mix(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    rated = _rated(*_packed(docs, key, weights, share, cap), seed)
    times = F.col("rated.copies")
    return rated.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, name = with_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col(name)
    return rated.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (SELECT (arg_min(level, (most / weight, coalesce(source, chr(1114111)))) FILTER (WHERE most > weight * level)) AS level FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(most, weight * found.level), most)::DOUBLE AS target FROM weighed, found
), rated AS (
  SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size > 0 THEN least(target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
