"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Services log a conversation again after each turn, so most logged conversations are prefixes of longer ones. A rolling
hash over (role, text) of the turns identifies each prefix; an anti-join of whole conversations against the proper
prefixes of all others leaves the maximal ones, of equal ones the smallest conv_id, and only these are rendered.
Both sides of the anti-join are grouped by hash first, with partial sums on the map side, so that a first turn or a
conversation that a third of the rows share is one row on either side.

Limits: the turns of one conversation are sorted by one task, and a maximal one is one row, of 2 GB at most, as is
the conversation that the rows without conv_id form.

Defined cases: null role or text differs from the empty string; null turns come first; turns that tie are ordered by
role and text; rows of null conv_id form one conversation; an exactly repeated row is a turn of its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, h1, h2): the 128-bit rolling hash of the first k of the n turns. Each turn is mixed with its place, so xor over the window is a hash of the sequence."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("k"))
    place = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    placed = placed.select("conv_id", "k", F.xxhash64(F.lit(11), *place).alias("a"), F.xxhash64(F.lit(23), *place).alias("b"))
    so_far = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return placed.select("conv_id", "k", F.max("k").over(whole).alias("n"), F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same): the conversations that no longer one begins with, and how often each was logged whole."""
    p = materialize(prefixes(turns), "chat-prefixes")
    whole = p.where("k = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    proper = p.where("k < n").groupBy("h1", "h2", F.col("k").alias("n")).agg(F.lit(1).alias("one"))
    return whole.join(proper, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_same")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, chat): turns in order, each between markers. The result is one row a conversation, so a conversation is what one task holds."""
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    line = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    return got.select("conv_id", F.array_join(F.transform("ts", line), "").alias("chat"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, chat) of the maximal conversations."""
    kept = maximal(turns)
    mine = kept.withColumnRenamed("conv_id", "kept_id")
    same = F.col("conv_id").eqNullSafe(F.col("kept_id"))
    chosen = turns.select("conv_id", "turn", "role", "text").join(mine.select("kept_id"), same, "left_semi")
    return mine.join(render(chosen), same).select("conv_id", "n_turns", "n_same", "chat")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM conversations GROUP BY conv_id
), whole AS (SELECT min(conv_id) AS conv_id, any_value(chat) AS chat, ts, count(*)::BIGINT AS n_same FROM t GROUP BY ts
), proper AS (SELECT DISTINCT ts[1:k] AS ts FROM t, unnest(range(1, len(ts))) AS u(k))
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_same, chat FROM whole WHERE ts NOT IN (SELECT ts FROM proper)
"""
