"""Importance resampling towards a target corpus, by hashed word runs counted with a vectorised byte automaton.

A table of 256 entries folds the bytes of Arrow text buffers and tells word bytes, differences of that find the
words, and table-driven checksums advance over all words of a piece at once. A feature is a run of 1 to ``longest``
words; its checksum modulo ``buckets`` is its bucket. How much likelier a bucket is in the target than in the raw
corpus is its gain; a document's weight is the mean gain of its features, its score adds Gumbel noise from a hash of
its id, and the highest scores are drawn: sampling without replacement in proportion to exp(weight / 1000).

Both corpora are counted in full. Each task sends one number a bucket, so the counts are small whatever the corpus
holds; the gains, one number a bucket, go to every task. Texts are read twice and never shuffled. Scores are whole
numbers in a range that the formula bounds (below 100,000 of them), so a histogram of scores finds the cut, and a
rank is the number of higher scores plus the place among equal ones.

Defined cases: null and empty texts have no features, weight 0, and are not drawn unless ``least_words`` is 0; a null
id is hashed as ``null`` and ranks behind all ids of its score; rows of equal id share their noise; an empty target or
corpus counts nothing, and an empty table gives an empty result; extra columns pass through ``weigh`` untouched, but
for one of the name that it gives its result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bytescan import OPEN, Words, advance, pieces
from tessera.llm.common import materialize, scratch, table

BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
_SPACE = np.array([32], np.uint8)


def buckets_of(raw: np.ndarray, at: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: (words, index of each run's first word, its bucket)."""
    words = Words(raw, at)
    here, state = np.arange(len(words)), np.full(len(words), OPEN, np.uint32)
    last = words.first[1:][np.searchsorted(words.first, here, side="right") - 1]  # the end of the word's text, in words
    for n in range(1, longest + 1):
        if n > 1:
            more = here + n - 1 < last
            here, last, state = here[more], last[more], state[more]
            zero = np.zeros(len(here), np.int64)
            state = advance(state, _SPACE, zero, zero + 1)
        end = here + n - 1
        state = advance(state, words.data, words.starts[end], words.ends[end])
        yield words, here, ((state ^ OPEN) % np.uint32(buckets)).astype(np.int64)


def _counter(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, at in pieces(batch.column(0)):
                for _, _, bucket in buckets_of(raw, at, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return count


def counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts."""
    per_task = docs.select(F.col(text).alias("text")).mapInArrow(_counter(longest, buckets), "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from two tables of counts; they hold a row a bucket at most, which is all that the driver gets."""
    s, t = (np.zeros(buckets), np.zeros(buckets))
    for got, df in ((s, raw), (t, target)):
        for row in df.collect():
            got[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigher(gain: np.ndarray, longest: int):
    buckets = len(gain)

    def weigh(texts: pa.Array) -> pa.Array:
        parts = []
        for raw, at in pieces(texts):
            total, n = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
            n_words = np.diff(Words(raw, at).first) if longest > 1 else n
            for words, here, bucket in buckets_of(raw, at, longest, buckets):
                edge = np.searchsorted(here, words.first)
                total += np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[edge])
                n += np.diff(edge)
            parts.append((n, np.floor_divide(total, np.maximum(n, 1)), n_words if longest > 1 else n))
        n, weight, n_words = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, weight, n_words)], ["n_features", "weight", "n_words"])

    return F.arrow_udf(weigh, "n_features long, weight long, n_words long")


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", to: str = "resample", longest: int = LONGEST) -> DataFrame:
    """``docs`` with a struct column: n_features, weight, n_words."""
    return docs.withColumn(to, _weigher(gain, longest)(F.col(text)))


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the key and the seed only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """``scored`` (n_words, score and the key among its columns) with the rank of the drawn, null for others. It is read three times, so hand over a table.

    Equal scores lie in one window: at most 1/2700 of all rows when all weights are equal, since noise spreads the rest.
    """
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    # At most so many rows as there are whole scores in range.
    found = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in found) // 100
    above, before = [], 0
    for score, n in found:
        if before >= wanted:
            break
        above.append((score, before))
        before += n
    spark = scored.sparkSession
    higher = spark.createDataFrame(above, "score long, higher long")
    least = above[-1][0] if above else None
    high = F.lit(False) if least is None else may & (F.col("score") >= least)
    others = [F.col(f"`{c}`").asc_nulls_last() for c, kind in scored.dtypes if c not in (key, "score") and kind in ("bigint", "int", "string", "double")]
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), *others))
    near = scored.where(high).join(F.broadcast(higher), "score").withColumn("rank", (F.col("higher") + place).cast("long")).drop("higher")
    near = near.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return near.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every document's (doc_id, n_features, weight, n_words, score, rank)."""
    with scratch(docs.sparkSession) as work:
        gain = gains(counts(docs, text, longest, buckets), counts(target, text, longest, buckets), buckets)
        weighed = weigh(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), gain, longest=longest).select("doc_id", "resample.*")
        scored = work.keep(materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores"))
    return draw(scored, percent, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS entries FROM steps WHERE k = 8
), raw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), want AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), raw_words AS (SELECT w, count(*) AS s FROM raw GROUP BY w
), want_words AS (SELECT w, count(*) AS t FROM want GROUP BY w
), words AS (
  SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(w)) AS x FROM raw_words FULL JOIN want_words USING (w)
), bucketed AS (
  SELECT w, s, t, xor(list_reduce(list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT),
    lambda c, b: xor(c >> 8, crc.entries[(xor(c, b) % 256)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS b FROM words, crc
), per AS (SELECT b, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM bucketed GROUP BY b
), gained AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM per
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN bucketed USING (w) JOIN gained USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS wanted FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
