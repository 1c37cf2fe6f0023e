"""Near duplicates by circulant MinHash.

Two permutations give all coordinates of a signature: the first scatters a document's shingles over a ring, the second
gives each place of the ring a value, and coordinate k is the least value over the document's places when the ring is
shifted by k. A shingle's values under all shifts are one slice of the second permutation, so a signature is a minimum
over slices. Signatures are cut into bands; documents that share a band are candidates, and a candidate pair is a link
only if the exact Jaccard similarity of the two whole shingle sets reaches the threshold.

Documents of equal sets are one node, known by a 128-bit digest of the set. In buckets of up to SMALL nodes all pairs
are candidates. In each larger bucket the node with the fewest shingles of its own is the pivot. It is compared with
all others, which joins most of a large group in work linear in its size. Of the pairs that are still in different
components, those can be no link for which a lower bound on the symmetric difference of the two sets is too large: the
shingles that only the one node holds, those that only the other holds, the difference between how many of the
pivot's shingles the two have lost, and that between how many they have gained that others hold too. All others are
compared, so no link between components is lost; a large bucket is dealt into blocks for it, so that it makes more
tasks and no larger ones. All other candidates are verified on the whole sets,
but for pairs whose sizes alone exclude the threshold. Signatures are not kept: only the bands are written.

With 26 bands of 5 rows a pair of similarity 0.85 shares no band with probability 4e-7; with 32 bands of 4 rows one
of 0.8 with 5e-8.

Defined cases: null text, and text without words, has an empty set and is linked with nothing; fewer words than a
shingle has make the whole sequence one shingle; repeated rows are in one group; a component's id is its smallest
doc_id; an empty table gives an empty result; extra columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, materialize, scratch, table
from tessera.llm.components import components

#: Places on the ring.
RING = 1 << 22
SEED = 20240117
#: Nodes of a bucket of which all pairs are compared at once; more go by a pivot first, with the same links in the end.
SMALL = 8
#: Nodes of a large bucket in a block, about.
BLOCK = 256
#: Rows (texts, or pairs with both sets) that a Python worker is sent at once.
BATCH = 1000
#: Words whose hashes a Python worker remembers.
REMEMBERED = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    w = min(width, len(h))
    out = np.full(len(h) - w + 1, w, np.uint64)
    for k in range(w):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - w + 1 + k])
    return np.unique(out)


@lru_cache(1)
def _ring(shifts: int) -> np.ndarray:
    """Row p holds the values of place p under each shift: the second permutation, seen through a sliding window."""
    pi = np.random.default_rng(SEED).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:shifts]]), shifts)


def signature(shingles: np.ndarray, shifts: int) -> np.ndarray:
    """The first permutation is an odd multiple of the folded hash on the ring."""
    place = ((shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(SEED)) & np.uint64(RING - 1)
    ring, least = _ring(shifts), None
    for at in range(0, len(place), 2048):
        part = ring[place[at : at + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def _sketch(bands: int, rows: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None)
                    continue
                sig = signature(s, bands * rows)
                key = salt
                for col in sig.reshape(bands, rows).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "bands"],
            )

    return sketch


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, s) for n, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if xxhash.xxh3_128_digest(s := shingle_set(t.as_py(), width).tobytes()) == n]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["node", "shingles"])

    return sets


def _each_set(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {xxhash.xxh3_128_digest(s): s for t in batch.column(0) if (s := shingle_set(t.as_py(), width).tobytes())}
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (list(found), list(found.values()))], ["node", "shingles"])

    return each


def _node(width: int):
    def node(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([xxhash.xxh3_128_digest(s) if (s := shingle_set(t.as_py(), width).tobytes()) else None for t in texts], pa.binary())

    return F.arrow_udf(node, "binary")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([len(p.as_buffer()) // 8 for p in batch.column("sa")], pa.int64()), pa.array([len(q.as_buffer()) // 8 for q in batch.column("sb")], pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n_a", "n_b", "shared"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) by the whole sets."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(_overlap, "a binary, b binary, n_a long, n_b long, shared long"), "minhash-overlaps")


def _links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    a, b = (sigs.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
    return _linked(_overlaps(near, sets), percent)


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _own(sets: DataFrame) -> DataFrame:
    """(node, n_shingles, own): how many of its shingles no other of these nodes holds."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("shingles")]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *got])))], ["node", "hashes"])

    held = sets.mapInArrow(each, "node binary, hashes array<long>").select("node", F.explode("hashes").alias("hash"))
    alone = held.groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", (F.length("shingles") / 8).cast("long").alias("n_shingles")).join(alone, "node", "left").select("node", "n_shingles", F.coalesce("own", F.lit(0)).alias("own"))


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of buckets with their block ``own_block`` and the number ``n_blocks`` of blocks in their bucket."""
    sizes = sizes.select("bucket", F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("n_blocks"))
    return rows.join(sizes, "bucket").withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))


def _large(slots: DataFrame, links: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that large buckets add. Every link of a bucket joins components that the result joins too."""
    members = slots.select("node").distinct()
    held = materialize(sets.join(members, "node", "left_semi").dropDuplicates(["node"]), "minhash-large-sets")
    own = materialize(_own(held), "minhash-own")
    slots = materialize(slots.join(own, "node"), "minhash-large")
    pivots = slots.groupBy("bucket").agg(F.min(F.struct("own", F.xxhash64("node"), "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    by_pivot = materialize(slots.join(pivots, "bucket"), "minhash-pivots")
    pairs = by_pivot.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    seen = _overlaps(pairs, held)
    links = links.union(_linked(seen, percent))
    comps = components(links)
    lost = seen.select(F.col("a").alias("pivot"), F.col("b").alias("node"), (F.col("n_a") - F.col("shared")).alias("lost"), (F.col("n_b") - F.col("shared")).alias("gained"))
    mine = by_pivot.join(lost, ["pivot", "node"], "left").join(comps, "node", "left")
    mine = materialize(mine.select("bucket", "band", "node", "n_shingles", "own", "lost", (F.col("gained") - F.col("own")).alias("common"), F.coalesce("comp", "node").alias("comp")), "minhash-labelled")
    mixed = mine.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    # A node whose own shingles alone exceed what any partner of the largest possible size allows has no link.
    # The pivot, which has nothing lost or gained, has met all others already.
    open_ = mine.join(mixed, "bucket").where(f"lost IS NOT NULL AND own * {100 + percent} <= n_shingles * {100 - percent} * (1 + {100 / percent})")
    open_ = materialize(open_, "minhash-open")
    open_ = _blocks(open_.join(sigs.select("node", "bands"), "node"), open_.groupBy("bucket").agg(F.count("*").alias("n_rows")))
    # Each block meets itself and those after it: one side is sent on to these, the other to those before.
    x = open_.withColumn("block", F.explode(F.expr("sequence(own_block, n_blocks - 1)")))
    y = open_.withColumn("from_block", F.explode(F.expr("sequence(0, own_block)")))
    y = y.select("bucket", F.col("from_block").alias("own_block"), F.col("own_block").alias("block"), *[F.col(c).alias(f"{c}_y") for c in ("node", "n_shingles", "own", "lost", "common", "comp", "bands")])
    apart = f"(own + own_y + abs(lost - lost_y) + abs(common - common_y)) * {100 + percent} <= (n_shingles + n_shingles_y) * {100 - percent}"
    sized = f"100 * least(n_shingles, n_shingles_y) >= {percent} * greatest(n_shingles, n_shingles_y)"
    # A pair meets in each bucket that it shares and is taken in the first.
    once = "array_position(zip_with(bands, bands_y, (p, q) -> p = q), true) = band + 1"
    met = "comp <> comp_y AND (own_block < block OR node < node_y)"
    pairs = x.join(y, ["bucket", "own_block", "block"]).where(f"{met} AND {apart} AND {sized} AND {once}").select(*_ordered(F.col("node"), F.col("node_y")))
    return links.union(_links(pairs, sigs, held, percent))


def classes(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``. Texts are shuffled once, by id, for the sets of those that share a bucket."""
    named, _ = _named(docs, percent, width, bands, rows, key, text)
    least = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("comp", "least")
    got = named.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(docs: DataFrame, percent: int, width: int, bands: int, rows: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_shingles, node, comp) for each row of ``docs``, and the ids (null among them) of more than one row, None if there are none."""
    with scratch(docs.sparkSession) as work, batches_of(docs.sparkSession, BATCH):
        named, odd = _name(docs, percent, width, bands, rows, key, text)
        return work.keep(named), None if odd is None else work.keep(odd)


def _name(docs: DataFrame, percent: int, width: int, bands: int, rows: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialize(source.mapInArrow(_sketch(bands, rows, width), "doc_id long, n_shingles long, node binary, bands array<long>"), "minhash-sketch")
    filled = sketch.where("node IS NOT NULL")
    # A node is in a bucket once, however many documents share its set; its bands are dealt out behind the shuffle.
    nodes = materialize(filled.select("node", "n_shingles", "bands").distinct(), "minhash-nodes")
    slots = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    slots = materialize(slots.join(sizes, "bucket"), "minhash-buckets")
    members = slots.select("node").distinct()
    sigs = materialize(nodes.join(members, "node", "left_semi"), "minhash-signatures")
    first = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(members, "node", "left_semi")
    odd = materialize(sketch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "minhash-odd")
    odd = None if odd.isEmpty() else odd
    alone = first if odd is None else _by_id(first, odd, "left_anti")
    sets = _one_text(source, alone).mapInArrow(_sets(width), "node binary, shingles binary")
    if odd is not None:
        # Such an id does not tell which of its texts has the node's set: all are read.
        each = _by_id(source, odd, "left_semi").select("text").mapInArrow(_each_set(width), "node binary, shingles binary")
        sets = sets.union(each.join(_by_id(first, odd, "left_semi").select("node"), "node", "left_semi").dropDuplicates(["node"]))
    sets = materialize(sets, "minhash-sets")

    small = slots.where(f"n <= {SMALL}")
    pairs = small.select("bucket", F.col("node").alias("x")).join(small.select("bucket", F.col("node").alias("y")), "bucket").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    links = _links(pairs, sigs, sets, percent)
    large = slots.where(f"n > {SMALL}").select("bucket", "band", "node")
    if not large.isEmpty():
        links = _large(large, links, sigs, sets, percent)
    comps = components(links)
    named = sketch.select("doc_id", "n_shingles", "node").join(comps, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("comp", "node").alias("comp"))
    return materialize(named, "minhash-named"), odd


def _by_id(rows: DataFrame, ids: DataFrame, how: str, id: str = "doc_id") -> DataFrame:
    """``rows`` by whether their id is among ``ids``; null is an id as any other."""
    return rows.join(ids.select(F.col("doc_id").alias("_other_id")), F.col(id).eqNullSafe(F.col("_other_id")), how)


def _one_text(source: DataFrame, first: DataFrame) -> DataFrame:
    """(node, text) by the node's smallest doc_id, which one row has."""
    first = first.select("node", F.col("doc_id").alias("_first_id"))
    # By shuffle at every size: ids of all that share a bucket grow with the corpus.
    return first.hint("merge").join(source.hint("merge"), F.col("_first_id").eqNullSafe(F.col("doc_id"))).select("node", "text")


def deduplicate(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id, null the last.

    Rows of one id with texts that are no copies of each other are documents of their own. Of rows that repeat both
    the id and the set one stays; without an id and without words all stay.
    """
    named, odd = _named(docs, percent, width, bands, rows, key, text)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best")
    kept = named.where("comp IS NOT NULL").groupBy("comp").agg(best).select("best.doc_id", "best.node")
    kept = materialize(kept.union(named.where("comp IS NULL").select("doc_id", "node").distinct()), "minhash-kept")
    # The rows travel as one struct, so that no name of theirs can clash; by shuffle at every size, since the ids that
    # stay grow with the corpus.
    tagged = docs.select(F.struct("*").alias("row"), docs[f"`{key}`"].cast("long").alias("row_id"), docs[f"`{text}`"].alias("row_text"))
    if odd is None:
        return _by_id(tagged.hint("merge"), kept.hint("merge"), "left_semi", "row_id").select("row.*")
    alone = _by_id(tagged.hint("merge"), _by_id(kept, odd, "left_anti").hint("merge"), "left_semi", "row_id").select("row")
    many = _by_id(tagged, odd, "left_semi", "row_id").withColumn("row_node", _node(width)(F.col("row_text")))
    many = many.join(_by_id(kept, odd, "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")), F.expr("row_id <=> kept_id AND row_node <=> kept_node"), "left_semi")
    many = materialize(many, "minhash-many")
    bare = "row_id IS NULL AND row_node IS NULL"
    return alone.union(many.where(f"NOT ({bare})").dropDuplicates(["row_id", "row_node"]).select("row")).union(many.where(bare).select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), percent=85, width=3, bands=26, rows=5)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w
), sizes AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s
), e AS (SELECT doc_id, unnest(sh) AS g FROM s
), inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""
