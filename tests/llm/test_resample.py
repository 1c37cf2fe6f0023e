import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from tessera.llm import resample as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    ws = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return [" ".join(ws[k : k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)], len(ws)


def brute(docs, target, longest=1, buckets=M.BUCKETS, percent=M.PERCENT, least=M.LEAST_WORDS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t, longest)[0])
    t = collections.Counter(bucket(f) for x in target for f in features(x, longest)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        fs, n = features(text, longest)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{M.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, n, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    may = sorted((r for r in rows if r[3] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, *r[1:4]))
    rank = {id(r): k for k, r in enumerate(may[: percent * len(may) // 100], 1)}
    return sorted([(*r, rank.get(id(r))) for r in rows], key=str)


def rows(n=300):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["alpha", "Beta", "größe", "x1", "日本", "the", "q" * 80]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !!"), (None, "the " * 30), (None, "beta " * 30), (4, "alpha " * 40), (4, "alpha " * 40), (n + 3, "long " * 30_000)]
    return docs, ["the größe the beta", None, "", "x1 the beta alpha"]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 100, 0), (2, 10_000, 33, 5)])
def test_against_brute_force(spark, longest, buckets, percent, least):
    docs, target = rows()
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = M.resample(table, wanted, longest=longest, buckets=buckets, percent=percent, least_words=least)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.n_words, r.score, r["rank"]) for r in got.collect()], key=str) == brute(docs, target, longest, buckets, percent, least)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert M.resample(none, some).count() == M.resample(none, none).count() == 0
    (row,) = M.resample(some, none, percent=100).collect()
    assert row["rank"] == 1 and row.n_features == 40


def test_weigh_keeps_columns(spark):
    gain = M.gains(M.counts(spark.createDataFrame([("a b",)], "text string")), M.counts(spark.createDataFrame([("a a",)], "text string")))
    docs = spark.createDataFrame([("a", "k", 1.5), (None, "k", 2.5)], "body string, `a.b` string, weight double")
    got = M.weigh(docs, gain, "body").collect()
    assert got[0].asDict().keys() == {"body", "a.b", "weight", "resample"} and got[0].weight == 1.5
    assert got[0].resample.n_features == 1 and got[0].resample.weight > 0 == got[1].resample.n_features


def test_draws_follow_the_target(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["sun", "sea"] if i % 5 else ["law", "tax"]) for _ in range(30))) for i in range(1000)], "doc_id long, text string")
    drawn = M.resample(docs, spark.createDataFrame([("law tax law " * 2000,)], "text string")).where("rank IS NOT NULL").collect()
    assert len(drawn) == 100 and sum(x.doc_id % 5 == 0 for x in drawn) >= 95
