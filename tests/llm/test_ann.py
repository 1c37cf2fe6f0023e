import numpy as np
from tessera.llm import ann as A


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for i, q in good:
        if i % every == 0 and i not in out:
            s = sorted((-(x * q).sum(), j) for j, x in good if j != i)[:k]
            out[i] = [(r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return out


def rows():
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[40:120] = v[7]  # ties
    out = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return [*out, (900, None), (901, []), (920, [0.0] * 8), (921, [1.0, None] + [0.0] * 6), (922, [float("nan")] * 8), (None, [1.0] * 8), (940, [float("inf")] * 8), (960, [1.0])]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_one_part_is_exact(spark):
    data = rows()
    got = collected(A.search(spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, part int")))
    want = brute(data, 20, 20)
    assert got.keys() == want.keys()
    for q, x in want.items():
        assert [a[:2] for a in got[q]] == [a[:2] for a in x] and np.allclose([a[2] for a in got[q]], [a[2] for a in x], atol=1e-12)


def test_parts_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS_PER_PART", 128)
    monkeypatch.setattr(A, "BLOCK", 50)
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8))
    v = (centres[r.integers(0, 40, 2000)] + 0.2 * r.normal(size=(2000, 8))).astype(np.float32)
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    got, want = collected(A.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"))), brute(data, 20, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hit = sum(len({a[1] for a in got[q]} & {a[1] for a in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert A.search(spark.createDataFrame([], schema)).count() == 0
    got = collected(A.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], schema)))
    assert {q: [a[1] for a in x] for q, x in got.items()} == {0: [1, 2]}


def test_parts_are_balanced():
    x = np.random.default_rng(3).normal(size=(1000, 6))
    sizes = np.bincount(A.balanced_parts(x, A.neighbours(x, 10), 8), minlength=8)
    assert sizes.max() - sizes.min() <= 3


def test_levels_of_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 300)
    monkeypatch.setattr(A, "SAMPLE", 600)
    seen, split = {}, A._split

    def watched(*args):
        filed, routers = split(*args)
        seen.update(levels=len(routers), parts=filed.select("part").distinct().count(), rows=filed.count())
        return filed, routers

    monkeypatch.setattr(A, "_split", watched)
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 8))
    v = (centres[r.integers(0, 60, 3000)] + 0.2 * r.normal(size=(3000, 8))).astype(np.float32)
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    got = collected(A.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), part_rows=32))
    want = brute(data, 20, 20)
    assert seen["levels"] >= 2 and seen["parts"] > 8 and seen["rows"] == 3000
    hit = sum(len({a[1] for a in got[q]} & {a[1] for a in want[q]}) for q in want)
    assert got.keys() == want.keys() and hit / (20 * len(want)) >= 0.9


def test_repeated_rows_and_clashing_columns(spark):
    same = [(i, [1.0, 0.0]) for i in range(100)]  # a vector that most rows share
    data = [*same, (20, [1.0, 0.0]), (200, [0.0, 1.0]), (200, [0.5, 0.5]), (7, [0.9, 0.1]), (7, [0.9, 0.1])]
    got = collected(A.search(spark.createDataFrame([(*r, 0, "x") for r in data], "vec_id long, embedding array<float>, n int, part string"), k=3, part_rows=8))
    assert [a[1] for a in got[20]] == [0, 1, 2] and [a[1] for a in got[0]] == [1, 2, 3]
    assert [a[1] for a in got[200]] == [7, 0, 1] and set(got) == {0, 20, 40, 60, 80, 200}  # its least vector asks


def test_a_query_comes_once_to_the_parts_of_a_part(spark, monkeypatch):
    seen, search = [], A._search

    def watched(filed, sent, k):
        seen.append((sent.count(), sent.select("query_id", "part").distinct().count(), filed.select("part").distinct().count()))
        found = search(filed, sent, k)
        seen.append(found.groupBy("query_id").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(A, "_search", watched)
    v = np.random.default_rng(4).normal(size=(1500, 8)).astype(np.float32)  # no clusters, so most parts are visited
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    assert len(collected(A.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), part_rows=64))) == 75
    assert seen[0][0] == seen[0][1] == 75 and seen[0][2] >= 8 and seen[1] == 1  # one block of rows holds all parts
