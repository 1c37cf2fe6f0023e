import random

from tessera.llm import minhash as M
from tessera.llm.components import components


def brute(rows, percent, width):
    sets, parent = {}, {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = [None, "", " \n", "one", "ONE", "one two", "Ä x y", "ä x y"]
    for k in range(60):  # a chain of near copies, some linked through others only
        w = list(base)
        for j in range(k % 9):
            w[(7 * j + k) % 120] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 30 + [" ".join(word() for _ in range(40)) for _ in range(40)]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bands")
    for percent, width, bands, r in ((85, 3, 26, 5), (80, 5, 32, 4)):
        got = M.classes(docs, percent, width, bands, r).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, percent, width)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_deduplicate(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "else"), (4, None), (None, "else here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(M.deduplicate(docs).collect(), key=str) == sorted(spark.createDataFrame([rows[0], *rows[3:]], docs.schema).collect(), key=str)
    assert M.deduplicate(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    words = lambda *n: " ".join(f"w{i}" for i in n)
    a, link, b = words(*range(10)), words(*range(1, 11)), words(*range(2, 12))
    options = {"percent": 80, "width": 1, "bands": 32, "rows": 4}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    # Two chains through rows without id, one null alone and two of them.
    for more in ([], [(None, "else")]):
        got = {r.doc_id: r.component_id for r in M.classes(frame([(1, a), (None, link), (2, b), *more]), **options).collect() if r.doc_id}
        assert got == {1: 1, 2: 1}
    rows = [(None, words(*range(20, 30))), (None, words(*range(21, 31))), (None, "other"), (None, ""), (None, None)]
    rows += [(5, "five a"), (5, "two b"), (2, "two b"), (7, "seven x"), (7, "seven y z q r s"), (8, "seven X"), (9, "nine"), (9, "Nine"), (9, None), (9, None)]
    rows += [(None, words(*range(100, 200), k)) for k in range(20)]
    kept = [tuple(r) for r in M.deduplicate(frame(rows), **options).collect()]
    count = lambda *which: sum(r in which for r in kept)
    assert count(*rows[:2]) == 1 and count(rows[2]) == 1 and count(*rows[3:5]) == 2
    assert count((5, "five a")) == 1 and count((5, "two b")) == 0 and count((2, "two b")) == 1
    assert count((7, "seven x")) == 1 and count((7, "seven y z q r s")) == 1 and count((8, "seven X")) == 0
    assert count((9, "nine"), (9, "Nine")) == 1 and count((9, None)) == 1 and count(*rows[-20:]) == 1 and len(kept) == 11


def test_signature_is_circulant():
    s = M.shingle_set(" ".join(map(str, range(500))), 3)
    sig = M.signature(s, 16)
    ring = M._ring(16)
    assert ring[5, 3] == ring[8, 0] and len(sig) == 16
    assert (sig == M.signature(s[::-1].copy(), 16)).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1050)] + [(7000, 7000)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(1000, 1050)}) == 1 and got[0] != got[1000]


def test_small_and_large_buckets_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = []
    for k in range(50):  # much in common, some alike, some not
        w = list(base)
        for j in r.sample(range(60), k % 12):
            w[j] = word()
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = brute(rows, 60, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(M, "SMALL", 2)
    monkeypatch.setattr(M, "BLOCK", 3)
    got = M.classes(docs, 60, 1, 40, 2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
