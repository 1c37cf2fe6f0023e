import itertools
import random

import pytest
from tessera.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges, start, cut=None):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y != cut and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def brute_tree(edges, root):
    live = reach(edges, root)
    doms = {v: {d for d in live if d in (v, root) or v not in reach(edges, root, d)} for v in live}
    return {v: (max((d for d in doms[v] if d != v), key=lambda d: len(doms[d]), default=None), len(doms[v]) - 1) for v in live}, doms


CASES = [[(0, 1)], [(0, 1), (1, 2), (2, 0), (1, 1), (5, 2), (2, 3), (0, 3)], [(0, 1), (0, 2), (1, 2), (2, 1)], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (2, 5), (9, 4)]]


def cases():
    yield from CASES
    for seed in range(3):
        r = random.Random(seed)
        yield [(r.randrange(14), r.randrange(14)) for _ in range(24 + 4 * seed)]


@pytest.mark.parametrize("edges", [CASES[1], CASES[3], list(cases())[-1]])
def test_dominator_trees_by_cutting(spark, edges):
    want, _ = brute_tree(edges, 0)
    assert {r.id: (r.idom, r.depth) for r in G.dominator_tree(0, frame(spark, edges)).collect()} == want


def test_dominators_are_ancestors(spark):
    doms = brute_tree(CASES[3], 0)[1]
    assert {r.id: set(r.dominators) for r in G.dominators(0, frame(spark, CASES[3])).collect()} == doms


def test_many_graphs_and_a_long_chain(spark):
    every = list(cases())
    rows = [(g, 0, a, b) for g, edges in enumerate(every) for a, b in edges]
    n = 10_000
    chain = [(99, 0, k, k + 1) for k in range(n - 1)] + [(99, 0, k, k // 2) for k in range(n)]
    got = {}
    for r in G.dominator_trees(spark.createDataFrame(rows + chain, "graph long, root long, src long, dst long")).collect():
        got.setdefault(r.graph, {})[r.id] = (r.idom, r.depth)
    for g, edges in enumerate(every):
        want = brute_tree(edges, 0)[0]
        assert got.get(g, want if len(want) == 1 else None) == want
    assert len(got[99]) == n and all(got[99][k] == (k - 1 if k else None, k) for k in range(n))


def all_simple(edges, source, target, depth):
    step, out, todo = {}, [], [[source]]
    for a, b in set(edges):
        step.setdefault(a, []).append(b)
    while todo:
        p = todo.pop()
        for b in step.get(p[-1], ()):
            if b not in p and len(p) <= depth:
                todo.append([*p, b])
                if b == target:
                    out.append([*p, b])
    return sorted((len(p) - 1, p) for p in out)


def test_paths_and_cycles_by_halves(spark):
    r = random.Random(1)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(22)]
    df = frame(spark, edges)
    for depth, most in ((5, 10_000), (4, 3)):
        want = all_simple(edges, 0, 5, depth)[:most]
        assert [(x.length, x.path) for x in G.all_paths(0, 5, df, depth, most).collect()] == want
    assert G.all_paths(3, 3, df).count() == G.all_paths(0, 77, df).count() == 0
    loops = {(1, (a,)) for a, b in edges if a == b}
    for a, b in set(edges):
        if a != b:
            loops |= {(n + 1, tuple(p)) for n, p in all_simple(edges, b, a, 4)}
    rotate = lambda p: p[p.index(min(p)) :] + p[: p.index(min(p))]
    got = [(x.length, tuple(x.cycle)) for x in G.cycles(df, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, rotate(p)) for n, p in loops}
    every = [(x.length, tuple(x.cycle)) for x in G.cycles(df, 5, compat=True).collect()]
    assert len(every) == len(set(every)) and set(every) == {(n, p[k:] + p[:k]) for n, p in loops for k in range(n)}


def test_the_ten_shortest_do_not_need_all(spark, monkeypatch):
    n, rows = 24, []
    dense = [(a, b) for a, b in itertools.permutations(range(n), 2)]
    real = G.saved

    def counted(df):
        out = real(df)
        if "path" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(G, "saved", counted)
    got = [x.path for x in G.all_paths(0, n - 1, frame(spark, dense), 8, 10).collect()]
    assert got == [[0, n - 1]] + [[0, k, n - 1] for k in range(1, 10)]
    assert max(rows) <= n  # of more than 10 ** 8 simple paths


def test_distances_by_labels(spark):
    r = random.Random(1)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(50)]
    ids = r.sample(range(30), 8)
    want = {}
    for a in ids:
        seen, front = {a: 0}, [a]
        for d in range(1, 8):
            front = [y for y in {y for x, y in edges if x in front} if y not in seen]
            seen |= dict.fromkeys(front, d)
        for depth in (1, 7):
            want |= {(depth, a, b): d for b, d in seen.items() if b in ids and b != a and d <= depth}
    for depth in (1, 7):
        got = G.distances(spark.createDataFrame([(i,) for i in ids], "id long"), frame(spark, edges), depth)
        assert {(depth, x.start, x.id): x.distance for x in got.collect()} == {k: d for k, d in want.items() if k[0] == depth}


def test_labels_hold_half_of_the_depth(spark):
    chain = frame(spark, [(k, k + 1) for k in range(400)])
    ids = spark.createDataFrame([(k,) for k in range(0, 400, 10)], "id long")
    got = {(x.start, x.id): x.distance for x in G.distances(ids, chain, 20).collect()}
    assert got == {(a, b): b - a for a in range(0, 400, 10) for b in (a + 10, a + 20) if b < 400}


def test_flows_walk_only_towards_uses(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 4), (2, 9), (9, 10), (7, 4)])
    row = lambda *rows: spark.createDataFrame(list(rows), "id long, name string")
    got = G.flows(row((1, "x"), (7, "y"), (9, "z")), row((4, "x"), (4, "y"), (1, "x")), edges)
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, 4), ("y", 7, 4)]


def test_steps_are_removed(spark):
    kept = G.dominator_tree(0, frame(spark, [(0, 1), (1, 2)])).collect()
    assert len(kept) == 3 and G.forget(spark) > 0 and G.forget(spark) == 0


def test_communities_end_where_labels_do(spark):
    def brute(edges):
        around = {}
        for a, b in set(edges) | {(b, a) for a, b in edges}:
            around.setdefault(a, set()).add(b)
        states = [{v: v for v in around}]
        while True:
            now = {}
            for v, near in around.items():
                votes = [states[-1][w] for w in near]
                now[v] = min(set(votes), key=lambda c: (-votes.count(c), c))
            if now == states[-1]:
                return now
            if len(states) > 1 and now == states[-2]:
                return now if len(states) % 2 == 0 else states[-1]
            states.append(now)

    r = random.Random(4)
    for edges in ([(0, 1)], [(r.randrange(30), r.randrange(30)) for _ in range(60)]):
        want = brute(edges)
        assert {x.id: x.community for x in G.communities(frame(spark, edges), least=1).collect()} == want
