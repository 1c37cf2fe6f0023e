import collections

from tessera.llm import chat as C


def brute(rows):
    key = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    turns = collections.defaultdict(list)
    for conv, turn, role, said in rows:
        turns[conv].append((turn, role, said))
    logged = {c: tuple((r, s) for _, r, s in sorted(ts, key=lambda t: (key(t[0]), text(t[1]), text(t[2])))) for c, ts in turns.items()}
    same = collections.defaultdict(list)
    for c, ts in logged.items():
        same[ts].append(c)
    prefixes = {ts[:k] for ts in same for k in range(1, len(ts))}
    out = {}
    for ts, convs in same.items():
        if ts not in prefixes:
            known = [c for c in convs if c is not None]
            chat = "".join(f"{C.OPEN}{r or ''}\n{s or ''}{C.CLOSE}" for r, s in ts)
            out[min(known) if known else None] = (len(ts), len(convs), chat)
    return out


def rows():
    said = [("system", "be brief"), ("user", "hello"), ("assistant", "hi"), ("user", "why?"), ("assistant", "because " * 2000)]
    out = [(c, k, *said[k]) for c, n in ((1, 2), (2, 3), (3, 5), (4, 5), (5, 1)) for k in range(n)]
    out += [(6, 0, "user", "hello"), (6, 1, "assistant", "other"), (7, 0, "user", "hello")]
    out += [(8, 0, None, "x"), (9, 0, "", "x"), (10, 0, "user", None), (11, 0, "user", "")]  # null is no empty string
    out += [(12, None, "user", "first"), (12, 3, "user", "b"), (12, 3, "user", "a"), (13, None, "user", "first")]
    out += [(14, 0, "user", "twice"), (14, 0, "user", "twice"), (15, 0, "user", "twice")]
    out += [(None, 0, "user", "nobody"), (None, 1, "user", "knows")]
    return out


def test_against_plain_python(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(*r, 7) for r in data], "conv_id long, turn int, role string, text string, k int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.n_same, r.chat) for r in C.query(spark, str(tmp_path)).collect()}
    want = brute(data)
    assert got == want
    assert {3, 6, 8, 9, 10, 11, 12, 14, None} == set(want) and want[3][1] == 2


def test_only_built_in_functions(spark):
    turns = spark.createDataFrame(rows(), "conv_id long, turn int, role string, text string")
    plan = C.collapse(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert C.collapse(empty).count() == 0


def test_other_columns_and_repeated_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", 5)] * 2, "conv_id long, turn int, role string, text string, chat string, n_turns int")
    assert [tuple(r) for r in C.collapse(turns).collect()] == [(1, 2, 1, f"{C.OPEN}user\na{C.CLOSE}" * 2)]
