import random
import re

from pyspark.sql import functions as F
from tessera.operators import graph, rules, search


def spans(r, n, hot):
    out = []
    for k in range(n):
        a = r.randrange(0, 2000)
        out.append((0 if r.random() < hot else r.randrange(1, 5), f"s{k}", a, a + r.choice([0, 1, 7, 63, 64, 65, 500, 5000])))
    return out


def test_points_and_spans_meet_once(spark):
    r = random.Random(1)
    f, c = spans(r, 120, 0.4), spans(r, 80, 0.4)
    sites = [(0 if r.random() < 0.4 else r.randrange(1, 5), r.randrange(-5, 7500)) for _ in range(150)] + [(0, 10), (0, 10)]
    functions = spark.createDataFrame([*f, (0, "none", 9, 3), (None, "null", 1, 9)], "file long, name string, start_line long, end_line long")
    want = {}
    for file, line in sites:
        around = [(a, n) for g, n, a, b in f if g == file and a <= line <= b]
        if around:
            want[file, line] = min(around)[1]
    got = [(x.file, x.line, x.name) for x in graph.enclosing(spark.createDataFrame(sites, "file long, line long"), functions).collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    changes = spark.createDataFrame([(g, a, b) for g, _, a, b in c], "file long, start_line long, end_line long")
    pairs = sorted((g, n, x, y) for g, n, a, b in f for h, _, x, y in c if g == h and x <= b and y >= a)
    assert sorted((x.file, x.name, x.change_start, x.change_end) for x in graph.overlapping(changes, functions).collect()) == pairs
    assert graph.overlapping(changes.limit(0), functions).count() == graph.enclosing(spark.createDataFrame(sites, "file long, line long"), functions.limit(0)).count() == 0


def test_a_hot_file_is_dealt_out(spark):
    s = spark.range(30_000).selectExpr("0L AS file", "CAST(id AS STRING) AS name", "id * 10 AS start_line", "id * 10 + id % 8 AS end_line")
    p = spark.range(30_000).selectExpr("0L AS file", "id * 10 + 3 AS line")
    met = graph.stabbed(p, s, "file", "line", "start_line", "end_line")
    assert met.count() == sum(k % 8 >= 3 for k in range(30_000))
    level = F.ceil(F.log2((F.col("end_line") - F.col("start_line") + 1).cast("double")))
    largest = s.groupBy(level.alias("level"), F.floor(F.col("start_line") / F.pow(F.lit(2.0), level))).count().agg(F.max("count")).first()[0]
    assert largest <= 8  # rows of one bin, of 30,000 in the file


def test_spans_are_not_broadcast(spark):
    s = spark.range(50).selectExpr("0L AS file", "CAST(id AS STRING) AS name", "id AS start_line", "id + 3 AS end_line")
    c = spark.range(50).selectExpr("0L AS file", "id AS start_line", "id + 1 AS end_line")
    met = graph.overlapping(c, s)
    assert met.count() == sum(a <= b + 3 and b <= a + 1 for a in range(50) for b in range(50))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


PATTERNS = [r"\bfoo\s*\(", r"(?i)Password\w*\s*=", r"a[bc]+d", r"x|y", r"\d{3}-\d{4}", r"(abc)?def", r"end$", r"^start", r"(?:one|two) three", r"\.exec\(", r"q{2}r", r"é+"]


def test_required_texts():
    assert [rules.required(p) for p in PATTERNS] == ["foo", "password", "a", "", "-", "def", "end", "start", " three", ".exec(", "q", ""]


def test_many_rules_in_one_pass(spark):
    r = random.Random(2)
    parts = ["foo (", "PASSWORD1 =", "abcbd", "x", "555-1234", "def", "end", "start", "one three", "two three", "a.exec(b)", "qqr", "éé", " ", "ABCDEF", "\n", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(200)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = [{"id": f"r{k}", "severity": "INFO", "message": f"m{k}", "pattern": p} for k, p in enumerate(PATTERNS)]
    table = spark.createDataFrame([tuple(x.values()) for x in listed], "id string, severity string, message string, pattern string")
    key = lambda df: sorted(tuple(x) for x in df.select("doc_id", "rule", "severity", "message", "line_no").collect())
    got = key(rules.scan_table(docs, table))
    assert got == key(rules.scan(docs, listed)) and len({x[1] for x in got}) == len(PATTERNS)
    assert rules.scan_table(docs, table.limit(0)).count() == rules.scan_table(docs.limit(0), table).count() == 0


def test_generated_rules(spark):
    names = spark.createDataFrame([(t, f"n.{k}" if k % 10 == 0 else f"n{k}") for t in rules.TEMPLATES for k in range(60)] + [("none", "x")], "template string, name string")
    made = rules.generated(names)
    assert made.count() == 300 and rules.check_rules(made).count() == 0
    docs = spark.createDataFrame([(k, f"n{k} (1)\nclass n{k} {{\nn{k} = 2\nn{k} == 2\nimport n{k}\nn.{k}()\nnx{k}()") for k in range(60)], "doc_id long, text string")
    listed = [r.asDict() for r in made.collect()]
    key = lambda df: sorted(tuple(x) for x in df.select("doc_id", "rule", "line_no").collect())
    got = key(rules.scan_table(docs, made))
    assert got == key(rules.scan(docs, listed)) and (7, "call-n7", 1) in got and (7, "definition-n7", 2) in got and (7, "assignment-n7", 4) not in got and (10, "call-n.10", 6) in got
    bad = spark.createDataFrame([("a", "LOUD", "m", "("), (None, "INFO", "", "x")], "id string, severity string, message string, pattern string")
    assert sorted((r.id or "", r.problem[:8]) for r in rules.check_rules(bad).collect()) == [("", "id is mi"), ("", "message "), ("a", "no such "), ("a", "pattern:")]


def test_index_finds_what_the_scan_finds(spark):
    r = random.Random(6)
    common, rare = ["alpha", "beta", "gamma"], [f"rare{k}" for k in range(40)]
    texts = [" ".join(r.choice(common if r.random() < 0.9 else rare) for _ in range(r.randrange(0, 12))) for _ in range(600)] + [None, "", "ALPHA xrare7x", "\talpha\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    index = graph.saved(search.inverted(docs, n_blocks=20))
    total = index.agg(F.sum(F.size("ids"))).first()[0]
    for query, k, threshold in (("alpha", 5, 0.0), ("Alpha beta rare3 alpha", 10, 0.5), ("rare1 nothing", 1000, 0.3), ("nothing", 5, 0.0), ("", 5, 0.0), ("  gamma  rare5 ", 1000, 0.3)):
        got, read = search.best_of_index(index, query, k, threshold)
        scored = docs.where("content IS NOT NULL").select("id", search.containment(F.col("content"), F.lit(query.strip())).alias("score")).where("score > 0") if query.strip() else docs.limit(0).selectExpr("id", "0D AS score")
        want = [(x.id, round(x.score, 9)) for x in scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k).collect()]
        assert sorted((x.id, round(x.score, 9)) for x in got.collect()) == sorted(want), (query, k)
        assert read < total
    assert search.best_of_index(index, "alpha rare7", 1, 0.0)[1] < search.best_of_index(index, "alpha rare7", 1000, 0.0)[1]


def test_rules_are_not_gathered(spark, monkeypatch):
    """However many rules there are, the driver takes only their beginnings and lengths."""
    seen, collect = [], type(spark.range(0)).collect
    made = rules.generated(spark.range(20_000).selectExpr("'text' AS template", "concat('n', id) AS name"))
    docs = spark.createDataFrame([(1, "a n19999 b\nn7"), (2, "N12")], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "collect", lambda df: seen.append(collect(df)) or seen[-1])
        got = rules.scan_table(docs, made)
    assert sum(map(len, seen)) <= 10
    assert sorted((r.doc_id, r.rule, r.line_no) for r in got.collect()) == [(1, f"text-n{n}", 1) for n in (1, 19, 199, 1999, 19999)] + [(1, "text-n7", 2)]


def test_frequent_words_bring_no_sets_together(spark):
    """Sets over few words, so that every word is frequent: what meets is of the order of what is similar."""
    import pyarrow as pa
    from tessera.operators import dedup

    r = random.Random(8)
    sets = [set(r.sample(range(400), 100)) for _ in range(300)]
    for k in range(0, 60, 2):
        sets[k + 1] = set(sorted(sets[k])[r.randrange(0, 25) :])
    rows = [(k, sorted(map(str, s)), len(s)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, words array<string>, n int")
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for percent in (80, 95):
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = {(x.a, x.b): x.similarity for x in dedup.similar_pairs(df, percent).collect()}
        assert set(got) == want and all(abs(v - jaccard(*p)) < 1e-12 for p, v in got.items())
        batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([len(s) for s in sets], pa.int32()), pa.array([[hash((w, 1)) for w in s] for s in sets], pa.list_(pa.int64()))], ["id", "n", "hashes"])
        by = {}
        for out in dedup._signed(percent)([batch]):
            for i, _, _, sig in zip(*[c.to_pylist() for c in out.columns]):
                by.setdefault(sig, set()).add(i)
        assert sum(len(x) * (len(x) - 1) // 2 for x in by.values()) < 300 * 299 // 2


def test_sets_meet_by_their_rarest_words(spark, monkeypatch):
    """Sets of frequent and of rare words, families of similar sets, copies and empty sets: few keys a set, and no pair lost by any path."""
    import pyarrow as pa
    from tessera.operators import dedup

    r = random.Random(9)
    sets = [set(r.sample(range(60), r.randrange(1, 12))) | {1000 * k + w for w in range(r.randrange(0, 90))} for k in range(150)]
    for at in (3, 40):  # families
        sets += [set(x for x in sets[at] if r.random() > 0.08) | {r.randrange(60)} for _ in range(40)]
    sets += [set(sets[k]) for k in range(0, 190, 9)] + [set(), set(r.sample(range(10**6, 2 * 10**6), 5000))]
    sets.append(set(list(sets[-1])[:4200]))
    copies = {}
    for k, s in enumerate(sets):
        copies.setdefault(frozenset(s), k)
    firsts = sorted(copies.values())
    shuffled = [(k, [f"w{w}" for w in sorted(s)], len(s)) for k, s in enumerate(sets)] + [(len(sets), None, None)]
    similarity = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    by_name = spark.createDataFrame([(f"{k:04d}", *x) for k, *x in shuffled], "id string, words array<string>, n int")
    frame = spark.createDataFrame(shuffled, "id long, words array<string>, n int")
    for percent, rare, block, df, name in ((80, 1024, 512, frame, int), (80, 4, 2, frame, int), (95, 30, 3, by_name, "{:04d}".format), (80, 1, 1, by_name, "{:04d}".format)):
        monkeypatch.setattr(dedup, "RARE", rare)
        monkeypatch.setattr(dedup, "BLOCK", block)
        for some in (True, False):
            ids = firsts if some else range(len(sets))
            want = {(name(a), name(b)): similarity(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a]}
            got = {(x.a, x.b): x.similarity for x in dedup.similar_pairs(df, percent, some).collect()}
            assert got == want, (percent, rare, some)
    own = [[hash((w, 1)) for w in s] for s in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.nulls(len(sets), pa.string()), pa.array(own, pa.list_(pa.int64()))], ["id", "digest", "hashes"])
    *_, counted = dedup._marked([batch])
    held = next(dedup._summed([counted.select(["piece", "counts"])]))
    table = spark.sparkContext.broadcast(b"".join(held.column(1).to_pylist()))
    keys = sum(len(x) for out in dedup._keyed(80, table, 1024)([batch.select(["id", "hashes"])]) for x in out.column(1).to_pylist())
    assert keys <= 0.25 * sum(map(len, sets)) + len(sets)  # signatures take more than four for a word


def test_words_of_sets_are_not_dealt_out(spark, monkeypatch):
    """What is shuffled of sets that are not alike is a part of what they hold."""
    from tessera.operators import dedup

    steps, saved = [], dedup.saved
    monkeypatch.setattr(dedup, "saved", lambda df: steps.append((df.columns, (m := saved(df)).count())) or m)
    sets = spark.range(300).selectExpr("id", "transform(sequence(0, 99), k -> concat(if(k % 2 = 0, 'a', cast(id as string)), '-', cast(k as string))) AS words", "100 AS n")
    assert dedup.similar_pairs(sets, 80, True).count() == 0
    assert all("words" not in c for c, _ in steps) and max(n for c, n in steps if "others" in c) <= 1


def test_near_directories_are_found_by_few_beginnings(spark, monkeypatch):
    """Pairs of directories as by hand; no pattern is searched a letter, and keys that no smaller set can meet by are passed over."""
    import contextlib
    import io

    import numpy as np
    from tessera.operators import dedup

    r = random.Random(5)
    paths = [f"{r.choice(['a.example', 'b.example.org', ''])}/{r.choice(['en', 'es'])}/{r.randrange(10 ** r.randrange(1, 5))}/x{k}" for k in range(150)] + ["", "x", "/x", "ä/öü/x", "ä/öß/x"]
    rows = spark.createDataFrame([(k, p, f"only{k}") for k, p in enumerate(paths)], "id long, path string, text string")
    folders = {}
    for k, p in enumerate(paths):
        folders.setdefault(p.rpartition("/")[0], k)
    common = lambda x, y: next((n for n, (v, w) in enumerate(zip(x, y, strict=False)) if v != w), min(len(x), len(y)))
    for near in (0.5, 0.9):
        want = {}
        for x, i in folders.items():
            for y, j in folders.items():
                if i < j and common(x, y) / max(len(x), len(y)) > near:
                    want[i, j] = common(x, y) / max(len(x), len(y))
        got = dedup.overlaps(rows, 80, near).where("proximity IS NOT NULL")
        assert {(x.a, x.b): x.proximity for x in got.collect()} == want and want
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            got.explain()
        assert not re.search(r"aggregate\([^\n]*regexp_replace", out.getvalue())
    tried, least = [], dedup._least_shared
    monkeypatch.setattr(dedup, "_least_shared", lambda percent, both: tried.append(np.size(both)) or least(percent, both))
    late = np.full(3000, 6 << 32 | 1 << 2)  # the second of six words: a set as large has it first too late
    assert not list(dedup._meet(80, np.zeros(3000, np.int64), late, np.arange(3000))) and sum(tried) == 3000
