import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import fim as M
from tessera.llm.bytescan import pieces

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text, marks=M.SENTINELS, cut=M.CUT, suffix_first=M.SUFFIX_FIRST, seed=M.SEED):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= cut:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def texts(n, seed=5):
    r = random.Random(seed)
    made = [None, "", "<P>", "<", "a<S>b", "ab" * 2000, "é" * 300, "x" * 255 + "é", "x" * 254 + "日本", "😀" * 70, "<P" * 200 + ">", "a b\n\tc", "<P", "S>", "\0a"]
    return made + ["".join(r.choice(["ab", "Z", " ", "é", "日", "😀", "<", ">", "P", "<M", "1", "\n", "word"]) for _ in range(r.randrange(1, 400))) for _ in range(n)]


def test_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts(400))) + [(None, "no id at all"), (7, "again"), (7, "again"), (-5, "w " * 60_000)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n long, `a.b` string")
    got = M.fill_in_middle(docs).withColumn("back", M.restore(F.col("fim.output"), F.col("fim.form")))
    assert got.columns == ["doc_id", "text", "n", "a.b", "fim", "back"]
    kinds = set()
    for r in got.collect():
        assert tuple(r.fim) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.n == r.doc_id and r["a.b"] == "x"
        kinds.add(r.fim.form)
    assert kinds == {"plain", "psm", "spm"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), n, f, p, m, sha(out), sha(t or "")) for i, t in rows for n, f, p, m, out in [brute(i, t)])
    assert sorted((str(r[0]), *r[1:]) for r in M.query(spark, str(tmp_path)).collect()) == want


def test_options_and_other_sentinels(spark):
    marks = ("[pre]", "[suf]", "[mid]é")
    docs = spark.createDataFrame([(i, (t or "").replace("<P", "[pre").replace("<M", "[mid]")) for i, t in enumerate(texts(80))], "key long, body string")
    got = M.fill_in_middle(docs, "key", "body", "out", marks, cut=100, suffix_first=50, seed="s")
    for r in got.withColumn("back", M.restore(F.col("out.output"), F.col("out.form"), marks)).collect():
        assert tuple(r.out) == brute(r.key, r.body, marks, 100, 50, "s") and r.back == r.body


def test_every_cut_of_a_scan():
    a = M.automaton(M.SENTINELS)
    assert a.memory <= 4
    data = pa.array([t or "" for t in texts(30, 9)])
    for raw, at in pieces(data, 500):
        scan = M.Scan(a, raw, at)
        parts = [raw[x:y].tobytes().decode() for x, y in zip(at, at[1:], strict=False)]
        units = [UNIT.findall(t) for t in parts]
        assert scan.units.tolist() == [len(u) for u in units] and scan.chars.tolist() == [len(t) for t in parts]
        assert (scan.marks > 0).tolist() == [any(m in t for m in M.SENTINELS) for t in parts]
        for k in range(0, max(map(len, units)) + 1, 7):
            byte, char = scan.cut(np.minimum(k, scan.units))
            for d, u in enumerate(units):
                head = "".join(u[:k])
                assert (byte[d] - at[d], char[d]) == (len(head.encode()), len(head))


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "c"), ("ab", "bc", "x"), ("abc", "b", "x"), ("aa", "b", "c")])
def test_sentinels_that_cannot_be_taken_apart(marks):
    with pytest.raises(ValueError):
        M.Automaton(marks)


def test_bytes_that_are_no_text():
    raw = np.frombuffer(b"a\x80\x80b\xc3 \xf0\x9f", np.uint8)
    scan = M.Scan(M.automaton(M.SENTINELS), raw, np.array([0, len(raw)]))
    assert scan.units.tolist() == [7] and scan.chars.tolist() == [7]


def test_empty(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
