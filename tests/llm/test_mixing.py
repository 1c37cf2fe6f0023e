import collections
import hashlib
import re

from tessera.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Targets by handing out the excess round after round."""
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(WORDS.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), M.SHARE * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= M.CAP * size[s]}
        if not full:
            return size, target | {s: weight[s] * level for s in free}
        target |= {s: M.CAP * size[s] for s in full}
        left -= sum(M.CAP * size[s] for s in full)
        free -= full
    return size, target


def rows():
    out = [(i, "w " * (1 + i * i % 90), f"s{i % 11}" if i % 13 else None) for i in range(600)]
    return out + [(600, None, "void"), (601, "", "void"), (602, "one\ttwo\nthree", "Ärger"), (603, "x " * 20_000, "hot"), (None, "no id", "s1")]


def test_targets_and_copies(spark, tmp_path):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    size, target = brute(data)
    by_id = {r.doc_id: r for r in M.query(spark, str(tmp_path)).collect()}
    assert len(by_id) == len(data)
    for i, text, source in data:
        r, n = by_id[i], len(WORDS.findall(text or ""))
        assert r.size == n and r.source_size == size[source] and abs(r.target - target[source]) <= 1e-6 * max(1, target[source])
        rate = min(2.0, target[source] / size[source]) if size[source] else 0.0
        draw = int(hashlib.md5(f"{M.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.taken == n * (int(rate) + (draw < rate - int(rate))) <= 2 * n


def test_mix_repeats_rows_and_keeps_columns(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, r[1], 1.5) for r in data], "doc_id long, text string, source string, size string, target double")
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 2 and n[600] == n[601] == 0
    assert n == collections.Counter(r.doc_id for r in M.mix(docs.repartition(7)).collect())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0


def test_rates_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    few = sorted(M.mix(docs).collect(), key=str)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(M.mix(docs).collect(), key=str) == few
