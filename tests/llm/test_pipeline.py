import random

import corpus_pipeline as C
from tessera.llm import mixing, pii, quality, wfst
from tests.llm.test_minhash import brute as classes
from tests.llm.test_quality import brute as rules


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) + "." for _ in range(60)]
    texts += texts[:10] + [texts[0].replace(texts[0].split()[30], "changed"), "few words", None, "", texts[3] + " a@b.example.org +1 (743) 555-3824 x"]
    texts += ["### $$$ %%% " * 40]
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


def test_stages_against_plain_python(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = corpus()
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    good = quality.keep_good(docs)
    kept = {r.doc_id for r in good.collect()}
    assert {i for i, t in text.items() if i < 60} <= kept and not any(rules(text[i])[5] for i in kept)
    unique = {i for i, (_, least) in classes([(i, text[i]) for i in sorted(kept)], 80, 5).items() if i == least}
    stage = C.near_duplicates(spark, good, "")
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == unique
    decoder, machine = pii.Decoder(pii.trained()), wfst.Machine(wfst.model_bytes())
    result = C.run(spark, str(tmp_path)).collect()
    got = {}
    for r in result:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) <= unique
    for i, same in got.items():
        assert len({(r.text, tuple(r.ids)) for r in same}) == 1
        assert not pii.all_spans(decoder, [same[0].text])[0] and machine.encode(same[0].text).tolist() == same[0].ids and same[0].n_ids == len(same[0].ids)
    mixed, name = mixing.with_rates(C.personal_data(spark, stage, ""))
    want = {r.doc_id: r[name].copies for r in mixed.collect()}
    assert {i: len(x) for i, x in got.items()} == {i: n for i, n in want.items() if n}


def test_pipeline_on_no_rows_and_clashing_names(spark, tmp_path):
    odd = ["a.b", "we`ird", "_row_id", "_other_id", "_kept_id", "row", "row_id", "row_source", "kept_node", "rated"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, size int, node string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in odd)
    text = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, text, "en", "a", 5, "old", 1, "n"), (1, text, "en", "a", 5, "old", 1, "n"), (None, text.replace("word3", "other"), None, None, None, None, None, None), (3, None, "en", "a", 0, "", 0, "")]
    rows = [(*r, *[f"keep {c}" for c in odd]) for r in rows]
    for name, data in (("none", []), ("some", rows)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
    got = C.run(spark, f"{tmp_path}/some")
    assert got.columns == [*spark.createDataFrame([], schema).columns, "n_ids"]
    machine = wfst.Machine(wfst.model_bytes())
    assert all([r[c] for c in odd] == [f"keep {c}" for c in odd] for r in got.collect()) and got.count() > 0
    assert {r.doc_id for r in got.collect()} <= {1, None} and all(r.ids == machine.encode(r.text).tolist() for r in got.collect())
