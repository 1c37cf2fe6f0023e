import json
import random
import zlib

import numpy as np
import public_tokenizers
from tessera.llm import arrow_tokens as A
from tokenizers import Tokenizer

TEXTS = [None, "", " ", "Hello  world\n\nit's 2024!", "a\x1cb c d é ΑΣ Σ", "<|endoftext|> x<|startoftext|>y", "naïve façade 😀 ###$$$", "tab\there\r\nnext", "x" * 5000, "the quick brown fox " * 3000]


def test_files_against_the_library(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab Z'é\n\t1.-’") for _ in range(200)) for _ in range(100)]
    rows = [(i * 3, t, 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    manifest = A.write(docs, folder=f"file://{tmp_path}/out", length=64)
    got = {r.doc_id: r for r in A.read(manifest).collect()}
    start = 0
    for i, t, _ in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    for r in manifest.collect():
        f = A.TokenFile(r.file)
        ids, mask = f.sequence(0)
        assert len(ids) == len(mask) == 64 and not ids.flags.owndata
        assert sum(int(b.column(1).flatten().true_count) for b in f.batches) == r.n_ids


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.read(A.write(empty)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "x"), (1, "b a"), (1, "b a"), (1, None)]
    got = A.read(A.write(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = json.load(f)
    assert A.splits_at_space(json.dumps(definition))
    cased, threes, marked = (json.loads(json.dumps(definition)) for _ in range(3))
    cased["normalizer"]["normalizers"].pop()
    threes["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = threes["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[\p{N}]|", r"[\p{N}]{1,3}|")
    marked["added_tokens"].append({"id": 49408, "content": "world", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False})
    for d in (cased, threes, marked):
        text = json.dumps(d)
        assert not A.splits_at_space(text)
        tok, texts = Tokenizer.from_str(text), ["Hello World 2024", "the new world", "12345 Ab", "", "a\n\tb"]
        got = [np.frombuffer(x, np.uint32 if A._is_wide(text, 1) else np.uint16).tolist() for x in A.Encoder(text, A._is_wide(text, 1))(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_fill_several_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(None, f"text {i}", 0, 0) for i in range(400)], "doc_id long, text string, file int, base int").repartition(4)
    manifest = A.write(docs, length=16)
    rows = A.read(manifest).orderBy("start").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and len(rows) == 400
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
