import random

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tessera.llm import wfst as S

TEXTS = [None, "", " ", "  a  b ", "\n", "a\n\nb \n c", "<0x0A> </s> <s> <unk>", "▁ ▁▁x", "naïve 😀 ̀́ ß", "x" * 3000, "1234567890 " * 50, "tab\t\r\n", " end "]


def texts(n=400):
    r = random.Random(4)
    letters = list("abcdeé ▁\n\t<0x>ñßthe  ing😀12")
    return TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_merge_model_equals_the_library():
    machine = S.Machine(S.model_bytes())
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for t in texts():
        ids = machine.encode(t or "").tolist()
        assert ids == lib.encode(t or ""), repr(t)
        assert machine.decode(ids) == lib.decode(ids), repr(t)
    for t in ["the same words again and again"] * 2:
        assert machine.encode(t).tolist() == lib.encode(t)


def test_unigram_model_takes_the_shortest_path():
    m = pb.ModelProto.FromString(S.model_bytes())
    m.trainer_spec.model_type = 1
    machine = S.Machine(m.SerializeToString())

    def best(word):
        if not word:
            return 0.0
        return max((machine.score[machine.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in machine.ids), default=-S.INF)

    for t in ["hello", "the", "thing", "abcdefg", "naïve"]:
        ids = machine.encode(t).tolist()
        assert sum(machine.score[k] for k in ids) == best("▁" + t) and machine.decode(ids) == t


def test_bytes_that_are_no_text():
    machine = S.Machine(S.model_bytes())
    assert machine.decode([machine.bytes[0xFF], machine.bytes[0x41]]) == "�A"


def test_query_and_columns(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, n_ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.query(spark, str(tmp_path)).collect()}
    assert all(got[i].round_trip for i, t, _ in rows if "▁" not in (t or "")) and got[0].ids == [] and len(got) == len(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "n_ids")
    back = S.decode(S.encode(docs).drop("text"))
    assert sorted(back.columns) == ["doc_id", "ids", "n_ids", "text"]
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id not in (6, 7)} == {i: t or "" for i, t, _ in rows if i not in (6, 7)}
    assert S.encode(docs.limit(0)).count() == 0


def test_unigram_scores_equal_the_library():
    m = pb.ModelProto.FromString(S.model_bytes())
    m.trainer_spec.model_type = 1
    machine, lib = S.Machine(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    score = lambda ids: sum(machine.floor if k in machine.bytes.values() else machine.score[k] for k in ids)
    for t in texts(300) + ["several words of one text, and more of them", "naïve façade 😀 ok"]:
        ids, want = machine.encode(t or "").tolist(), lib.encode(t or "")
        assert machine.decode(ids) == lib.decode(want) and abs(score(ids) - score(want)) <= 1e-3 * max(1, abs(score(want))), repr(t)


def test_character_maps_are_compiled():
    r = random.Random(3)
    letters = list("aéＡ①ﬁ́̈ｶﾞ㌢ 　\t\nx​ß가…½")
    for rule in ("nmt_nfkc", "nfkc_cf", "nfkc"):
        spec = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec
        for prefix, shorten in ((True, True), (True, False), (False, False), (False, True)):
            m = pb.ModelProto.FromString(S.model_bytes())
            m.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
            m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = prefix, shorten
            raw = m.SerializeToString()
            machine, lib = S.Machine(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
            for t in ["", " ", "  a  b ", "​", "ﬁ ﬁ", *("".join(r.choice(letters) for _ in range(r.randint(1, 20))) for _ in range(150))]:
                ids = machine.encode(t).tolist()
                assert machine.normal(t) == lib.normalize(t), (rule, prefix, shorten, t)
                assert ids == lib.encode(t) and machine.decode(ids) == lib.decode(ids), (rule, prefix, shorten, t)


def test_long_and_repeated_texts_and_names(spark):
    long = "word and more of it, é\n" * 20_000
    rows = [(1, long, "x"), (1, long, "x"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encode(docs)
    assert got.columns == docs.columns
    ids = [r.ids for r in got.orderBy("doc_id").collect()]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert ids[0] == ids[1] == lib.encode(long) and ids[2] == []
    assert [r.text for r in S.decode(got.select("doc_id", "text", "ids")).orderBy("doc_id").collect()] == [long, long, ""]
