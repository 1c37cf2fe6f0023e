import hashlib
import itertools
import re

import numpy as np
from tessera.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


CASES = [
    None, "", "no data", "a@b.c_d@e.f x@y @z.w a@@b.c q@r..s", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 1.2.3 1.2.3.4", "4465758382889437 4465758382889437",
    "é 4785380592391139$$$ +1 (743) 555-3824 4785380592391139", "+1 (743) 555-3824 x +12 +1-2 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 (8)", "😀 a.b%c@d-e.org 4785-3805 9239 1139", "9" * 4000, "a" * 20000, "@" * 2000, "1." * 5000, "x.y@z." * 300,
]


def test_base_matches_the_patterns():
    for t in CASES:
        assert sorted(P.base_spans(t or "")) == sorted(brute(t))
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("1234+@.- (a)é"), 30))
        assert sorted(P.base_spans(t)) == sorted(brute(t)), t


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(20):
        e, m = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        best = max(itertools.product(range(3), repeat=5), key=lambda y: sum(e[k, v] for k, v in enumerate(y)) + sum(m[a, b] for a, b in zip(y, y[1:])))
        assert tuple(P.viterbi(e[None], m)[0]) == best


def test_field_on_held_out_rows_and_by_stretches():
    field = P.trained()
    decoder, hit, n = P.Decoder(field), 0, 0
    assert decoder.sparse
    for tokens, labels in P.labelled_table(200, seed=31):
        s = [field.of(t) for t in tokens] + [np.zeros((3, len(P.LABELS)))]
        e = np.stack([s[k - 1][0] + s[k][1] + s[k + 1][2] for k in range(len(tokens))])
        path = P.viterbi(e[None], field.moves)[0]
        hit, n = hit + sum(P.LABELS[y] == x for y, x in zip(path, labels)), n + len(labels)
        at = np.cumsum([0] + [len(t) + 1 for t in tokens])
        assert decoder.paths([" ".join(tokens)])[0] == [(at[k], at[k] + len(tokens[k]), y) for k, y in enumerate(path) if y]
    assert hit / n > 0.98


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, pii_note string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in P.query(spark, str(tmp_path)).collect():
        want = brute(CASES[r.doc_id])
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1])))
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in P.KINDS)
        assert set(joined(want).split(",")) - {""} <= set(r.spans.split(","))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org or 4465758382889437 4465758382889437.", 5), (2, None, 6), (3, "clean 12", 7)], "doc_id long, text string, kind long")
    got = {r.doc_id: r.text for r in P.redact(docs).collect()}
    assert got == {1: "mail <EMAIL> or <CARD> <CARD>.", 2: None, 3: "clean 12"}
    assert P.redact(docs).columns == docs.columns


def test_spans_of_numbers_in_brackets():
    decoder = P.Decoder(P.trained())
    cases = {
        "call (743) 555-3824 or": ["(743) 555-3824"],
        "call (743) 555-3824, or (555) 743-1234.": ["(743) 555-3824", "(555) 743-1234"],
        "call ((743) 555-3824) or": ["(743) 555-3824"],
        "+1 (743) 555-3824 +44 (200) 555-9999": ["+1 (743) 555-3824", "+44 (200) 555-9999"],
        "call (743)\n555-3824": ["(743)", "555-3824"],
    }
    for text, want in cases.items():
        assert [text[a:b] for k, a, b in decoder.spans([text])[0] if k == "phone"] == want, text


def test_safe_tokens_have_all_shapes():
    safe = {tuple(P.shape(t)) for t in P._SAFE}
    rng = np.random.default_rng(4)
    words = ["email", "mail", "e-mail", "contact", "write", "phone", "tel", "call", "mobile", "fax", "card", "visa", "credit", "ip", "host", "address", "server", "Mail", "VISA", "E-MAIL", "x", "é", "٣", "x٣", "-", "_", "..", "(", "()", "#", "+", "½", "w" * 64, "w" * 65, "-" * 70]
    for _ in range(5000):
        t = "".join(rng.choice(words) for _ in range(rng.integers(1, 3))) + str(rng.choice(["", ".", ")", "'s", "-"]))
        assert tuple(P.shape(t)) in safe, t


def test_no_rows_repeated_rows_and_names(spark):
    schema = "doc_id long, text string, pii_spans int"
    assert P.redact(spark.createDataFrame([], schema)).count() == 0 and P.find(spark.createDataFrame([], schema)).count() == 0
    got = P.find(spark.createDataFrame([(1, "a@b.org", 5)] * 2, schema)).collect()
    assert [[(s.kind, s.start, s.end) for s in r.pii_spans] for r in got] == [[("email", 0, 7)]] * 2
