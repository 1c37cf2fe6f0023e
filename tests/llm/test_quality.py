import collections
import re

from tessera.llm import quality as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    seen = {i + k for ps in at.values() if len(ps) > 1 for i in ps for k in range(5)}
    n, rep = len(ws), len(seen)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


CLEAN = "The quick reader finds that every plain sentence here carries its own small meaning number {} and then ends in peace."
CASES = [None, "", " \n\t", "one", "a b c d e f a b c d e", "x " * 5000, "Ä ö ü b\nb\nb\n \nb", "a b c d a b c d a b c d e", "#*$ %&|<> ok " * 3, "w" * 300_000]


def rows(spark):
    texts = CASES + [CLEAN.format(i) for i in range(40)] + CASES
    return spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")


def test_features_match_brute_force(spark):
    docs = rows(spark)
    got = {r.doc_id: r for r in Q.features(docs.drop("n_words"), "doc_id").collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r.text)


def test_form_feeds_are_blank_and_f_is_a_word(spark):
    cases = {"a\n\f\n\f": (0, 1), "f\nf": (1, 2), "ff\n\f \nff": (1, 2), "\v\n\v\nb": (0, 1)}
    got = Q.features(spark.createDataFrame([(t,) for t in cases], "text string"), "text").collect()
    assert {r.text: (r.n_dup_lines, r.n_lines) for r in got} == cases
    assert all(r.n_dup_lines == brute(r.text)[3] for r in got)


def test_clean_kept_and_columns_stay(spark):
    docs = rows(spark)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {10 + i for i in range(40)} <= ids
    assert not ids & {i for i, t in enumerate(CASES) if brute(t)[5]}


def test_em_against_plain_python(spark):
    import math

    table = {0: 800, 8: 60, 364: 30, 1: 50, 728: 5, 121: 20}
    m, n = len(Q.RULES), float(sum(table.values()))
    digits = {p: [p // 3**j % 3 for j in range(m)] for p in table}
    good, bad, share = [list(Q.PRIOR_GOOD) for _ in range(m)], [list(Q.PRIOR_BAD) for _ in range(m)], Q.PRIOR_SHARE

    def posterior():
        return {p: 1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(d))))) for p, d in digits.items()}

    for _ in range(Q.STEPS):
        post, pull = posterior(), Q.PRIOR_WEIGHT * n
        new = []
        for weight, prior, s in (({p: c * post[p] for p, c in table.items()}, Q.PRIOR_GOOD, Q.PRIOR_SHARE), ({p: c * (1 - post[p]) for p, c in table.items()}, Q.PRIOR_BAD, 1 - Q.PRIOR_SHARE)):
            mass = sum(weight.values())
            new.append([[(sum(w for p, w in weight.items() if digits[p][j] == v) + s * pull * prior[v]) / (mass + s * pull) for v in range(3)] for j in range(m)])
        share = (sum(c * post[p] for p, c in table.items()) + Q.PRIOR_SHARE * pull) / (n + pull)
        good, bad = new
    want = posterior()
    got = {r.pattern: r.p_good for r in Q.posteriors(spark.createDataFrame(list(table.items()), "pattern int, n long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.keep_good(empty).count() == 0


def test_query_on_no_rows_and_verdicts_end_to_end(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.query(spark, f"{tmp_path}/none").count() == 0
    docs = rows(spark)
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    got = Q.query(spark, f"{tmp_path}/some").collect()
    kept = {r.doc_id for r in Q.keep_good(docs.repartition(3)).collect()}
    assert len(got) == docs.count() and {r.doc_id for r in got if r.kept} == kept
    by_text = {}
    for r in got:
        t = docs.where(f"doc_id = {r.doc_id}").first().text if r.doc_id in (0, 50) else None
        by_text.setdefault(t, set()).add((r.kept, round(r.p_good, 12)))
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.p_good >= Q.THRESHOLD)
