import random
import re

import pytest
from tessera.llm import licenses as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ends(elements, ws, at):
    """All places where a match of the elements from ``at`` can end."""
    found = {at}
    for kind, *rest in elements:
        step = set()
        for p in found:
            if kind == "word":
                step |= {p + 1} if p < len(ws) and ws[p].encode() == rest[0] else set()
            elif kind == "optional":
                step |= {p} | ends(rest[0], ws, p)
            elif kind == "any":
                step |= {p + n for n in range(rest[0], rest[1] + 1) if p + n <= len(ws)}
            else:
                step |= {e for alternative in rest[0] for e in ends([("word", w) for w in alternative], ws, p)}
        found = step
    return found


def brute(text, templates):
    ws, out, score = words(text), [], 0.0
    for t in templates:
        elements, p, covered = M.parse(t.markup), 0, 0
        while p < len(ws):
            e = max(ends(elements, ws, p), default=-1)
            if e > p:
                out.append((t.label, t.base, p, e))
                covered += e - p
            p = max(p + 1, e)
        score = max(score, covered / len(ws) if ws else 0.0)
    return len(ws), sorted(out), score


SMALL = (
    M.Template("plain", "a b", True),
    M.Template("option", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"),
    M.Template("any", 'b <<var;words="0-3">> d <<var;words="1">>'),
    M.Template("one", 'c <<var;match="a|b a|b a d">> d'),
    M.Template("lead", "<<beginOptional>>c<<endOptional>> d d"),
    M.Template("chain", 'a <<beginOptional>>b<<endOptional>> <<var;words="0-2">> <<beginOptional>>c <<var;words="2-4">><<endOptional>> é1'),
)


def test_against_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "A", "é1", "É1", "x"]) for _ in range(r.randrange(0, 60))) for _ in range(400)]
    texts += [None, "", "...", "a", "a.b", "a b" * 3, "z" * 3000 + " a b", "a b " * 20_000]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, `a.b` string").repartition(3)
    got = M.scan(docs, SMALL).collect()
    assert len(got) == len(texts)
    for row in got:
        n, found, score = brute(row.text, SMALL)
        assert (row.license.n_words, sorted(tuple(m) for m in row.license.matches)) == (n, found) and abs(row.license.score - score) < 1e-12
        assert row.n_words == 5 and row["a.b"] == "k"


def variants():
    for t in M.TEMPLATES:
        def fill(elements, optional, t=t):
            out = []
            for kind, *rest in elements:
                if kind == "word":
                    out.append((rest[0].decode(), True))
                elif kind == "optional":
                    out += [(w, False) for w, _ in fill(rest[0], optional)] if optional else []
                elif kind == "any":
                    out += [(f"name{k}", False) for k in range(rest[1] if optional else rest[0])]
                else:
                    out += [(w.decode(), False) for w in rest[0][-1 if optional else 0]]
            return out
        for optional in (False, True):
            yield t, fill(M.parse(t.markup), optional)


def test_every_template_takes_its_wordings_and_no_other(spark):
    rows, want = [], []
    for t, filled in variants():
        text = [w for w, _ in filled]
        rows.append(" ".join(["Before:", *text, "behind"]).upper())
        want.append((t.label, True))
        must = [k for k, (_, mandatory) in enumerate(filled) if mandatory]
        for k in (must[0], must[len(must) // 2], must[-1]):
            rows.append(" ".join([*text[:k], "otherwise", *text[k + 1 :]]))
            want.append((t.label, False))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in M.scan(docs).collect():
        label, there = want[r.doc_id]
        assert (label in {m.label for m in r.license.matches}) == there, (label, r.text)
        if there:
            longest = max(m.end - m.start for m in r.license.matches if m.label == label)
            assert longest == r.license.n_words - 2, label


def test_query_against_brute_force(spark, tmp_path):
    texts = ["Released under the MIT License.", "GNU General Public License, Apache-License", "mit\nlicense mit license", None, "", "licensed under CC BY-NC 4.0", "General Public Licenses", "the mit License of the general public license mit license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in M.query(spark, str(tmp_path)).collect():
        n, found, score = brute(texts[r.doc_id], M.BASE + M.TEMPLATES)
        base = [m for m in found if m[1]]
        starts = [m[2] for m in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({m[0] for m in base})) and r.labels == ",".join(sorted({m[0] for m in found}))
        assert abs(r.score - score) < 1e-12


@pytest.mark.parametrize("markup", ["a <<beginOptional>> b", "a <<endOptional>>", "a <<what>>", '<<var;words="0-2">> a', "<<beginOptional>>a<<endOptional>>", ""])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        M.Automaton.of(M.Template("bad", markup))


def test_empty(spark):
    assert M.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
