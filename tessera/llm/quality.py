"""Quality rules with weak supervision, in DataFrame functions only.

Each rule votes good, bad or nothing on a document. Expectation-maximisation over the table of vote patterns
estimates how each rule votes on good and on bad documents, and the posterior probability of good decides, in place
of demanding that a document pass every rule. Documents are reduced to their vote pattern on the map side: the
pattern table has at most 3 ** rules rows whatever the corpus holds, so the model is fitted to all documents in one
row and its verdicts are broadcast.

Defined cases: null or empty text has no words and fails the base rules; a text of white space likewise; equal rows
get equal verdicts; an empty table gives an empty result; extra columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Words of a window; least words; largest share of repeated words, in percent.
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

#: name: (good if, bad if); neither is an abstention. Conditions are over the features below.
RULES = {
    "length": ("n_words >= 50", f"n_words < {LEAST_WORDS}"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", f"100 * n_repeat_words > {MOST_REPEATED} * n_words"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 12 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "symbols": ("20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    "symbol_chars": ("100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    "letters": ("4 * n_letters >= 3 * word_chars", "10 * n_letters < 7 * word_chars"),
    "lines": ("5 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    "shouting": ("5 * n_upper <= n_letters", "2 * n_upper > n_letters"),
}
#: Chances of (good, bad, no) votes before any data, by class; and of good documents.
PRIOR_GOOD = (0.87, 0.01, 0.12)
PRIOR_BAD = (0.45, 0.40, 0.15)
PRIOR_SHARE = 0.85
#: The prior weighs as much as this share of the documents, so that its pull does not fade or grow with the corpus.
PRIOR_WEIGHT = 0.5
STEPS = 25
THRESHOLD = 0.5

_REPEATED = """
CASE WHEN size(ws) < 6 THEN 0L ELSE element_at(transform(
  array(transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]))),
  hs -> CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE element_at(transform(
    array(sort_array(transform(hs, (h, i) -> struct(h, array_join(slice(ws, i + 1, 5), ' ') AS s, i AS p)))),
    srt -> aggregate(
      sort_array(transform(filter(srt, (x, k) -> coalesce(x.h = get(srt, k - 1).h AND x.s = get(srt, k - 1).s, false)
                                              OR coalesce(x.h = get(srt, k + 1).h AND x.s = get(srt, k + 1).s, false)), x -> x.p)),
      struct(0L AS n, -9 AS last),
      (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last),
      a -> a.n)), 1) END), 1) END
"""
_FEATURES = rf"""
inline(transform(array(coalesce(text, '')), t -> element_at(transform(
  array(filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')),
  ws -> element_at(transform(
    array(filter(split(t, '\n'), l -> translate(l, ' \t\n\u000b\u000c\r', '') <> '')),
    ls -> element_at(transform(array(regexp_replace(t, '\\P{{L}}+', '')), lt -> struct(
      CAST(size(ws) AS BIGINT) AS n_words,
      CAST(length(array_join(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(size(ls) - size(array_distinct(ls)) AS BIGINT) AS n_dup_lines,
      {_REPEATED} AS n_repeat_words,
      CAST(size(ls) AS BIGINT) AS n_lines,
      CAST(length(lt) AS BIGINT) AS n_letters,
      CAST(length(regexp_replace(lt, '\\P{{Lu}}+', '')) AS BIGINT) AS n_upper)), 1)), 1)), 1)))
"""
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def _pattern() -> str:
    """The votes as one number, a base-3 digit a rule: 0 good, 1 bad, 2 none."""
    digits = [f"(CASE WHEN {good} THEN 0 WHEN {bad} THEN 1 ELSE 2 END) * {3**k}" for k, (good, bad) in enumerate(RULES.values())]
    return " + ".join(digits)


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry``, the features and the vote pattern of each document. Windows are sorted inside the row, so nothing is shuffled."""
    got = docs.selectExpr(*[f"`{c}`" for c in carry], _FEATURES)
    failed = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    return got.selectExpr("*", f"({failed}) AS base_failed", f"CAST({_pattern()} AS INT) AS pattern")


def posteriors(patterns: DataFrame) -> DataFrame:
    """(pattern, p_good) for rows of (pattern, n), by expectation-maximisation inside one row of at most 3 ** rules entries.

    The state holds log chances of each vote of each rule for both classes and the share of good documents.
    """
    m = len(RULES)
    good = ", ".join(str(float(x)) + "D" for _ in range(m) for x in PRIOR_GOOD)
    bad = ", ".join(str(float(x)) + "D" for _ in range(m) for x in PRIOR_BAD)
    digit = "CAST(floor(x.pattern / pow(3, j)) AS INT) % 3"
    # Log odds of good for a pattern under state s.
    odds = f"aggregate(sequence(0, {m - 1}), ln(s.share) - ln(1 - s.share), (o, j) -> o + ln(s.good[3 * j + {digit}]) - ln(s.bad[3 * j + {digit}]))"
    p_good = f"1 / (1 + exp(-({odds})))"
    pull = f"{PRIOR_WEIGHT} * total"

    def rates(weight: str, prior: str, share: float) -> str:
        mass = f"aggregate(ps, 0D, (a, x) -> a + {weight})"
        hits = f"aggregate(ps, 0D, (a, x) -> a + IF({digit} = v, {weight}, 0D))"
        return f"flatten(transform(sequence(0, {m - 1}), j -> transform(sequence(0, 2), v -> ({hits} + {share}D * {pull} * {prior}[3 * j + v]) / ({mass} + {share}D * {pull}))))"

    step = f"""
      element_at(transform(array(transform(rows, x -> struct(x.pattern AS pattern, x.n AS n, {p_good} AS p))), ps -> struct(
        {rates("x.n * x.p", f"array({good})", PRIOR_SHARE)} AS good,
        {rates("x.n * (1 - x.p)", f"array({bad})", 1 - PRIOR_SHARE)} AS bad,
        (aggregate(ps, 0D, (a, x) -> a + x.n * x.p) + {PRIOR_SHARE}D * {pull}) / (total + {pull}) AS share)), 1)"""
    fitted = f"aggregate(sequence(1, {STEPS}), struct(array({good}) AS good, array({bad}) AS bad, {PRIOR_SHARE}D AS share), (s, k) -> {step})"
    one = patterns.agg(F.expr("sort_array(collect_list(struct(pattern, CAST(n AS DOUBLE) AS n)))").alias("rows"), F.sum("n").cast("double").alias("total"))
    fitted_row = one.selectExpr("rows", f"explode(array({fitted})) AS s")
    return fitted_row.selectExpr(f"inline(transform(rows, x -> struct(x.pattern AS pattern, {p_good} AS p_good)))")


def fit(featured: DataFrame) -> DataFrame:
    return posteriors(featured.groupBy("pattern").agg(F.count("*").alias("n")))


def judge(featured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``featured`` with p_good and kept. ``verdicts`` has at most 3 ** rules rows, hence the broadcast."""
    got = featured.join(F.broadcast(verdicts), "pattern", "left")
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are read twice, for the model and for the verdicts, and neither shuffled nor written on the way."""
    verdicts = materialize(fit(features(docs.select("text"))), "quality-verdicts")
    box = f"row_{uuid.uuid4().hex[:8]}"
    packed = docs.select(F.struct("*").alias(box), "text")
    return judge(features(packed, box), verdicts).where("kept").select(f"{box}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(features(table(spark, sf_dir, "documents"), "doc_id"), "quality-features")
    return judge(featured, fit(featured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
