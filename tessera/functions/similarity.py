"""Similarities of vectors, sets, strings and feature structs, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of unequal length are an error."""
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


METRICS = {"cosine": cosine, "dot": dot, "euclid": euclidean, "manhattan": manhattan}


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contextual(a: Column, b: Column) -> Column:
    """Of two call chains: 1 if both are empty, 0 if one is, else the Jaccard similarity."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def fuzzy(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def ratio(x: Column, y: Column) -> Column:
    """Of two numbers: 1 less the difference over the larger."""
    most = F.greatest(x, y)
    return F.when(most > 0, 1 - F.abs(x - y) / most).otherwise(1.0)


def mean_present(sims: list[Column]) -> Column:
    """The mean of those that are not null; 0 if none is."""
    given = F.filter(F.array(*sims), lambda s: s.isNotNull())
    return F.when(F.size(given) == 0, 0.0).otherwise(F.aggregate(given, F.lit(0.0), lambda t, s: t + s) / F.size(given))


NUMERIC = ("lineCount", "avgLineLength", "bracketCount", "parenthesisCount", "semicolonCount", "complexity")
BOOLEAN = ("hasLoops", "hasConditionals", "hasFunctions", "hasClasses", "hasReturns", "hasExceptions")


def structural(a: Column, b: Column) -> Column:
    """Of two feature structs: the mean over the features that both have."""
    same = lambda x, y: F.when(x == y, 1.0).when(x.isNotNull() & y.isNotNull(), 0.0)
    numbers = [F.when(a[f].isNotNull() & b[f].isNotNull(), ratio(a[f], b[f])) for f in NUMERIC]
    return mean_present([*numbers, *(same(a[f], b[f]) for f in BOOLEAN), same(a["type"], b["type"])])


def feature_map(a: Column, b: Column) -> Column:
    """Of two maps of numbers, over the keys of both: similarities weighted by the larger value."""
    both = F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.struct(x.alias("x"), y.alias("y"))), lambda _, v: v["x"].isNotNull() & v["y"].isNotNull())
    values = F.map_values(both)
    weight = F.aggregate(values, F.lit(0.0), lambda t, v: t + F.greatest(v["x"], v["y"]))
    total = F.aggregate(values, F.lit(0.0), lambda t, v: t + ratio(v["x"], v["y"]) * F.greatest(v["x"], v["y"]))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def ensemble(sims: list[Column], weights: list[float]) -> Column:
    """Weighted mean; the weights are made to sum to 1."""
    if len(sims) != len(weights):
        raise ValueError("as many weights as similarities are needed")
    if not sims:
        return F.lit(0.0)
    total = sum(weights)
    return reduce(lambda x, y: x + y, [s * (w / total) for s, w in zip(sims, weights, strict=True)])


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def path_proximity(a: Column, b: Column) -> Column:
    """1 in one directory, else the common beginning of the directories over the longer of them."""
    x, y = directory(a), directory(b)
    longest = F.greatest(F.length(x), F.length(y))
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))),
        F.lit(0),
        lambda n, k: F.when((n == k - 1) & (F.substring(x, k, F.lit(1)) == F.substring(y, k, F.lit(1))) & (k <= F.least(F.length(x), F.length(y))), k).otherwise(n),
    )
    return F.when(x == y, 1.0).when(longest == 0, 0.0).otherwise(common / longest)
