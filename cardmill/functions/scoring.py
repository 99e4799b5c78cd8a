"""Numeric expressions for ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import collapse_space, let


def clamp01(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), col)))


def freshness(ts: Column, as_of: Column, half_life_days: float = fixed.HALF_LIFE_DAYS) -> Column:
    """0.5 per half-life of age in whole seconds; the future counts as fresh."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000))
    return F.when(as_of < ts, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life_days * 86400.0)))


def trust(useful: Column, not_relevant: Column) -> Column:
    return (useful + 1) / (useful + not_relevant + 2)


def normalized_rrf(score: Column, k: int = fixed.RRF_K) -> Column:
    return F.least(F.lit(1.0), score / F.lit(2.0 / (k + 1)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double, clamped; null when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def is_usable(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edits over reference length, white space collapsed; may exceed one."""
    return let(
        collapse_space(reference),
        lambda ref: let(
            collapse_space(hypothesis),
            lambda hyp: F.when(ref == "", F.when(hyp == "", F.lit(0.0)).otherwise(1.0)).otherwise(
                F.levenshtein(ref, hyp) / F.length(ref)
            ),
        ),
    )


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
