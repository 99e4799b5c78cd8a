"""Fusion of ranked lists, utility score, explanations, feedback signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.scoring import clamp01, trust
from cardmill.functions.text import let


def rank_arm(scores: DataFrame, digits: int = 9) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.asc("subject_id"))
    return scores.withColumn("rank", F.row_number().over(order))


def rrf(lexical: DataFrame, vector: DataFrame, k: int = fixed.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two arms (query_id, subject_id, score, rank)."""

    def arm(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "query_id", "subject_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")
        )

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))

    fused = (
        arm(lexical, "lexical")
        .join(arm(vector, "vector"), ["query_id", "subject_id"], "full")
        .withColumn("fused_score", share("lexical_rank") + share("vector_rank"))
        .withColumn("found_by_both", F.col("lexical_rank").isNotNull() & F.col("vector_rank").isNotNull())
        .withColumn("semantic_only", F.col("lexical_rank").isNull() & F.col("vector_rank").isNotNull())
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", 12)), F.asc("subject_id"))
    fused = fused.withColumn("fused_rank", F.row_number().over(order))
    return fused if limit is None else fused.filter(F.col("fused_rank") <= limit)


def weights_row(weights: DataFrame) -> DataFrame:
    """Key/value rows turned into one row; a missing key keeps its default."""
    defaults = {**fixed.WEIGHTS, **fixed.PENALTIES}
    return weights.filter(F.col("key").isin(list(defaults))).agg(
        *[
            F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(v)).alias(k)
            for k, v in defaults.items()
        ]
    )


def _weight_struct(weights: DataFrame | None) -> Column:
    defaults = {**fixed.WEIGHTS, **fixed.PENALTIES}
    if weights is None:
        return F.struct(*[F.lit(v).alias(k) for k, v in defaults.items()])
    return weights_row(weights).select(F.struct(*defaults).alias("w")).scalar()


def utility(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted clamped signals minus penalties, with the contribution of each signal.

    Signal columns that are absent count as their default: 0.5 for trust and freshness, otherwise 0.
    """
    names = list(fixed.WEIGHTS)
    have = set(df.columns)

    def signal(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(fixed.SIGNAL_DEFAULTS.get(name, 0.0))

    def penalty(flag: str, weight: str) -> Column:
        if flag not in have:
            return F.lit(0.0)
        return F.when(F.col(flag), F.col("_w")[weight]).otherwise(0.0)

    parts = F.array(
        *[F.struct(F.lit(n).alias("signal"), (F.col("_w")[n] * clamp01(signal(n))).alias("value")) for n in names]
    )
    return (
        df.withColumn("_w", _weight_struct(weights))
        .withColumn("contributions", parts)
        .withColumn(
            "penalty", penalty("is_expired", "penalty_expired") + penalty("is_outdated", "penalty_outdated")
        )
        .withColumn(
            "utility",
            clamp01(F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["value"]) - F.col("penalty")),
        )
        .drop("_w")
    )


def top_reasons(
    contributions: Column, count: int = 3, threshold: float = fixed.REASON_THRESHOLD
) -> Column:
    """Names of the largest contributions at or above the threshold; ties keep signal order."""

    def strongest(items: Column) -> Column:
        keyed = F.transform(items, lambda c, i: F.struct((-c["value"]).alias("v"), i.alias("i"), c["signal"].alias("s")))
        return F.transform(F.slice(F.array_sort(keyed), 1, count), lambda x: x["s"])

    return let(F.filter(contributions, lambda c: c["value"] >= threshold), strongest)


def explain(matched: Column, note_matched: Column, semantic_only: Column) -> Column:
    """'your note', the first three matched terms, or 'similar meaning' when nothing else speaks for it."""
    said = F.filter(
        F.array(
            F.when(note_matched, F.lit("your note")),
            F.when(F.size(matched) > 0, F.array_join(F.slice(matched, 1, 3), ", ")),
        ),
        lambda r: r.isNotNull(),
    )
    return let(
        said,
        lambda r: F.when((F.size(r) == 0) & semantic_only, F.array(F.lit("similar meaning"))).otherwise(r),
    )


# --- signals from feedback and use ---------------------------------------------------------------


def trust_scores(feedback: DataFrame, *subject: str) -> DataFrame:
    """Laplace-smoothed share of 'useful' among useful / not_relevant verdicts."""
    return (
        feedback.groupBy(*subject)
        .agg(
            F.sum((F.col("verdict") == "useful").cast("long")).alias("useful"),
            F.sum((F.col("verdict") == "not_relevant").cast("long")).alias("not_relevant"),
        )
        .withColumn("trust", trust(F.col("useful"), F.col("not_relevant")))
    )


def ranking_signals(
    subjects: DataFrame, feedback: DataFrame, interactions: DataFrame, fields: DataFrame, key: str = "subject_id"
) -> DataFrame:
    """Trust, previous use, verified share and the outdated mark per subject."""
    verdicts = feedback.groupBy(key).agg(
        F.sum((F.col("verdict") == "useful").cast("long")).alias("useful"),
        F.sum((F.col("verdict") == "not_relevant").cast("long")).alias("not_relevant"),
        F.max(F.col("verdict") == "outdated").alias("is_outdated"),
    )
    uses = interactions.groupBy(key).agg(F.max((F.col("kind") == "used").cast("double")).alias("previous_use"))
    checked = fields.groupBy(key).agg(F.avg(F.col("verified_by_user").cast("double")).alias("verified"))
    zero = F.lit(0)
    return (
        subjects.join(verdicts, key, "left")
        .join(uses, key, "left")
        .join(checked, key, "left")
        .withColumn("trust", trust(F.coalesce("useful", zero), F.coalesce("not_relevant", zero)))
        .withColumn("previous_use", F.coalesce("previous_use", F.lit(0.0)))
        .withColumn("verified", F.coalesce("verified", F.lit(0.0)))
        .withColumn("is_outdated", F.coalesce("is_outdated", F.lit(False)))
        .drop("useful", "not_relevant")
    )


#: Location score of the closest level that asker and subject share; ours, since the signal has no published scale.
PLACE_LEVELS = (("area", 1.0), ("city", 0.6), ("country", 0.3))


def _located(hits: DataFrame, askers: DataFrame, places: DataFrame) -> DataFrame:
    """Hits once per place of their subject, or once without any, with what that place is worth as ``_near``."""
    levels = [name for name, _ in PLACE_LEVELS]
    here = askers.select("query_id", *[F.col(c).alias(f"_{c}") for c in levels])
    met = hits.join(here, "query_id", "left").join(places.select("subject_id", *levels), "subject_id", "left")
    same = {c: F.lower(F.col(c)) == F.lower(F.col(f"_{c}")) for c in levels}
    score = F.lit(0.0)
    for i in reversed(range(len(levels))):
        wider = [F.coalesce(same[c], F.lit(True)) for c in levels[i + 1 :]]
        agrees = F.coalesce(same[levels[i]], F.lit(False))
        for w in wider:
            agrees = agrees & w
        score = F.when(agrees, F.lit(PLACE_LEVELS[i][1])).otherwise(score)
    return met.select(*hits.columns, score.alias("_near"))


def _compared(hits: DataFrame, asked: DataFrame, offered: DataFrame) -> DataFrame:
    """Hits with ``_alike``: 1 if what is asked for and what is offered fall in one category."""
    wanted = asked.select("query_id", F.col("category").alias("_wanted"))
    found = hits.join(wanted, "query_id", "left").join(offered.select("subject_id", "category"), "subject_id", "left")
    match = F.coalesce((F.col("category") == F.col("_wanted")).cast("double"), F.lit(0.0))
    return found.select(*hits.columns, match.alias("_alike"))


def location_scores(hits: DataFrame, askers: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, subject_id, location) of every hit: how close the subject's nearest place is to where the asker is.

    ``askers`` has one row per query_id, ``places`` any number per subject_id, both with area, city and country, each of
    which may be missing. A level counts only if the levels around it do not disagree: an area is its city's and country's.
    No place is 0. Places meet hits by their key, so the work grows with the hits and their places, not with all pairs.
    """
    met = _located(hits.select("query_id", "subject_id"), askers, places)
    return met.groupBy("query_id", "subject_id").agg(F.max("_near").alias("location"))


def category_scores(hits: DataFrame, asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(query_id, subject_id, category_match) of every hit: 1 if what is asked for and what is offered fall in one category."""
    found = _compared(hits.select("query_id", "subject_id"), asked, offered)
    return found.groupBy("query_id", "subject_id").agg(F.max("_alike").alias("category_match"))


def place_and_category(hits: DataFrame, askers: DataFrame, places: DataFrame, asked: DataFrame, offered: DataFrame) -> DataFrame:
    """``location`` and ``category_match`` of every hit, grouped once for both instead of joined by hit."""
    found = _compared(_located(hits.select("query_id", "subject_id"), askers, places), asked, offered)
    return found.groupBy("query_id", "subject_id").agg(F.max("_near").alias("location"), F.max("_alike").alias("category_match"))


def rank_ablation(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Two runs of the same queries side by side: how each subject's rank moved."""
    a = run_a.select("query_id", "subject_id", F.col("rank").alias("rank_a"))
    b = run_b.select("query_id", "subject_id", F.col("rank").alias("rank_b"))
    return a.join(b, ["query_id", "subject_id"], "full").withColumn("moved", F.col("rank_a") - F.col("rank_b"))
