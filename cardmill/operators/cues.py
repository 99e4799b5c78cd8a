"""Cue-table text understanding: categories, attributes, profiles, answer post-processing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import SPACE, blank_to_null, let, trim

ATTRIBUTE_TYPE = "array<struct<key:string,value:string,confidence:double>>"


def category(
    text: Column, labels: Sequence[str] | None = None, cues: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Label with most cue hits (substring, case-insensitive); first label wins ties; null without hits."""
    cues = fixed.CATEGORY_CUES if cues is None else cues
    labels = list(cues) if labels is None else list(labels)

    def best(lower: Column) -> Column:
        scored = F.array(
            *[
                F.struct(
                    sum((lower.contains(c).cast("int") for c in cues.get(label, [label])), F.lit(0)).alias("hits"),
                    F.lit(-i).alias("order"),
                    F.lit(label).alias("label"),
                )
                for i, label in enumerate(labels)
            ]
        )
        return let(F.array_max(scored), lambda top: F.when(top["hits"] > 0, top["label"]))

    return let(F.lower(text), best)


def classify_cues(
    df: DataFrame, id_col: str, text: str, labels: Sequence[str] | None = None, cues=None
) -> DataFrame:
    return df.select(id_col, category(F.col(text), labels, cues).alias("category"))


def attributes(note: Column, cues: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> Column:
    """One value per attribute key at most: the first whose any cue occurs in the note."""
    cues = fixed.ATTRIBUTE_CUES if cues is None else cues

    def read(lower: Column) -> Column:
        found = []
        for key, values in cues.items():
            pick = F.lit(None).cast("string")
            for value, words in reversed(list(values.items())):
                hit = lower.contains(words[0])
                for word in words[1:]:
                    hit = hit | lower.contains(word)
                pick = F.when(hit, F.lit(value)).otherwise(pick)
            found.append(F.struct(F.lit(key).alias("key"), pick.alias("value"), F.lit(0.6).alias("confidence")))
        return F.filter(F.array(*found), lambda a: a["value"].isNotNull())

    return let(F.lower(note), read)


def attribute_cues(df: DataFrame, id_col: str, note: str) -> DataFrame:
    return df.select(id_col, F.explode(attributes(F.col(note))).alias("a")).select(id_col, "a.*")


def build_profiles(subjects: DataFrame, text: str = "card_text", note: str = "note_text") -> DataFrame:
    """Text and note joined, with category; subjects with nothing written have no profile."""
    return (
        subjects.withColumn("canonical_en", trim(F.concat_ws("\n", F.col(text), F.col(note))))
        .filter(F.col("canonical_en") != "")
        .withColumn("category", category(F.col("canonical_en")))
        .select(
            "subject_id",
            "canonical_en",
            F.array().cast("array<string>").alias("services"),
            F.filter(F.array("category"), lambda c: c.isNotNull()).alias("categories"),
            F.lit("deterministic").alias("model"),
        )
    )


# --- answers given elsewhere, arriving as a text column --------------------------------------------


def query_intents(queries: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """(query_id, raw, gloss): the raw text, then usable keywords of the expansion answer if any."""
    if expansions is None:
        return queries.select("query_id", F.col("text").alias("raw"), F.col("text").alias("gloss"))
    keywords = F.filter(
        F.transform(F.split("answer", "[,\n]"), trim), lambda k: (k != "") & (F.length(k) < 40)
    )
    return queries.join(expansions.select("query_id", keywords.alias("keywords")), "query_id", "left").select(
        "query_id",
        F.col("text").alias("raw"),
        F.concat_ws(" ", F.array("text"), F.col("keywords")).alias("gloss"),
    )


def parse_key_values(df: DataFrame, id_col: str, answer: str, note: str) -> DataFrame:
    """'key: value' lines with allowed keys; the cue reading of the note when none parses."""

    def as_pair(line: Column) -> Column:
        colon = F.instr(line, ":")
        return F.struct(
            F.when(colon > 1, F.lower(trim(F.substring_index(line, ":", 1)))).alias("key"),
            trim(F.substr(line, colon + 1)).alias("value"),
            F.lit(0.8).alias("confidence"),
        )

    parsed = F.filter(
        F.transform(F.split(F.col(answer), "\n"), as_pair),
        lambda p: p["key"].isin(fixed.ANSWER_KEYS) & (p["value"] != ""),
    )
    chosen = let(
        F.coalesce(parsed, F.array().cast(ATTRIBUTE_TYPE)),
        lambda p: F.when(F.size(p) > 0, p).otherwise(attributes(F.col(note))),
    )
    return df.select(id_col, F.explode(chosen).alias("a")).select(id_col, "a.*")


def parse_keywords(df: DataFrame, id_col: str, answer: str, source: str) -> DataFrame:
    """Prose lines kept before the source text; the 'keywords:' lines become the service list."""
    lines = F.transform(F.split(F.col(answer), "\n"), trim)
    is_list = lambda line: F.lower(line).startswith("keywords:")
    listed = F.flatten(
        F.transform(F.filter(lines, is_list), lambda x: F.split(F.lower(F.substr(x, F.lit(10))), ","))
    )
    prose = F.array_join(F.filter(lines, lambda x: ~is_list(x) & (x != "")), "\n")
    return df.select(
        id_col,
        trim(F.concat_ws("\n", prose, F.col(source))).alias("canonical_en"),
        F.filter(F.transform(listed, trim), lambda s: s != "").alias("services"),
        F.filter(F.array(category(F.col(source))), lambda c: c.isNotNull()).alias("categories"),
    )


def accept_label(df: DataFrame, id_col: str, answer: str, text: str, labels: Sequence[str] | None = None) -> DataFrame:
    """The answer's first word when it is a known label, otherwise the cue category."""
    labels = list(fixed.CATEGORY_CUES) if labels is None else list(labels)
    first = F.get(F.split(F.lower(F.col(answer)), f"[{SPACE},.]"), F.lit(0))
    return df.select(
        id_col,
        F.when(first.isin(labels), first).otherwise(category(F.col(text), labels)).alias("category"),
        F.coalesce(first.isin(labels), F.lit(False)).alias("accepted"),
    )


def has_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(blank_to_null(F.col(text)).isNotNull())
