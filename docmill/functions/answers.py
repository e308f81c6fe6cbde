"""JSON in model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recovered(answer: Column) -> Column:
    """LLM-2: the JSON in a model's answer as text: the whole answer, a fenced part, the outermost braces, or brackets.

    The first candidate that parses counts; null if none does.
    """
    fenced = F.regexp_extract(answer, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    braces, brackets = F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    return F.coalesce(*[F.to_json(F.try_parse_json(F.nullif(F.trim(c), F.lit("")))) for c in (answer, fenced, braces, brackets)])


def call_key(*parts: Column) -> Column:
    """LLM-1: the key under which the answer to a call is kept."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def answered(calls: DataFrame, responses: DataFrame, key: str, text: str) -> DataFrame:
    """LLM-1, LLM-3: calls with the JSON of their kept answers and a state: ok, broken (no JSON in it) or missing."""
    kept = responses.groupBy(key).agg(F.max(text).alias("_text"))
    met = calls.join(kept, key, "left").withColumn("json", recovered(F.col("_text")))
    return met.withColumn("state", F.when(F.col("_text").isNull(), "missing").when(F.col("json").isNull(), "broken").otherwise("ok")).drop("_text")


def best_attempt(attempts: DataFrame, keys: list[str], errors: str, order: str) -> DataFrame:
    """LLM-8: of several attempts that with the fewest errors, the last of them on ties."""
    rest = [c for c in attempts.columns if c not in keys]
    best = attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(errors), -F.col(order))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])
