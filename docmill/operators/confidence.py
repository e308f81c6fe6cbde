"""Confidence of records from their support and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import half_even


def source_of(statement_id: Column) -> Column:
    """CNF-2: the second part of an id with at least two hyphens, else the whole id."""
    parts = F.split(statement_id, "-")
    return F.when(F.size(parts) > 2, parts[1]).otherwise(statement_id)


def support(quoted: Column, cites: Column, sources: Column, derived: Column) -> Column:
    """CNF-1: 1 for a verified quote or two sources, 0.75 for a citation or one source, 0.5 if derived, else 0."""
    return F.when(quoted | (F.size(sources) >= 2), 1.0).when((F.size(cites) > 0) | (F.size(sources) > 0), 0.75).when(derived, 0.5).otherwise(0.0)


def quality(scores: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys and quality: the mean of the first scores, averaged with the mean of the second ones where there are any."""
    g = scores.groupBy(*keys).agg(F.avg(first).alias("a"), F.avg(second).alias("b"))
    return g.select(*keys, F.when(F.col("b").isNotNull(), (F.coalesce("a", F.lit(0.0)) + F.col("b")) / 2).otherwise(F.coalesce("a", F.lit(0.0))).alias("quality"))


def confidence(df: DataFrame, support_col: str, quality_col: str, caps: list[tuple[Column, float, str]], threshold: float = 0.7) -> DataFrame:
    """CNF-1 and CNF-3: adds confidence (3 digits, half-even), escalate (by the unrounded value) and reasons.

    caps are (condition, cap, reason) in the order in which reasons are listed; null conditions don't hold.
    """
    raw = F.lit(0.5) * F.coalesce(F.col(support_col), F.lit(0.0)) + F.lit(0.5) * F.coalesce(F.col(quality_col), F.lit(0.0))
    reasons = []
    for holds, cap, reason in caps:
        holds = F.coalesce(holds, F.lit(False))
        raw = F.when(holds, F.least(raw, F.lit(cap))).otherwise(raw)
        reasons.append(F.when(holds, F.lit(reason)))
    out = df.withColumn("_raw", raw)
    return out.withColumns(
        {
            "confidence": half_even(F.col("_raw"), 3),
            "escalate": (F.col("_raw") < threshold) | (F.coalesce(F.col(support_col), F.lit(0.0)) == 0.0),
            "reasons": F.array_join(F.array_compact(F.array(*reasons)), "; ") if reasons else F.lit(""),
        }
    ).drop("_raw")
