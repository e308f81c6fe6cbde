"""Roll-ups of logs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import half_even


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-2: column, value and n of several columns in one pass."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return rows.groupBy("x.name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """AGG-1, AGG-3: n and, for each condition, how many rows it holds for and their share (3 digits, half-even)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in conditions.items()])
    return counts.withColumns({f"share_{k}": half_even(F.col(f"n_{k}") / F.col("n")) for k in conditions})


def modal_share(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """AGG-4: the most frequent value of each key, the smallest on ties, its share and the number of values; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(*keys).agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_values"), F.min_by(F.col(column), F.struct(-F.col("c"), F.col(column))).alias("mode"))
    return g.select(*keys, "mode", "n", "n_values", half_even(F.col("top") / F.col("n")).alias("share"))


def flips(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """AGG-5: of the keys, how many have more than one value, how many are unanimous, and the flip rate."""
    per = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    g = per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("low") != F.col("high")).alias("n_flipped"))
    return g.withColumn("flip_rate", half_even(F.when(F.col("n_groups") > 0, F.col("n_flipped") / F.col("n_groups")).otherwise(0.0)))


def repeats(df: DataFrame, call: list[str], answer: str) -> DataFrame:
    """AGG-13: calls made more than once: how many, and how many of them always gave the same answer; by hash of the call."""
    g = df.select(F.sha2(F.to_json(F.struct(*call)), 256).alias("call"), answer).groupBy("call").agg(F.count(F.lit(1)).alias("n"), F.min(answer).alias("low"), F.max(answer).alias("high")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_repeated"), F.count_if(F.col("low") == F.col("high")).alias("n_same"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"))


def cost(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """AGG-12, AGG-19: n, sum, mean, least and largest of a value, by key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.avg(value).alias("m"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.select(*keys, "n", F.round("s", digits).alias("total"), F.round("m", digits).alias("mean"), F.round("low", digits).alias("least"), F.round("high", digits).alias("most"))


def count_map(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """AGG-18: keys and counts, a map of value to number of rows; nulls are left out."""
    n = df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_v", "_n"))).alias("counts"))


def long(row: DataFrame, section: str) -> DataFrame:
    """EVL-5: section, metric and value of a table of one row, one row for each column."""
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(items).alias("x")).select(F.lit(section).alias("section"), "x.*")


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """SET-6: all metric rows, one table after the other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
