"""Registers: coverage, banding, routing and traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.session import lookup_join


def band(value: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """RSK-1: the name of the first step (from high to low) that the value reaches, else the lowest; null for null."""
    out = F.when(value.isNull(), None)
    for least, name in sorted(steps, reverse=True):
        out = out.when(value >= least, name)
    return out.otherwise(lowest)


def worst(df: DataFrame, key: str, level: Column, order: list[str]) -> DataFrame:
    """AGG-9, RSK-2: the row of each key at the highest level, the first of them in the given order (ascending); all by aggregates."""
    lower = [F.col(c) for c in order]
    top = df.withColumn("_level", level).groupBy(key).agg(F.max("_level").alias("_top"))
    rest = [c for c in df.columns if c != key]
    rows = df.withColumn("_level", level).groupBy(key, "_level").agg(F.min_by(F.struct(*rest), F.struct(*lower)).alias("_r"))
    best = rows.join(top, (rows[key].eqNullSafe(top[key])) & rows["_level"].eqNullSafe(top["_top"]), "left_semi")
    return best.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def worst_level(subjects: DataFrame, key: str, rated: DataFrame, level: Column, steps: list[tuple[float, str]], lowest: str, default: str = "Unassessed") -> DataFrame:
    """RSK-1, RSK-2: key and level: the band of the worst of each subject's ratings, the default for those without any."""
    worst_of = rated.groupBy(key).agg(F.max(level).alias("_w"))
    return lookup_join(subjects, worst_of, key).withColumn("level", F.coalesce(band(F.col("_w"), steps, lowest), F.lit(default))).drop("_w")


def uncovered(controls: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """CMP-4, JOIN-9: controls that no row covers."""
    return controls.join(covered.select(key).distinct(), key, "left_anti")


def coverage(expected: DataFrame, covered: DataFrame, group: str, key: str) -> DataFrame:
    """EVL-4, JOIN-10: group, n_expected, n_covered and coverage (3 digits, half-even) of distinct keys."""
    want = expected.select(group, key).distinct()
    have = covered.select(group, key).distinct().withColumn("_there", F.lit(1))
    g = want.join(have, [group, key], "left").groupBy(group).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_there").alias("n_covered"))
    return g.withColumn("coverage", F.bround(F.col("n_covered") / F.col("n_expected"), 3))


def rolled_up(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """AGG-11, CMP-3: sorted distinct values of the columns for each key; nulls are left out."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def exploded_links(df: DataFrame, key: str, links: Column, other: DataFrame, other_key: str, columns: list[str]) -> DataFrame:
    """JOIN-5, RTM-1: sorted distinct values of the linked rows' columns for each key; empty where nothing is linked."""
    edges = df.select(F.col(key).alias("_k"), F.explode_outer(links).alias("_l"))
    met = edges.join(other.select(F.col(other_key).alias("_l"), *columns), "_l", "left")
    return met.groupBy("_k").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).withColumnRenamed("_k", key)


def fan_out(parts: list[tuple[DataFrame, str, Column, list[str], Column]], id_prefix: str = "APR") -> DataFrame:
    """APR-1, SET-4: one row per item and role: seq, item_type, item_id, role, priority, item id by order of emission.

    parts are (rows, item_type, item's id, roles, priority) in the order in which their items are numbered.
    """
    rows = None
    for k, (df, kind, ident, roles, priority) in enumerate(parts):
        one = df.select(F.lit(k).alias("part"), F.lit(kind).alias("item_type"), ident.cast("string").alias("item_id"), F.posexplode(F.array(*[F.lit(r) for r in roles])).alias("pos", "role"), priority.alias("priority"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("part", "pos", F.concat_ws("-", F.lit(id_prefix), "part", "item_id", "pos").alias("fan_id"), "item_type", "item_id", "role", "priority")


def pivot_marks(df: DataFrame, key: str, column: str, values: list[str], mark: Column) -> DataFrame:
    """TRC-1, AGG-6: a row per key and a column per value holding the mark of their first row, empty where there is none."""
    wide = df.groupBy(key).pivot(column, values).agg(F.min(mark))
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(v) for v in values])


def union_issues(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """SET-1 to SET-3: kind, ref and detail of rows of several registers."""
    rows = None
    for kind, df, ref, detail in parts:
        one = df.select(F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), detail.cast("string").alias("detail"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def routed(df: DataFrame, key: str, links: Column, owners: DataFrame, owner_key: str, owner: str, default: str) -> DataFrame:
    """JOIN-15, CLR-1: the owner of the first linked row that has one, else the default."""
    edges = df.select(F.col(key).alias("_k"), F.posexplode_outer(links).alias("_p", "_l"))
    met = edges.join(owners.select(F.col(owner_key).alias("_l"), F.col(owner).alias("_o")), "_l", "left")
    first = met.groupBy("_k").agg(F.min(F.when(F.col("_o").isNotNull(), F.struct("_p", "_o"))).alias("f"))
    return first.select(F.col("_k").alias(key), F.coalesce("f._o", F.lit(default)).alias("owner"))


def batched(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """LIM-2: adds batch_no, rows of a group taken `size` at a time in order."""
    return df.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))
