"""Evaluation against gold standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.session import cut, half_even


def greedy_match(pairs: DataFrame, left: str, right: str, similarity: str, threshold: float, max_rounds: int = 200) -> DataFrame:
    """EVL-1, JOIN-13: one-to-one pairs in the order of falling similarity, the larger left and then right key first on ties.

    Each round keeps the pairs that are best for both their sides and removes those sides; as the order is strict,
    that gives the greedy result. Both sides' best pairs are aggregates, so no side is gathered in one task.
    """
    order = F.struct(F.col(similarity).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    rest = cut(pairs.where(F.col(similarity) >= threshold).select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(similarity).alias("s"), order.alias("o")).distinct())
    kept = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        by_left, by_right = rest.groupBy("l").agg(F.max("o").alias("o")), rest.groupBy("r").agg(F.max("o").alias("o"))
        best = cut(by_left.select("o").intersect(by_right.select("o")).select("o.l", "o.r", "o.s"))
        kept = best if kept is None else kept.unionByName(best)
        rest = cut(rest.join(best.select("l"), "l", "left_anti").join(best.select("r"), "r", "left_anti").select("l", "r", "s", "o"))
    else:
        raise RuntimeError("matching did not end; raise max_rounds")
    if kept is None:
        kept = rest.select("l", "r", "s")
    return kept.select(F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(similarity))


def scores(df: DataFrame, right: str, found: str, wanted: str) -> DataFrame:
    """AGG-15, EVL-2: adds precision, recall and f1 (3 digits, half-even) of counts; 0 where a count is 0."""
    p = F.when(F.col(found) > 0, F.col(right) / F.col(found)).otherwise(0.0)
    r = F.when(F.col(wanted) > 0, F.col(right) / F.col(wanted)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return df.withColumns({"precision": half_even(p), "recall": half_even(r), "f1": half_even(f)})


def overlap(a: Column, b: Column) -> Column:
    """AGG-16: Jaccard similarity of two arrays, null if either is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def usability(items: Column) -> Column:
    """AGG-17: score of ten answers from 1 to 5: odd items less 1, even ones from 5, times 2.5; null unless there are ten."""
    total = F.aggregate(F.transform(items, lambda v, i: F.when(i % 2 == 0, v - 1).otherwise(5 - v)), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.when((F.size(items) == 10) & ~F.exists(items, lambda v: v.isNull()), total * 2.5)


def either_way(found: DataFrame, seeds: DataFrame, a: str, b: str) -> DataFrame:
    """EVL-3, JOIN-12: found pairs that are seeded, in either orientation, each once."""
    sides = lambda df: df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()
    return sides(found).join(sides(seeds), [a, b], "left_semi")


def wide(df: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """AGG-6, EVL-5: long to wide, the first value of each cell."""
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value, ignorenulls=True))


def kept_verdicts(fresh: DataFrame, old: DataFrame, keys: list[str], column: str) -> DataFrame:
    """JOIN-14: new rows with what people entered before for the same keys; empty where nothing was."""
    before = old.groupBy(*keys).agg(F.max(column).alias(column))
    return fresh.drop(column).join(before, keys, "left").withColumn(column, F.coalesce(F.col(column), F.lit("")))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """WIN-1: adds a running number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))


def caught(seeds: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """EVL-3, JOIN-16: n_seeds, n_caught and recall (3 digits, half-even; null without seeds) of distinct seeds among what was found."""
    there = found.select(key).distinct().withColumn("_t", F.lit(1))
    g = seeds.select(key).distinct().join(there, key, "left").agg(F.count(F.lit(1)).alias("n_seeds"), F.count("_t").alias("n_caught"))
    return g.withColumn("recall", half_even(F.when(F.col("n_seeds") > 0, F.col("n_caught") / F.col("n_seeds"))))


def replayed(df: DataFrame, seed: str, conditions: dict[str, Column], patterns: list[str]) -> DataFrame:
    """EVL-7: condition, n_attacks and n_succeeded: of the texts of `seed` that hold a pattern, how many still do in each condition."""
    any_ = "|".join(f"(?:{p})" for p in patterns)
    texts = df.where(F.col(seed).rlike(any_)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), c.alias("t")) for n, c in conditions.items()])).alias("x"))
    return texts.groupBy("x.condition").agg(F.count(F.lit(1)).alias("n_attacks"), F.count_if(F.col("x.t").rlike(any_)).alias("n_succeeded"))


def hits_at(ranked: DataFrame, expected: DataFrame, key: str, item: str, place: str) -> DataFrame:
    """EVL-6: n, top1 and top2: shares of expected items that are ranked first, and first or second (3 digits, half-even)."""
    met = expected.join(ranked.select(key, item, F.col(place).alias("_p")), [key, item], "left")
    g = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p") == 1).alias("a"), F.count_if(F.col("_p") <= 2).alias("b"))
    return g.select("n", half_even(F.when(F.col("n") > 0, F.col("a") / F.col("n"))).alias("top1"), half_even(F.when(F.col("n") > 0, F.col("b") / F.col("n"))).alias("top2"))


def verified_matches(automatic: DataFrame, sheet: DataFrame, group: str, verdict: str) -> DataFrame:
    """EVL-2: group and tp: the matches that people verified, where they gave any verdict on the group, else the automatic ones."""
    said = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    human = sheet.groupBy(group).agg(F.count_if(said != "").alias("_any"), F.count_if(said.isin("yes", "y", "match", "1", "true")).alias("_yes"))
    own = automatic.groupBy(group).agg(F.count(F.lit(1)).alias("_auto"))
    met = own.join(human, group, "full")
    return met.select(group, F.when(F.col("_any") > 0, F.col("_yes")).otherwise(F.coalesce("_auto", F.lit(0))).alias("tp"))
