"""Rules and weighted scoring over factors: conditions compiled to columns, so that Catalyst sees them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITION = re.compile(r"^\s*(\w+)\s*(<=|>=|==|<|>)\s*(-?\d+(?:\.\d+)?)\s*$")


def condition(tree: str | dict, factors: Column) -> Column:
    """PRJ-12: a condition (a comparison "factor op number", or {"all": [...]} or {"any": [...]}) on a map of factors.

    A missing factor makes a comparison false; anything malformed is a ValueError.
    """
    if isinstance(tree, dict):
        if len(tree) != 1 or not {"all", "any"} & set(tree):
            raise ValueError(f"neither all nor any: {tree}")
        kind, parts = next(iter(tree.items()))
        out = F.lit(kind == "all")
        for p in parts:
            out = out & condition(p, factors) if kind == "all" else out | condition(p, factors)
        return out
    m = CONDITION.match(tree) if isinstance(tree, str) else None
    if not m:
        raise ValueError(f"malformed condition: {tree!r}")
    value, number = F.try_element_at(factors, F.lit(m[1])), float(m[3])
    tests = {"<=": value <= number, ">=": value >= number, "<": value < number, ">": value > number, "==": value == number}
    return F.coalesce(tests[m[2]], F.lit(False))


def fired(df: DataFrame, key: str, factors: str, rules: dict[str, str | dict]) -> DataFrame:
    """SDL-2: key and rule_id of each rule that holds."""
    found = F.array_compact(F.array(*[F.when(condition(t, F.col(factors)), F.lit(r)) for r, t in rules.items()]))
    return df.select(key, F.explode(found).alias("rule_id"))


def suitability(df: DataFrame, key: str, factors: str, profiles: dict[str, dict[str, tuple[int, float]]], low: float = 1, high: float = 5) -> DataFrame:
    """SDL-1, AGG-8, SRT-4: key, profile, pct and place: weighted mean of how each factor fits a profile.

    A profile has for each factor a direction (1 or -1) and a weight. A value is clamped to low..high; a missing
    factor is left out; without any factor pct is 0. Places go by pct rounded to one digit, half-even, then profile.
    """
    fits = []
    for order, (name, wanted) in enumerate(profiles.items()):
        total, weight = F.lit(0.0), F.lit(0.0)
        for factor, (direction, w) in wanted.items():
            raw = F.try_element_at(F.col(factors), F.lit(factor))
            v = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(float(low))), F.lit(float(high))))
            fit = (v - low) / (high - low) if direction > 0 else (F.lit(float(high)) - v) / (high - low)
            total, weight = total + F.coalesce(fit * w, F.lit(0.0)), weight + F.when(v.isNotNull(), w).otherwise(0.0)
        fits.append(F.struct(F.lit(order).alias("ord"), F.lit(name).alias("profile"), F.bround(F.when(weight > 0, 100 * total / weight).otherwise(0.0), 1).alias("pct")))
    ranked = F.array_sort(F.transform(F.array(*fits), lambda x: F.struct((-x["pct"]).alias("neg"), x["ord"].alias("ord"), x["profile"].alias("profile"), x["pct"].alias("pct"))))
    return df.select(key, F.posexplode(ranked).alias("place", "x")).select(key, "x.profile", "x.pct", (F.col("place") + 1).alias("place"))


def recommended(ranked: DataFrame, key: str, fired_rules: DataFrame, cautions: DataFrame, margin: float = 5.0) -> DataFrame:
    """SDL-3: key, top, runner_up, margin and escalate: no rule fired, a caution, or too small a margin."""
    two = ranked.where("place <= 2").groupBy(key).agg(
        F.max(F.when(F.col("place") == 1, F.col("profile"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("profile"))).alias("runner_up"),
        (F.max("pct") - F.min("pct")).alias("m"),
    )
    flags = fired_rules.select(key).distinct().withColumn("_f", F.lit(True))
    warned = cautions.select(key).distinct().withColumn("_c", F.lit(True))
    met = two.join(flags, key, "left").join(warned, key, "left")
    return met.select(key, "top", "runner_up", F.bround("m", 1).alias("margin"), (F.col("_f").isNull() | F.col("_c").isNotNull() | (F.col("m") < margin)).alias("escalate"))


def medians(df: DataFrame, key: str, factor: str, value: str) -> DataFrame:
    """AGG-7: exact median of each key's factor over several scorings; nulls don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(key, factor).agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))


def contested(df: DataFrame, key: str, factor: str, value: str, gap: float = 2) -> DataFrame:
    """SDL-4: factors on which two scorings differ by at least the gap."""
    return df.groupBy(key, factor).agg(F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("high") - F.col("low") >= gap)


def canonical(name: Column, families: list[tuple[str, str]]) -> Column:
    """PRJ-13: the first family whose pattern the name holds; unknown for a blank or null one, else the name itself."""
    out = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "unknown")
    for pattern, family in families:
        out = out.when(F.lower(name).rlike(pattern), family)
    return out.otherwise(name)


def first_of_kind(df: DataFrame, group: str, kind: str, order: list[str]) -> DataFrame:
    """SDL-6: the first row of each kind in each group, to which overlays attach."""
    rest = [c for c in df.columns if c not in (group, kind)]
    first = df.groupBy(group, kind).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(group, kind, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def usable(df: DataFrame, key: str, factors: str, n: int, spare: int = 2) -> DataFrame:
    """SDL-5: scorings with at least n - spare factors of each key; all of a key's scorings if none has as many."""
    enough = F.size(F.filter(F.map_values(factors), lambda v: v.isNotNull())) >= n - spare
    some = df.groupBy(key).agg(F.bool_or(enough).alias("_some"))
    return df.join(some, key).where(enough | ~F.col("_some")).drop("_some")


def consistent(ranked: DataFrame, key: str, picks: DataFrame, pick: str) -> DataFrame:
    """SDL-7: key, pick, engine_top and consistent: whether a run's own pick is the one its factors imply."""
    top = ranked.where("place = 1").select(key, F.col("profile").alias("engine_top"))
    return top.join(picks, key).select(key, pick, "engine_top", (F.col(pick) == F.col("engine_top")).alias("consistent"))


def overlaid(phases: DataFrame, group: str, order: str, kind: str, overlays: DataFrame, items: str, name: str) -> DataFrame:
    """SDL-6: phases with `name`, the overlay items (an array by kind) attached to each group's first phase of their kind only."""
    first = phases.groupBy(group, kind).agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    met = phases.join(first, [group, kind, order], "left").join(overlays.select(kind, F.col(items).alias("_i")), kind, "left")
    return met.select(*phases.columns, F.when(F.col("_first") & F.col("_i").isNotNull(), F.col("_i")).otherwise(F.array().cast("array<string>")).alias(name))


def run_matrix(framings: DataFrame, models: DataFrame, trials: int) -> DataFrame:
    """SDL-8: run_id, framing, model and trial of every combination of two short lists and the trials from 1."""
    runs = framings.select("framing", F.explode(F.array(*[F.lit(r["model"]) for r in models.select("model").distinct().orderBy("model").collect()])).alias("model"))  # a list of models
    runs = runs.select("framing", "model", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return runs.select(F.concat_ws("-", "framing", "model", "trial").alias("run_id"), "*")


def run_errors(answer: Column, criteria: list[str]) -> Column:
    """SDL-8: what is wrong with a run's JSON answer: no recommendation, unknown, repeated and missing criteria."""
    names = F.coalesce(F.transform(F.from_json(F.get_json_object(answer, "$.criteria"), "array<struct<criterion:string>>"), lambda c: F.trim(c["criterion"])), F.array().cast("array<string>"))
    known = F.array(*[F.lit(c) for c in criteria])
    parts = [
        F.when(F.trim(F.coalesce(F.get_json_object(answer, "$.recommended_sdlc"), F.lit(""))) == "", F.array(F.lit("no recommendation"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_except(names, known), lambda c: F.concat(F.lit("unknown "), c)),
        F.transform(F.filter(known, lambda k: F.size(F.filter(names, lambda x: x == k)) > 1), lambda c: F.concat(F.lit("repeated "), c)),
        F.transform(F.array_except(known, names), lambda c: F.concat(F.lit("missing "), c)),
    ]
    return F.concat(*parts)
