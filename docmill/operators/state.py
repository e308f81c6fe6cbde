"""State kept as snapshots and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.session import running_numbers


def last_write(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """WIN-6, JOIN-17: each key's last row in the given order; an aggregate, so a hot key combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def merge_findings(open_rows: DataFrame, failing: DataFrame, live: DataFrame, keys: list[str], subject: str, round_no: int) -> DataFrame:
    """STA-3: the new snapshot: keys, state (kept, resolved, new) and resolved_round.

    Open findings that fail no more are resolved if their subject is live; failing ones without an open row are new;
    all others are kept as they are.
    """
    a = open_rows.select(*keys).distinct().withColumn("_open", F.lit(True))
    b = failing.select(*keys).distinct().withColumn("_fails", F.lit(True))
    alive = live.select(subject).distinct().withColumn("_live", F.lit(True))
    met = a.join(b, keys, "full").join(alive, subject, "left")
    state = F.when(F.col("_open").isNull(), "new").when(F.col("_fails").isNull() & F.col("_live"), "resolved").otherwise("kept")
    return met.select(*keys, state.alias("state"), F.when(state == "resolved", round_no).alias("resolved_round"))


def assign_ids(df: DataFrame, kind: str, order: list[str], taken: DataFrame, taken_id: str, prefix: str, width: int = 3) -> DataFrame:
    """STA-2, AGG-10: adds new_id, <kind>-<prefix>-<number>, continuing from the largest number taken for each kind.

    Numbers have at least `width` digits. Ids of another form are left out of account.
    """
    pattern = rf"^([A-Z]+)-{prefix}-(\d+)$"
    top = taken.select(F.regexp_extract(taken_id, pattern, 1).alias("_kind"), F.regexp_extract(taken_id, pattern, 2).try_cast("int").alias("_n")).where("_kind <> ''").groupBy("_kind").agg(F.max("_n").alias("_top"))
    rows = running_numbers(df, kind, order, "_i").withColumn("_kind", F.col(kind))
    number = F.col("_i") + F.coalesce("_top", F.lit(0))
    return rows.join(top, "_kind", "left").withColumn("new_id", F.concat_ws("-", "_kind", F.lit(prefix), F.format_string(f"%0{width}d", number))).drop("_kind", "_i", "_top")


def fold_decisions(items: DataFrame, decisions: DataFrame, key: str, order: list[Column], verbs: dict[str, str], pending: str = "pending") -> DataFrame:
    """STA-5, STA-6: items with status and n_decisions after an append-only log; an item is decided once, by its first valid decision.

    verbs maps a decision to the status it gives; others are refused and change nothing.
    """
    valid = decisions.where(F.col("decision").isin(list(verbs)))
    first = valid.groupBy(key).agg(F.min_by("decision", F.struct(*order)).alias("_d"), F.count(F.lit(1)).alias("n_decisions"))
    status = F.create_map(*[F.lit(x) for p in verbs.items() for x in p])
    return items.join(first, key, "left").select(*items.columns, F.coalesce(F.try_element_at(status, "_d"), F.lit(pending)).alias("status"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


def running_state(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """STA-9: adds version, the number of changes of a value so far within each key."""
    w = W.partitionBy(key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("version", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")
