"""Problem 3: references to records that do not exist.

Method: fixpoint cascade. Rows whose reference names no record that existed at the row's own time are direct orphans;
rows that refer to an orphaned record, over the foreign-key graph, are indirect ones, found by repeated semi-joins
until no new ones appear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut, lookup_join

#: White space that may surround a key; inner white space belongs to it.
SPACES = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0               　​﻿"


@dataclass(frozen=True)
class Register:
    """A table of records that others refer to: the key's column, its first time, and the time it was withdrawn."""

    name: str
    rows: DataFrame
    key: str
    since: str
    until: str


@dataclass(frozen=True)
class Reference:
    """References of a table; a row may hold several of a column, given as several rows. target maps a register's name to the condition under which the column refers to it.

    own_key names the column by which other tables refer to these rows, if they are records of a register.
    """

    name: str
    rows: DataFrame
    row_id: str
    column: str
    at: str
    target: dict[str, Column | None]
    own_key: str | None = None


def normal_key(column: Column) -> Column:
    """A key without surrounding white space and regard to case; null if blank."""
    return F.nullif(F.lower(F.btrim(column.cast("string"), F.lit(SPACES))), F.lit(""))


def lifetimes(registers: list[Register]) -> DataFrame:
    """One row per register and key: register, key, since (earliest first time), until (latest withdrawal, null if none)."""
    parts = [
        r.rows.select(F.lit(r.name).alias("register"), normal_key(F.col(r.key)).alias("key"), F.col(r.since).cast("timestamp").alias("_since"), F.col(r.until).cast("timestamp").alias("_until"))
        for r in registers
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("key is not null").groupBy("register", "key").agg(F.min("_since").alias("since"), F.max("_until").alias("until"))


def references(refs: list[Reference]) -> DataFrame:
    """One row per reference: src_table, column, row_id, at, register, key, own_key."""
    rows = None
    for r in refs:
        to = F.lit(None).cast("string")
        for name, condition in r.target.items():
            to = F.coalesce(to, F.lit(name) if condition is None else F.when(condition, F.lit(name)))
        own = F.lit(None).cast("string") if r.own_key is None else normal_key(F.col(r.own_key))
        part = r.rows.select(
            F.lit(r.name).alias("src_table"), F.lit(r.column).alias("column"), F.col(r.row_id).cast("string").alias("row_id"), F.col(r.at).cast("timestamp").alias("at"),
            to.alias("register"), normal_key(F.col(r.column)).alias("key"), own.alias("own_key"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("key is not null and register is not null")


def orphans(registers: list[Register], refs: list[Reference], max_depth: int = 50) -> DataFrame:
    """src_table, column, row_id, period, key, reason, kind and depth of every orphaned reference.

    reason of a direct orphan: missing (no such key), late (the key's first time is after the row's), deleted (it was
    withdrawn at or before the row's time). Null or blank keys are no reference. A row without a time can only be
    missing and has a null period. An indirect orphan has reason inherited and the depth at which the cascade reached
    it; a row that is a direct orphan is reported as such only. Rows delivered several times count once. Cycles end,
    as a record enters the cascade once. Hot keys meet their few lifetimes by a bounded broadcast (see lookup_join).
    """
    alive = lifetimes(registers).withColumn("ref", F.struct("register", "key")).drop("register", "key")
    rows = references(refs).withColumn("ref", F.struct("register", "key"))
    joined = lookup_join(rows, alive.withColumn("known", F.lit(True)), "ref")
    reason = (
        F.when(F.col("known").isNull(), "missing").when(F.col("since") > F.col("at"), "late").when(F.col("until") <= F.col("at"), "deleted")
    )
    out = ["src_table", "column", "row_id", "at", "register", "key", "own_key"]
    checked = joined.select(*out, reason.alias("reason"))
    tables = {r.name for r in refs if r.own_key is not None} & {r.name for r in registers}
    if tables:
        checked = cut(checked)  # looked up once; every depth reads it
    direct = checked.where("reason is not null").select(*out, "reason", F.lit("direct").alias("kind"), F.lit(0).alias("depth")).distinct()
    if tables:
        direct = cut(direct)
        found, frontier = direct, direct
        # only references to records that may themselves be orphaned can be reached
        healthy = checked.where("reason is null").where(F.col("register").isin(*tables)).select(F.struct("register", "key").alias("ref"), *out)
        for depth in range(1, max_depth + 1):
            hit = frontier.where(F.col("src_table").isin(*tables) & F.col("own_key").isNotNull()).select(F.struct(F.col("src_table").alias("register"), F.col("own_key").alias("key")).alias("ref")).distinct()
            reached = lookup_join(healthy, hit.withColumn("hit", F.lit(True)), "ref").where("hit").select(*out).distinct()
            seen = found.select("src_table", "column", "row_id").distinct()
            new = reached.join(seen, ["src_table", "column", "row_id"], "left_anti")
            frontier = cut(new.withColumns({"reason": F.lit("inherited"), "kind": F.lit("indirect"), "depth": F.lit(depth)}))
            if frontier.isEmpty():
                break
            found = found.unionByName(frontier)
        else:
            raise RuntimeError("the cascade did not end; raise max_depth")
        direct = found
    return direct.select("src_table", "column", "row_id", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM").alias("period"), "key", "reason", "kind", "depth")
