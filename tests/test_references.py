import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill.operators.references import Reference, Register, orphans

T = lambda d: dt.datetime(2024, 1, d)


def register(spark, name, rows):
    return Register(name, spark.createDataFrame(rows, "k string, since timestamp, until timestamp, ref string"), "k", "since", "until")


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reasons_nulls_repeats_and_case(spark):
    base = register(spark, "base", [("A", T(5), None, None), ("A", T(3), None, None), ("B", T(1), T(10), None), (None, T(1), None, None)])
    rows = [(1, " a ", T(3)), (2, "A", T(2)), (3, "b\t", T(10)), (4, "B", T(9)), (5, "zz", T(9)), (6, None, T(9)), (7, "  ", T(9)), (8, "zz", None), (9, "A", None), (5, "zz", T(9))]
    df = spark.createDataFrame(rows, "id long, ref string, at timestamp").withColumn("key", F.lit("clash")).withColumn("register", F.lit("clash"))
    out = orphans([base], [Reference("t", df, "id", "ref", "at", {"base": None})])
    assert found(out, "row_id", "reason") == [("2", "late"), ("3", "deleted"), ("5", "missing"), ("8", "missing")]
    assert {r["period"] for r in out.collect() if r["row_id"] == "8"} == {None}


def test_cascade_reaches_children_and_ends_on_cycles(spark):
    rows = [("a", T(2), None, "gone"), ("b", T(2), None, "a"), ("c", T(2), None, "b"), ("d", T(2), None, "e"), ("e", T(2), None, "d"), ("f", T(2), None, "f")]
    own = register(spark, "t", rows)
    df = own.rows.withColumn("at", F.lit(T(3)).cast("timestamp"))
    out = orphans([own], [Reference("t", df, "k", "ref", "at", {"t": None}, own_key="k")])
    assert found(out, "row_id", "kind", "depth") == [("a", "direct", 0), ("b", "indirect", 1), ("c", "indirect", 2)]


def test_hot_key_and_empty_tables(spark):
    base = register(spark, "base", [("A", T(1), None, None)])
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("ref"), F.lit(T(2)).cast("timestamp").alias("at"))
    ref = lambda df: [Reference("t", df, "id", "ref", "at", {"base": None})]
    assert orphans([base], ref(hot)).count() == 2000
    empty = register(spark, "base", [])
    assert orphans([empty], ref(hot)).count() == 3000
    assert orphans([base], ref(hot.limit(0))).count() == 0


def test_depth_is_bounded(spark):
    rows = [(f"n{i:03d}", T(2), None, f"n{i - 1:03d}" if i else "gone") for i in range(5)]
    own = register(spark, "t", rows)
    df = own.rows.withColumn("at", F.lit(T(3)).cast("timestamp"))
    with pytest.raises(RuntimeError):
        orphans([own], [Reference("t", df, "k", "ref", "at", {"t": None}, own_key="k")], max_depth=2)
