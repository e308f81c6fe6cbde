"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that hold more than one row in HOT_SHARE are "hot": there can be at most HOT_SHARE of them, whatever the size.
HOT_SHARE = 256


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests, benches and examples."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docmill")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    share_code(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver's program was started."""
    root, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    share_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    The folder is the session's spark.checkpoint.dir. Where none is set (tests on one machine) a temporary one is
    made; on a cluster that would not be readable by all executors, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="docmill-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys of df that more than one row in `share` holds: at most `share` rows, whatever the size of df.

    Nulls are no keys. Counting combines on the map side; its result is one row per key.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") * share > F.col("_all")).select(key)


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, share: int = HOT_SHARE, counted: DataFrame | None = None) -> DataFrame:
    """Left join of facts with dim (one row per key), safe for keys that hold a large share of the facts.

    Rows of hot keys meet the dim rows of those keys by broadcast (at most `share` rows, see hot_keys); all others
    meet by a shuffled join in which no key is hot. Keys are counted in `counted`, by default in facts: give a table
    that is cheap to read and holds the key about as often.
    """
    hot = hot_keys(facts if counted is None else counted, key, share)
    found = hot.collect()  # at most `share` keys
    if not found:
        return facts.join(dim, key, "left")
    hot = facts.sparkSession.createDataFrame(found, hot.schema)
    marked = facts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    hot_dim = dim.join(F.broadcast(hot), key, "left_semi")
    heated = marked.where("_hot").drop("_hot").join(F.broadcast(hot_dim), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(dim, key, "left")
    return heated.unionByName(rest)


def running_numbers(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds a running number from 1 within each group, in order, without gathering a group in one task.

    Rows are sorted by range, numbered within each range, and moved on by the sizes of the ranges before. For a few
    large groups; for many small ones a window is cheaper. Orders should be unique; ties are numbered in any order.
    """
    ranged = cut(df.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = ranged.withColumn("_in_range", F.row_number().over(W.partitionBy(group, "_p").orderBy(*order)))
    return own.join(before.drop("_n"), [group, "_p"]).withColumn(name, (F.col("_in_range") + F.col("_before")).cast("long")).drop("_in_range", "_p", "_before")


def half_even(column: Column, digits: int = 3) -> Column:
    """Half-even rounding, as the scores of this engine are defined."""
    return F.bround(column, digits)
