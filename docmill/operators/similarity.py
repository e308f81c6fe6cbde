"""Exact similarity join of token sets, by prefix filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut, lookup_join

#: Tokens that more than one set in this many holds are ranked by their number, all others before them by their hash.
OFTEN = 512
#: Rows of a prefix token that meet in one task; those of more frequent ones are dealt out.
TOGETHER = 2000


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, often: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """k, size, p, w: the rarest tokens of each set, as many as any set at the threshold must share one of."""
    for batch in batches:
        keys, tokens = batch.column(0), batch.column(1)
        start = tokens.offsets.to_numpy()
        flat = tokens.flatten().to_numpy()
        size = np.diff(start)
        owner = np.repeat(np.arange(len(size)), size)
        count = np.zeros(len(flat), np.int64)
        if len(often) and len(flat):
            at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
            count = np.where(often[at] == flat, numbers[at], 0)
        order = np.lexsort((flat, count, owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        keep = place < (size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1)[owner]
        rows = owner[order][keep]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(size[rows].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(flat[order][keep])], names=["k", "size", "p", "w"])


def jaccard_links(sets: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """a, b, n_shared, n_union of all rows with equal or similar token sets (Jaccard >= threshold), a < b by key.

    Give one row per distinct set; equal sets are better kept as one class. Exact: two sets at the threshold share one
    of their rarest tokens, so only those are joined on; candidates are checked before anything is built from them.
    Tokens are compared by 64-bit hashes. Frequent tokens are a bounded table (OFTEN times the mean size of a set); a
    token that many prefixes hold is dealt out, each part meeting every other one. Empty sets are similar to nothing.
    The sets are read several times, so they should be a table or cut.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))).alias("t")).where("k is not null and size(t) > 0")
    n = rows.count()
    often = rows.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * OFTEN > n).collect()
    table = sorted((r["w"], r["n"]) for r in often)
    known, numbers = np.array([w for w, _ in table], np.int64), np.array([c for _, c in table], np.int64)
    kind = rows.schema["k"].dataType.simpleString()
    prefix = cut(rows.mapInArrow(lambda it: _prefixes(it, threshold, known, numbers), f"k {kind}, size int, p int, w long"))
    large = cut(prefix.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("w", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = prefix.withColumns({"own": F.lit(0), "meet": F.lit(0)})
        left = right = dealt
    else:
        dealt = lookup_join(prefix, large, "w").fillna(1, ["parts"]).withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
        left = dealt.withColumn("meet", F.col("own"))
        right = dealt.withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = left.select(*[F.col(c).alias(f"{c}_a") for c in prefix.columns], F.col("meet").alias("meet_a"))
    b = right.select(*[F.col(c).alias(f"{c}_b") for c in prefix.columns], F.col("meet").alias("meet_b"))
    sized = (F.col("size_a") >= F.col("size_b") * threshold - 1e-9) & (F.col("size_b") >= F.col("size_a") * threshold - 1e-9)
    near = a.join(b, (F.col("w_a") == F.col("w_b")) & (F.col("meet_a") == F.col("meet_b")) & (F.col("k_a") < F.col("k_b")) & sized)
    # a pair is a candidate if what is left from one of the shared tokens on can still reach the threshold
    room = F.least(F.col("size_a") - F.col("p_a"), F.col("size_b") - F.col("p_b"))
    needed = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    pairs = cut(near.where(room >= needed).select("k_a", "k_b").distinct())
    met = lookup_join(lookup_join(pairs, rows.select(F.col("k").alias("k_a"), F.col("t").alias("t_a")), "k_a"), rows.select(F.col("k").alias("k_b"), F.col("t").alias("t_b")), "k_b", counted=pairs.select("k_b"))
    met = met.withColumn("n_shared", F.size(F.array_intersect("t_a", "t_b")))
    out = met.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "n_shared", (F.size("t_a") + F.size("t_b") - F.col("n_shared")).alias("n_union"))
    return out.where(F.col("n_shared") >= F.col("n_union") * threshold - 1e-9)


def _print(column: str) -> Column:
    return F.struct(F.xxhash64(column), F.hash(column))


def first_near_duplicate(df: DataFrame, key: str, text: str, tokens: str, threshold: float = 0.8) -> DataFrame:
    """JOIN-7, DUP-1: key and other, the smallest key whose text differs and whose tokens are similar; null if there is none.

    Texts are taken as classes of exact copies, by 96-bit hashes: no text is shuffled, and links are found between
    classes, never between all copies. Rows with a null or wordless text have no duplicate.
    """
    rows = df.select(F.col(key).alias("k"), F.when(F.col(text).isNotNull(), _print(text)).alias("x"), F.array_sort(F.transform(tokens, lambda w: F.xxhash64(w))).alias("t"))
    texts = rows.where("x is not null and size(t) > 0").groupBy("x").agg(F.min_by(F.struct("k", "t"), "k").alias("m"))
    texts = cut(texts.select("x", F.col("m.k").alias("rep"), F.col("m.t").alias("t")).withColumn("set", F.struct(F.xxhash64("t"), F.hash("t"), F.size("t"))))
    sets = cut(texts.groupBy("set").agg(F.min_by(F.struct("rep", "t"), "rep").alias("m")).select("set", F.col("m.rep").alias("lead"), F.col("m.t").alias("t")))
    # of texts with equal tokens only the smallest key and the one after it are needed
    named = lookup_join(texts.select("set", "x", "rep"), sets.select("set", "lead"), "set")
    after = named.where("rep <> lead").groupBy("set").agg(F.min("rep").alias("after"))
    links = cut(jaccard_links(sets, "lead", "t", threshold))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("near"))  # a set's smallest key is its name
    known = sets.select("set", "lead").join(after, "set", "left").join(near.withColumnRenamed("a", "lead"), "lead", "left")
    own = F.when(F.col("rep") == F.col("lead"), F.col("after")).otherwise(F.col("lead"))
    found = lookup_join(texts.select("set", "x", "rep"), known, "set").select("x", F.least(own, "near").alias("other")).where("other is not null")
    return lookup_join(rows.select("k", "x"), found, "x").select(F.col("k").alias(key), "other")
