"""Vectors, similarity search, fusion and packing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions import text as T

#: Rows of a block of the corpus and of a block of queries in a block-wise search.
CORPUS_BLOCK, QUERY_BLOCK = 20_000, 5_000


@lru_cache(1 << 18)
def _bucket(word: str, size: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest(), 16) % size


def hashed_vector(text: Column, size: int = 256) -> Column:
    """VEC-1: unit vector of word counts over md5 buckets, words being runs of at least three letters a-z.

    Null texts and texts without a word give a vector of zeros. An Arrow function, as a vector built by nested
    higher-order functions would be evaluated once for each of its places.
    """

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts = np.bincount([_bucket(w, size) for w in re.findall("[a-z]{3,}", (t or "").lower())] or [0], minlength=size).astype(float)
            if not t or not counts.any() or not re.search("[a-z]{3}", t.lower()):
                counts[:] = 0
            out.append(counts / (np.linalg.norm(counts) or 1.0))
        return pd.Series(out)

    return vectors(text.cast("string"))


def hashed_terms(text: Column, size: int = 256) -> Column:
    """VEC-1 as map<int, double> of the buckets that aren't zero; the form for joins on buckets."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 25, 8), 16, 10).cast("long"), F.lit(size)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(buckets), lambda b: F.struct(b, F.size(F.filter(buckets, lambda x: x == b)).cast("double"))))


def _cells(df: DataFrame, own: str, other: str, n_own: int, n_other: int, key: str) -> DataFrame:
    """Rows in blocks of their own side, once for each block of the other side."""
    block = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")
    return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def block_topk(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, least: float | None = None, metric: str = "ip", digits: int = 6) -> DataFrame:
    """VEC-2 and VEC-12: exact top-k of a stated query set against all rows: query, key, score, rank_no.

    Both sides are cut into blocks of bounded size; each pair of blocks is one matrix product, of which only k rows a
    query leave the task. metric ip is the inner product, l2 minus the squared distance. Scores are rounded to
    `digits`; ties go to the smaller key. Rows without a vector, and with one of another length, take no part. With
    `least`, hits below it are dropped after ranking.
    """
    rows = corpus.select(F.col(key).alias("ckey"), F.col(vector).cast("array<double>").alias("cvec")).where("ckey is not null and cvec is not null").dropDuplicates(["ckey"])
    asked = queries.select(F.col(query).alias("qkey"), F.col(query_vector).cast("array<double>").alias("qvec")).where("qkey is not null and qvec is not null").dropDuplicates(["qkey"])
    blocks = -(-max(1, rows.count()) // CORPUS_BLOCK)
    query_blocks = -(-max(1, asked.count()) // QUERY_BLOCK)
    left, right = _cells(rows, "cb", "qb", blocks, query_blocks, "ckey"), _cells(asked, "qb", "cb", query_blocks, blocks, "qkey")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            size = len(b["qvec"].iloc[0])
            a = a[a["cvec"].map(len) == size].sort_values("ckey")
            b = b[b["qvec"].map(len) == size]
            if len(a):
                m, q = np.stack(a["cvec"].to_numpy()), np.stack(b["qvec"].to_numpy())
                ids = a["ckey"].to_numpy()
                for start in range(0, len(q), 500):
                    part = q[start : start + 500]
                    score = part @ m.T
                    if metric == "l2":
                        score = 2 * score - (m**2).sum(axis=1)[None] - (part**2).sum(axis=1)[:, None]
                    score = np.round(score, digits) + 0.0
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    for i, row in enumerate(top):
                        out.append(pd.DataFrame({"qkey": b["qkey"].iloc[start + i], "ckey": ids[row], "score": score[i, row]}))
        return pd.concat(out) if out else pd.DataFrame({"qkey": [], "ckey": [], "score": []})

    kinds = f"qkey {asked.schema['qkey'].dataType.simpleString()}, ckey {rows.schema['ckey'].dataType.simpleString()}, score double"
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(best, kinds)
    ranked = found.withColumn("rank_no", F.row_number().over(W.partitionBy("qkey").orderBy(F.desc("score"), "ckey"))).where(F.col("rank_no") <= k)
    if least is not None:
        ranked = ranked.where(F.col("score") >= least)
    return ranked.select(F.col("qkey").alias(query), F.col("ckey").alias(key), "score", "rank_no")


def allowed(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """VEC-3: rows whose source is allowed, before anything is ranked; no list, or an empty one, allows all."""
    return df.where(F.col(column).isin(list(names))) if names else df


def granted(own: list[str], asked: list[str] | None) -> list[str]:
    """VEC-4: the sources a caller may search: its own, or those of them it asks for; an empty result is refused."""
    found = [x for x in own if asked is None or x in set(asked)]
    if not found:
        raise PermissionError("no source is permitted")
    return found


def fuse(hits: DataFrame, group: str, facet: str, facet_order: str, depth: str, item: str, per_facet: int, top_k: int) -> DataFrame:
    """VEC-5: faceted fusion within each group: hits at depth <= per_facet, by depth and then facet, items once.

    An item stays where it first appears; the list ends at top_k and isn't filled up again. Adds rank_no.
    """
    order = [F.col(depth), F.col(facet_order), F.col(item)]
    near = hits.where(F.col(depth) <= per_facet)
    first = near.withColumn("_n", F.row_number().over(W.partitionBy(group, item).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("rank_no", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank_no") <= top_k).select(group, facet, item, depth, "rank_no")


def pack(hits: DataFrame, group: str, rank: str, size: str, budget: int) -> DataFrame:
    """VEC-7 and WIN-3: hits in rank order while their running size stays within the budget; the first one always.

    Null sizes count as 0. Adds running.
    """
    order = W.partitionBy(group).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy(group).orderBy(rank))
    run = hits.withColumns({"running": F.sum(F.coalesce(F.col(size), F.lit(0))).over(order), "_first": first == 1})
    return run.where((F.col("running") <= budget) | F.col("_first")).drop("_first")


def lexical_topk(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int) -> DataFrame:
    """VEC-11: rows by the number of distinct words of at least four letters shared with each query of a stated set.

    An inverted join on words; counts combine before the shuffle. Ties go to the smaller key; rows without a shared
    word are no hits.
    """
    pattern = "[a-z]{4,}"
    words = corpus.select(F.col(key).alias("ckey"), F.explode(T.tokens(F.col(text), pattern)).alias("w")).distinct()
    asked = queries.select(F.col(query).alias("qkey"), F.explode(T.tokens(F.col(query_text), pattern)).alias("w")).distinct()
    shared = words.join(asked, "w").groupBy("qkey", "ckey").agg(F.count(F.lit(1)).alias("overlap"))
    ranked = shared.withColumn("rank_no", F.row_number().over(W.partitionBy("qkey").orderBy(F.desc("overlap"), "ckey")))
    return ranked.where(F.col("rank_no") <= k).select(F.col("qkey").alias(query), F.col("ckey").alias(key), "overlap", "rank_no")


def single_query(name: Column, description: Column, keywords: Column) -> Column:
    """VEC-6: the one query of a functionality: name, description and keywords (an array), what is null or blank left out."""
    parts = F.array(F.trim(name), F.trim(description), F.trim(F.array_join(keywords, " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def applicable(controls: DataFrame, cases: str, case: str, doc: str, sources: list[str]) -> DataFrame:
    """PRJ-9: controls that apply to a case (`cases` is an array) and come from one of its sources."""
    return controls.where(F.array_contains(cases, case) & F.col(doc).isin(list(sources)))


def excerpt(text: Column, anchor: Column, limit: int = 360, least: int = 20) -> Column:
    """VEC-10: the sentences of more than `least` characters that share most words with the anchor, until `limit` characters.

    Ties keep the order of the text; without such a sentence the first `limit` characters.
    """
    wanted = T.tokens(anchor, "[a-z]{4,}")
    candidates = F.filter(T.sentences(text), lambda s: F.length(s) > least)
    scored = F.transform(candidates, lambda s, i: F.struct((-F.size(F.array_intersect(T.tokens(s, "[a-z]{4,}"), wanted))).alias("o"), i.alias("i"), s.alias("s")))
    joined = F.aggregate(
        F.array_sort(scored), F.lit(""), lambda done, x: F.when((done == "") | (F.length(done) + 1 + F.length(x["s"]) <= limit), F.trim(F.concat_ws(" ", done, x["s"]))).otherwise(done)
    )
    return F.substring(F.when(F.size(candidates) == 0, F.coalesce(text, F.lit(""))).otherwise(joined), 1, limit)


def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors of a column `vector`, batch by batch."""
    for batch in batches:
        batch["vector"] = [v / (np.linalg.norm(v) or 1.0) for v in batch["vector"]]
        yield batch
