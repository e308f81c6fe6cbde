"""Conflicts between statements."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import values as V
from docmill.operators.retrieval import _bucket

#: Rows of a block of the pair search; every two blocks are one task's matrix product.
PAIR_BLOCK = 5_000


def quantities(text: Column) -> Column:
    """FN-S8: map of unit to the sorted distinct values that a text gives in it; an empty map for null."""
    t = F.coalesce(text, F.lit(""))
    numbers, units = F.regexp_extract_all(t, F.lit(V.QUANTITY), F.lit(1)), F.regexp_extract_all(t, F.lit(V.QUANTITY), F.lit(2))
    alias = F.create_map(*[F.lit(x) for pair in V.UNITS.items() for x in pair])
    found = F.zip_with(numbers, units, lambda n, u: F.struct(F.coalesce(F.try_element_at(alias, F.lower(u)), F.lower(u)).alias("u"), n.try_cast("double").alias("n")))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["u"])))
    return F.map_from_entries(F.transform(names, lambda u: F.struct(u, F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["u"] == u), lambda x: x["n"]))))))


def signals(a: str, b: str, more_a: str, more_b: str) -> Column:
    """CFL-1: what speaks for a conflict of two texts, in a fixed order; more_a and more_b add to them (null is empty).

    Different values in the same unit (units sorted), a negation on one side only (of the text itself), automation on
    one side and human review on the other.
    """
    ta, tb = F.concat_ws(" ", a, more_a), F.concat_ws(" ", b, more_b)
    qa, qb = quantities(ta), quantities(tb)
    units = F.filter(F.array_intersect(F.map_keys(qa), F.map_keys(qb)), lambda u: F.element_at(qa, u) != F.element_at(qb, u))
    numbers = F.transform(F.array_sort(units), lambda u: F.concat(F.lit("different values in "), u))
    holds = lambda t, p: F.coalesce(t.rlike(p), F.lit(False))
    negated = F.when(holds(F.col(a), V.NEGATION) != holds(F.col(b), V.NEGATION), F.lit("negation on one side only"))
    checked = (holds(ta, V.AUTOMATION) & holds(tb, V.REVIEW)) | (holds(tb, V.AUTOMATION) & holds(ta, V.REVIEW))
    return F.concat(numbers, F.array_compact(F.array(negated, F.when(checked, F.lit("automation against review")))))


def stakeholders(ids: Column) -> Column:
    """CFL-2: distinct stakeholders of ids like S-<who>-<n>, in order."""
    own = F.filter(ids, lambda s: s.startswith("S-") & (F.size(F.split(s, "-")) > 2))
    return F.array_distinct(F.transform(own, lambda s: F.split(s, "-")[1]))


def _codes(rows: pd.Series, seen: dict[tuple[str, str], int]) -> dict[str, np.ndarray]:
    """For each name in rows of (name, value) lists: the number in `seen` of each row's value, 0 where the row hasn't the name."""
    out: dict[str, np.ndarray] = {}
    for i, pairs in enumerate(rows):
        for x in pairs:
            out.setdefault(x["u"], np.zeros(len(rows), np.int64))[i] = seen.setdefault((x["u"], x["v"]), len(seen) + 1)
    return out


def _block(rows: pd.DataFrame, size: int, seen: dict[tuple[str, str], int]) -> dict:
    """Vectors and what the rules ask of the rows of a block, as arrays; `seen` is shared by blocks that meet."""
    counts = np.zeros((len(rows), size))
    for i, words in enumerate(rows["words"]):
        np.add.at(counts[i], np.frombuffer(words, np.uint16), 1.0)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return {"key": rows["key"].to_numpy(), "v": counts / np.where(norm > 0, norm, 1.0), "units": _codes(rows["units"], seen), "who": _codes(rows["who"], seen)} | {c: rows[c].to_numpy(bool) for c in ("negated", "auto", "checked")}


def _judged(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of rows i of x and j of y have a signal of CFL-1, and whether both have stakeholders (CFL-2) but none in common."""
    signalled = (x["negated"][i] != y["negated"][j]) | (x["auto"][i] & y["checked"][j]) | (y["auto"][j] & x["checked"][i])
    for u in x["units"].keys() & y["units"].keys():
        left, right = x["units"][u][i], y["units"][u][j]
        signalled |= (left > 0) & (right > 0) & (left != right)
    some = [np.any([c > 0 for c in z["who"].values()], axis=0) if z["who"] else np.zeros(len(z["key"]), bool) for z in (x, y)]
    apart = some[0][i] & some[1][j]
    for w in x["who"].keys() & y["who"].keys():
        apart &= ~((x["who"][w][i] > 0) & (y["who"][w][j] > 0))
    return signalled, apart


def candidate_pairs(df: DataFrame, key: str, text: str, more: str, ids: str, least: float = 0.55, duplicate: float = 0.86, most: int | None = None, size: int = 256, block: int = PAIR_BLOCK) -> DataFrame:
    """CFL-3, JOIN-6: a < b, score, signalled, duplicate, apart of every two rows that are candidates of a conflict.

    That is: similar from `least` (VEC-1 vectors of `text`, rounded to 6 digits), and with a signal (CFL-1, `more` added
    to the text), or duplicates, or of disjoint stakeholders (CFL-2, of the array `ids`). With `most`, only pairs that can be
    among the first `most` of SRT-3, signalled and duplicate first, leave a task; ranked_pairs ends the list. All
    rows meet all others: rows are cut into blocks and every two blocks are one matrix product, so the work grows as
    the square of the rows. Null keys take no part, repeated ones once; texts without a word are similar to nothing.
    """
    if size > 1 << 16:
        raise ValueError("a bucket has 16 bits")

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([_bucket(w, size) for w in re.findall("[a-z]{3,}", (t or "").lower())], np.uint16).tobytes() for t in texts])

    both = F.concat_ws(" ", text, more)
    holds = lambda t, p: F.coalesce(t.rlike(p), F.lit(False))
    units = F.transform(F.map_entries(quantities(both)), lambda e: F.struct(e["key"].alias("u"), e["value"].cast("string").alias("v")))
    who = F.transform(stakeholders(F.coalesce(ids, F.array().cast("array<string>"))), lambda w: F.struct(w.alias("u"), F.lit("").alias("v")))
    rows = df.where(F.col(key).isNotNull()).dropDuplicates([key]).select(
        F.col(key).alias("key"), words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words"), units.alias("units"), who.alias("who"),
        holds(F.col(text), V.NEGATION).alias("negated"), holds(both, V.AUTOMATION).alias("auto"), holds(both, V.REVIEW).alias("checked"),
    )
    blocks = -(-max(1, df.count()) // block)
    own = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = own.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other")
    kind = rows.schema["key"].dataType.simpleString()

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        p, q = cell["p"].iloc[0], cell["q"].iloc[0]
        seen: dict[tuple[str, str], int] = {}
        x = _block(cell[cell["own"] == p].reset_index(drop=True), size, seen)
        y = x if p == q else _block(cell[cell["own"] == q].reset_index(drop=True), size, seen)
        found, floor = [], -1.0
        for start in range(0, len(x["key"]), 500):
            score = x["v"][start : start + 500] @ y["v"].T
            # a pair's rank is 4 if signalled + 2 if a duplicate + its similarity, so one under floor - 6 can't come in
            i, j = np.nonzero(score >= max(least, floor - 6) - 1e-6)
            s = np.round(score[i, j], 6)
            i += start
            keep = s >= least
            if p == q:
                keep &= i < j
            i, j, s = i[keep], j[keep], s[keep]
            signalled, apart = _judged(x, y, i, j)
            twin = s >= duplicate
            keep = signalled | twin | apart
            a, b = x["key"][i[keep]], y["key"][j[keep]]
            new = pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "score": s[keep], "signalled": signalled[keep], "duplicate": twin[keep], "apart": apart[keep]})
            if most is not None:
                new = pd.concat([*found, new]) if found else new
                new = new.assign(r=4 * new["signalled"] + 2 * new["duplicate"]).sort_values(["r", "score", "a", "b"], ascending=[False, False, True, True]).head(most)
                floor = float((new["r"] + new["score"]).iloc[-1]) if len(new) == most else -1.0
                found = [new.drop(columns="r")]
            else:
                found.append(new)
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("a", "b", "score", "signalled", "duplicate", "apart")})

    return cells.groupBy("p", "q").applyInPandas(search, f"a {kind}, b {kind}, score double, signalled boolean, duplicate boolean, apart boolean")


def ranked_pairs(pairs: DataFrame, signalled: Column, duplicate: Column, similarity: str, keys: list[str], most: int = 24) -> DataFrame:
    """SRT-3: the report of the `most` pairs to look at first: signalled, duplicates, most similar, then by key."""
    return pairs.orderBy(F.desc(signalled), F.desc(duplicate), F.desc(similarity), *keys).limit(most)


def merge_duplicates(pairs: list[tuple[str, str]], sources: dict[str, int]) -> dict[str, str]:
    """CFL-4: record to the record it is merged into, over a short report of confirmed pairs in their order.

    The record with more sources is kept, the first on a tie; pairs of which one was merged before are skipped.
    """
    into: dict[str, str] = {}
    for a, b in pairs:
        if a in into or b in into or a == b:
            continue
        keep, drop = (a, b) if sources.get(a, 0) >= sources.get(b, 0) else (b, a)
        into[drop] = keep
    return into
