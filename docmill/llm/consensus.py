"""Problem 4: consensus from several annotators' labels.

Method: community confusion model. Annotators belong to a few types, each with its own confusion matrix; an
annotator's matrix is drawn around that of the type, so that those with few labels are judged by their like. Verdicts,
matrices and types are inferred by variational updates. The pass over the items is narrow: an item's labels lie in one
row, and only sums per annotator leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut, half_even

#: What an adjudicator's free wording may say, in lower case and trimmed; anything else is no verdict.
MET = ["1", "1.0", "pass", "passed", "yes", "y", "true", "t", "met", "accept", "accepted", "ok", "okay", "agree", "satisfied"]
NOT_MET = ["0", "0.0", "fail", "failed", "no", "n", "false", "f", "not met", "unmet", "reject", "rejected", "not ok", "disagree", "not satisfied"]
#: Types of annotators, weight of a type's matrix in an annotator's own, prior counts of a type (right, wrong).
TYPES, WEIGHT, PRIOR = 4, 12.0, (4.0, 2.0)
#: Iterations at most, and the change of any matrix entry at which they end; it is an error if they don't.
ITERATIONS, CHANGE = 200, 1e-3
#: Annotators' matrices are held by every task; more annotators than this are refused.
MOST_ANNOTATORS = 100_000


def verdict(wording: Column) -> Column:
    """1, 0 or null for an adjudicator's wording."""
    said = F.lower(F.regexp_replace(F.btrim(wording.cast("string"), F.lit(" \t\r\n\xa0.!")), r"\s+", " "))
    return F.when(said.isin(MET), 1).when(said.isin(NOT_MET), 0)


def unread(df: DataFrame, wording: str) -> DataFrame:
    """wording (in lower case, trimmed) and n of the adjudications that verdict() reads as none; nulls and blanks are left out."""
    said = F.lower(F.regexp_replace(F.btrim(F.col(wording).cast("string"), F.lit(" \t\r\n\xa0.!")), r"\s+", " "))
    return df.where(verdict(F.col(wording)).isNull() & (said != "")).groupBy(said.alias("wording")).agg(F.count(F.lit(1)).alias("n"))


def votes(df: DataFrame, row_id: str, item: list[str], sources: dict[str, Column]) -> DataFrame:
    """One row per item and annotator: the item's columns, annotator, n1 (labels 1) and n (labels).

    sources maps an annotator's column to the label it gave. A row delivered several times counts once. Labels that
    are null or neither 0 nor 1 don't count; an unnamed annotator's labels are those of the annotator "?". Items with
    a null key are left out. Labels are summed before they are shuffled, so an item that holds a large share of all
    rows is no hot spot.
    """
    keys = [f"_{k}" for k in range(len(item))]
    flat = [x for k, (a, c) in enumerate(sources.items()) for x in (F.coalesce(F.nullif(F.trim(F.col(a)), F.lit("")), F.lit("?")).alias(f"a{k}"), c.cast("int").cast("tinyint").alias(f"l{k}"))]
    rows = df.select(F.col(row_id).alias("_row"), *[F.col(c).alias(k) for c, k in zip(item, keys)], *flat).where(" and ".join(f"{k} is not null" for k in keys)).dropDuplicates(["_row"])
    said = rows.select(*keys, F.explode(F.array(*[F.struct(F.col(f"a{k}").alias("annotator"), F.col(f"l{k}").alias("label")) for k in range(len(sources))])).alias("x")).where("x.label in (0, 1)")
    return said.groupBy(*keys, F.col("x.annotator").alias("annotator")).agg(F.sum("x.label").alias("n1"), F.count(F.lit(1)).alias("n")).withColumnsRenamed(dict(zip(keys, item)))


@dataclass
class Model:
    """Annotators' codes (sorted), expected log matrices (annotator, truth, label), log odds of the truth, and types."""

    codes: np.ndarray
    logs: np.ndarray
    prior: np.ndarray
    matrix: np.ndarray
    kind: np.ndarray


def _flat(codes: pa.ListArray, ones: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, annotator's code and share of 1 of each vote."""
    rows = np.repeat(np.arange(len(codes)), np.diff(codes.offsets.to_numpy()))
    return rows, codes.flatten().to_numpy(), ones.flatten().to_numpy().astype(np.float64)


def _truth(model: Model, rows: np.ndarray, at: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """Chance of a 1 for each of n items."""
    odds = np.full(n, model.prior[1] - model.prior[0])
    gain = model.logs[:, 1] - model.logs[:, 0]
    odds += np.bincount(rows, gain[at, 0] * (1 - one) + gain[at, 1] * one, n)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _statistics(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    items = np.zeros(2)
    for batch in batches:
        rows, code, one = _flat(batch.column(0), batch.column(1))
        n = batch.num_rows
        known, at = np.unique(code, return_inverse=True)
        if model is None:  # at first every vote counts alike
            yes = (np.bincount(rows, one, n) + 0.5) / (np.bincount(rows, minlength=n) + 1)
        else:
            yes = _truth(model, rows, np.searchsorted(model.codes, known)[at], one, n)
        parts = [np.bincount(at, c[rows] * w, len(known)) for c in (1 - yes, yes) for w in (1 - one, one)]
        for k, c in enumerate(known.tolist()):
            sums[c] = sums.get(c, 0) + np.array([x[k] for x in parts])
        items += (n - yes.sum(), yes.sum())
    rows = [(c, *v.tolist()) for c, v in sums.items()] + [(None, *items.tolist(), 0.0, 0.0)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 5))], names=["code", "a", "b", "c", "d"])


def _digamma(x: np.ndarray) -> np.ndarray:
    up = np.zeros_like(x)
    while (low := x < 6).any():
        up -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    return up + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift -= np.where(low, np.log(x), 0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _update(codes: np.ndarray, counts: np.ndarray, items: np.ndarray, types: np.ndarray) -> tuple[Model, np.ndarray]:
    """The model after one step from expected counts (annotator, truth, label); and each annotator's chances of types."""
    base = np.array([[PRIOR[0], PRIOR[1]], [PRIOR[1], PRIOR[0]]])
    size = counts.sum(axis=2, keepdims=True)
    fair = counts * np.minimum(1, 5 * WEIGHT / np.maximum(size, 1e-9))  # no annotator alone makes a type
    shared = base + np.einsum("km,ktl->mtl", types, fair)
    shared /= shared.sum(axis=2, keepdims=True)
    alpha = WEIGHT * shared[None]
    after = alpha + fair[:, None]
    fit = (_log_gamma(after) - _log_gamma(alpha)).sum(axis=3) + _log_gamma(alpha.sum(axis=3)) - _log_gamma(after.sum(axis=3))
    share = np.log((types.sum(axis=0) + 1) / (len(types) + types.shape[1]))
    logit = fit.sum(axis=2) + share
    types = np.exp(logit - logit.max(axis=1, keepdims=True))
    types /= types.sum(axis=1, keepdims=True)
    own = WEIGHT * np.einsum("km,mtl->ktl", types, shared) + counts
    logs = _digamma(own) - _digamma(own.sum(axis=2, keepdims=True))
    prior = np.log((items + 1) / (items.sum() + 2))
    return Model(codes, logs, prior, own / own.sum(axis=2, keepdims=True), types.argmax(axis=1)), types


def _start(counts: np.ndarray) -> np.ndarray:
    """Types by rank of accuracy against the majority."""
    right = (counts[:, 0, 0] + counts[:, 1, 1] + 1) / (counts.sum(axis=(1, 2)) + 2)
    rank = np.argsort(np.argsort(right, kind="stable"), kind="stable")
    return np.eye(TYPES)[(rank * TYPES // max(1, len(rank))).astype(int)] * 0.8 + 0.2 / TYPES


def overall_agreement(labels: DataFrame, item: list[str]) -> DataFrame:
    """n_items, observed, expected and alpha (Krippendorff's, 4 digits) of votes as made by votes(), items with two annotators or more.

    An annotator's labels on an item are one vote, a share of 1; alpha is null if all votes are alike. All by partial sums.
    """
    one = F.col("n1") / F.col("n")
    g = labels.groupBy(*item).agg(F.count(F.lit(1)).alias("m"), F.sum(one).alias("ones"), F.sum(one * one + (1 - one) * (1 - one)).alias("own")).where("m > 1")
    agree = (F.col("ones") ** 2 + (F.col("m") - F.col("ones")) ** 2 - F.col("own")) / (F.col("m") - 1)
    t = g.agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("m"), F.sum("ones").alias("ones"), F.sum(agree).alias("agree"))
    zeros = F.col("m") - F.col("ones")
    observed, expected = F.col("agree") / F.col("m"), (F.col("ones") * (F.col("ones") - 1) + zeros * (zeros - 1)) / (F.col("m") * (F.col("m") - 1))
    t = t.select("n_items", F.when(F.col("m") > 0, observed).alias("observed"), F.when(F.col("m") > 1, expected).alias("expected"))
    return t.select("n_items", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"), F.round(F.when(F.col("expected") < 1, 1 - (1 - F.col("observed")) / (1 - F.col("expected"))), 4).alias("alpha"))


def consensus(labels: DataFrame, item: list[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, annotators) of votes as made by votes().

    verdicts: the item's columns, verdict (1 if the chance of 1 is at least a half, else 0), p_met, agreement (the
    share of pairs of different annotators' labels that agree; null for a single annotator), n_annotators, n_labels.
    overall_agreement() of them is corrected for chance.
    annotators: annotator, annotator_type, sensitivity, specificity, reliability (their mean), n_items. An annotator
    has one vote on an item, shared among the labels it gave there.
    """
    spark = labels.sparkSession
    vote = F.struct(F.xxhash64("annotator").alias("code"), (F.col("n1") / F.col("n")).cast("float").alias("one"))
    gathered = labels.groupBy(*item).agg(F.collect_list(vote).alias("v"), F.sum("n").alias("n_labels"))  # an item has at most one vote of each annotator
    lists = cut(gathered.select(*item, F.transform("v", lambda x: x["code"]).alias("codes"), F.transform("v", lambda x: x["one"]).alias("ones"), "n_labels"))
    only = lists.select("codes", "ones")

    def counted(model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = only.mapInArrow(lambda it: _statistics(it, model), "code long, a double, b double, c double, d double").groupBy("code").agg(*[F.sum(c).alias(c) for c in "abcd"])
        found = sums.limit(MOST_ANNOTATORS + 2).collect()
        if len(found) > MOST_ANNOTATORS + 1:
            raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
        items = np.array(next(((r["a"], r["b"]) for r in found if r["code"] is None), (0.0, 0.0)))
        named = sorted((r["code"], r["a"], r["b"], r["c"], r["d"]) for r in found if r["code"] is not None)
        return np.array([r[0] for r in named], np.int64), np.array([r[1:] for r in named], float).reshape(-1, 2, 2), items

    codes, counts, items = counted(None)
    model = Model(codes, np.zeros((0, 2, 2)), np.zeros(2), np.zeros((0, 2, 2)), np.zeros(0, int))
    if len(codes):
        model, types = _update(codes, counts, items, _start(counts))
        for _ in range(ITERATIONS):
            _, counts, items = counted(model)
            last = model.matrix
            model, types = _update(codes, counts, items, types)
            moved = np.abs(model.matrix - last).max()
            if moved < CHANGE:
                break
        else:
            raise RuntimeError(f"the annotators' matrices still move by {moved:.4f} after {ITERATIONS} iterations; raise ITERATIONS")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, code, one = _flat(batch.column(len(item)), batch.column(len(item) + 1))
            n = batch.num_rows
            yes = _truth(model, rows, np.searchsorted(model.codes, code), one, n)
            every, ones = np.bincount(rows, minlength=n).astype(float), np.bincount(rows, one, n)
            alone = np.bincount(rows, one**2 + (1 - one) ** 2, n)
            pairs = every**2 - every
            agree = pa.array((ones**2 + (every - ones) ** 2 - alone) / np.maximum(pairs, 1), pa.float64(), mask=pairs < 1)
            cols = [batch.column(k) for k in range(len(item))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array((yes >= 0.5).astype(np.int32)), pa.array(yes), agree, pa.array(every.astype(np.int64)), batch.column(len(item) + 2)], names=[*item, "verdict", "p_met", "agreement", "n_annotators", "n_labels"])

    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in item)
    verdicts = lists.select(*item, "codes", "ones", "n_labels").mapInArrow(judge, f"{kinds}, verdict int, p_met double, agreement double, n_annotators long, n_labels long")
    sure = [(int(c), int(model.kind[k]), float(model.matrix[k, 1, 1]), float(model.matrix[k, 0, 0])) for k, c in enumerate(codes)]
    worth = spark.createDataFrame(sure, "code long, annotator_type int, sensitivity double, specificity double")
    size = labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_labels")).withColumn("code", F.xxhash64("annotator"))
    annotators = size.join(F.broadcast(worth), "code").select(  # at most MOST_ANNOTATORS rows
        "annotator", "annotator_type", half_even(F.col("sensitivity"), 4).alias("sensitivity"), half_even(F.col("specificity"), 4).alias("specificity"),
        half_even((F.col("sensitivity") + F.col("specificity")) / 2, 4).alias("reliability"), "n_items", "n_labels",
    )
    return verdicts, annotators
