import random

from pyspark.sql import functions as F

from docmill.llm import consensus as C


def long(spark, rows):
    """votes() of rows (row, item, annotator, label)."""
    df = spark.createDataFrame(rows, "row long, item string, who string, label int").withColumn("n", F.lit(5)).withColumn("annotator", F.lit("clash"))
    return C.votes(df, "row", ["item"], {"who": F.col("label")})


def test_worth_beats_the_majority(spark):
    rng = random.Random(1)
    worth = {"good1": 0.95, "good2": 0.93, "good3": 0.9, "bad1": 0.52, "bad2": 0.5, "bad3": 0.48, "bad4": 0.5, "contrary": 0.1, "rare": 0.95}
    truth = {f"i{k}": int(rng.random() < 0.6) for k in range(1500)}
    rows, row = [], 0
    for item, t in truth.items():
        for who, w in worth.items():
            if rng.random() < (0.02 if who == "rare" else 0.8):
                rows.append((row, item, who, t if rng.random() < w else 1 - t))
                row += 1
    verdicts, annotators = C.consensus(long(spark, rows), ["item"])
    got = {r["item"]: r["verdict"] for r in verdicts.collect()}
    by_item = {}
    for _, item, _, label in rows:
        by_item.setdefault(item, []).append(label)
    majority = sum((sum(v) * 2 >= len(v)) == truth[i] for i, v in by_item.items()) / len(by_item)
    right = sum(got[i] == truth[i] for i in got) / len(got)
    assert right > 0.97 and right > majority + 0.05
    r = {x["annotator"]: x["reliability"] for x in annotators.collect()}
    assert r["good1"] > 0.9 and abs(r["bad2"] - 0.5) < 0.1 and r["contrary"] < 0.25 and 0.5 < r["rare"] <= 1


def test_votes_defined_cases(spark):
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (2, "a", "x", 0), (3, "a", None, 1), (4, "a", " ", 0), (5, "a", "y", None), (6, "a", "y", 7), (7, None, "x", 1)]
    got = {(r["item"], r["annotator"], r["n1"], r["n"]) for r in long(spark, rows).collect()}
    assert got == {("a", "x", 1, 2), ("a", "?", 1, 2)}


def test_agreement_and_ties(spark):
    rows = [(1, "same", "x", 1), (2, "same", "y", 1), (3, "one", "x", 0), (4, "split", "x", 1), (5, "split", "y", 0)]
    verdicts, _ = C.consensus(long(spark, rows), ["item"])
    got = {r["item"]: r["agreement"] for r in verdicts.collect()}
    assert got == {"same": 1.0, "one": None, "split": 0.0}


def test_hot_item_and_empty_table(spark):
    rng = random.Random(2)
    rows = [(k, "hot" if k % 3 == 0 else f"i{k % 50}", f"w{rng.randrange(5)}", int(rng.random() < 0.9)) for k in range(3000)]
    verdicts, annotators = C.consensus(long(spark, rows), ["item"])
    assert verdicts.count() == 51 and annotators.count() == 5
    verdicts, annotators = C.consensus(long(spark, rows).limit(0), ["item"])
    assert verdicts.count() == 0 and annotators.count() == 0


def test_wordings(spark):
    said = ["1", " 1", "1.0", "PASS", "Y", "not ok", "FAIL", "0 ", "False", "see note", "-", "", None, "n/a", "?"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r["v"] for r in df.orderBy("i").select(C.verdict(F.col("s")).alias("v")).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 0] + [None] * 6


def test_chance_corrected_agreement(spark):
    rows = [("a", "x", 1, 1), ("a", "y", 1, 1), ("b", "x", 0, 1), ("b", "y", 0, 2), ("c", "x", 1, 1), ("c", "y", 0, 1), ("d", "x", 1, 1)]
    df = spark.createDataFrame(rows, "item string, annotator string, n1 long, n long")
    got = C.overall_agreement(df, ["item"]).collect()[0]
    # two of three pairs agree; three of six votes are 1: expected (3 * 2 + 3 * 2) / 30
    assert (got["n_items"], got["observed"], got["expected"]) == (3, 0.6667, 0.4) and abs(got["alpha"] - (1 - (1 / 3) / 0.6)) < 1e-3
    assert C.overall_agreement(df.limit(0), ["item"]).collect()[0]["alpha"] is None


def test_unread_wordings_are_counted(spark):
    df = spark.createDataFrame([("Pass.",), ("see note",), ("See  note!",), (None,), (" ",), ("0",)], "w string")
    assert [tuple(r) for r in C.unread(df, "w").collect()] == [("see note", 2)]
