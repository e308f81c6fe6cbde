import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docmill.llm import neardup as N


def brute(rows, t):
    sets = {k: set(w.split()) for k, w in rows if w}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def collection(n, rng, vocabulary=400):
    rows = []
    for k in range(n):
        if k and rng.random() < 0.4:
            words = rows[rng.randrange(k)][1].split()
            words = [w for w in words if rng.random() > 0.06] + [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 3))]
            rng.shuffle(words)
        else:
            words = ["the", "of"] + [f"v{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(rng.randint(8, 50))]
        rows.append((k, " ".join(words)))
    return rows


def found(spark, rows, t, **how):
    df = spark.createDataFrame(rows, "id long, text string")
    members, sets = N.classes(df, "id", N.word_set(F.col("text")))
    return {(r["key_a"], r["key_b"]) for r in N.pairs(members, N.similar_classes(sets, t, **how)).collect()}


def test_all_pairs_of_brute_force(spark):
    rows = collection(300, random.Random(1))
    assert found(spark, rows, 0.7) == brute(rows, 0.7)


def test_small_buckets_are_split_again_and_compared_in_blocks(spark):
    rows = collection(200, random.Random(2), 60)
    assert found(spark, rows, 0.7, bucket=4, again=1, expected=4000) == brute(rows, 0.7)


def test_groups_are_components(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c d e f g h k l"), (4, "A, b c d e f g h i j!"), (5, "x y z"), (6, None), (7, "")]
    members, links = N.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", ["text"], 0.7)
    got = {r["key"]: (r["class_id"], r["group_id"]) for r in N.groups(links, members).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (1, 1), 5: (5, 5)}


def test_long_chain_settles(spark):
    n = 300
    members = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("class_id"))
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["group_id"] for r in N.groups(links, members).collect()} == {0}


def test_copies_nulls_repeats_and_clashing_names(spark):
    rows = [(k, "same words in every row", None) for k in range(6)] + [(0, "same words in every row", None), (None, "same words in every row", "x"), (9, None, None), (10, "", " ")]
    df = spark.createDataFrame(rows, "rtm_id long, s string, a string").withColumn("tokens", F.lit(1)).withColumn("key", F.lit(1)).withColumn("_key", F.lit(1)).withColumn("class_id", F.lit(1))
    members, links = N.near_duplicates(df, "rtm_id", ["s", "a"], 0.7)
    assert {(r["key_a"], r["key_b"]) for r in N.pairs(members, links).collect()} == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert links.count() == 0
    members, links = N.near_duplicates(df.limit(0), "rtm_id", ["s", "a"], 0.7)
    assert N.pairs(members, links).count() == 0 and N.groups(links, members).count() == 0


def test_very_long_set(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long), (2, long + " more"), (3, "w1 w2 w3")]
    assert found(spark, rows, 0.7) == {(1, 2)}


def test_sets_at_the_threshold(spark):
    """Seven shared tokens of ten are 0.7; with six of ten the sets are no pair."""
    rows = [(1, "a b c d e f g h i"), (2, "a b c d e f g j"), (3, "a b c d e f k l m n")]
    assert found(spark, rows, 0.7) == {(1, 2)}


def test_recall_of_each_band_over_deep_paths(spark):
    """Sets of a small vocabulary, paths split about as often as in a collection of millions; pairs by band against brute force."""
    rng = random.Random(9)
    rows = collection(1500, rng, 900)
    got, want = found(spark, rows, 0.7, expected=4, bucket=60), brute(rows, 0.7)
    sets = {k: set(w.split()) for k, w in rows}
    assert got <= want
    for low in (0.7, 0.75, 0.8, 0.9):
        band = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b])}
        assert len(got & band) >= 0.99 * len(band)


def test_short_sets_of_hot_words_meet(spark):
    """However many sets there are for the few expected in a bucket, no word of these sets is rare enough to end a path."""
    sets = [set(x) for k in (4, 5) for x in combinations("abcdefgh", k)]
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    assert found(spark, rows, 0.8, expected=1e-6) == {(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_rounds_that_end_early_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(N, "_missed", lambda pairs: [(10, 5.0)])
    with pytest.raises(RuntimeError, match="recall"):
        found(spark, collection(40, random.Random(3)), 0.7, expected=2, rounds=2)


def test_large_classes_meet_in_parts(spark):
    members = spark.createDataFrame([(k, 0 if k < 40 else 100 if k < 60 else k) for k in range(70)], "key long, class_id long")
    links = spark.createDataFrame([(0, 100, 7, 10), (0, 60, 8, 10), (61, 100, 9, 10)], "a long, b long, n_shared int, n_union int")
    got = [(r["key_a"], r["key_b"]) for r in N.pairs(members, links, part=7).collect()]
    group = {0: range(40), 100: range(40, 60), 60: [60], 61: [61]}
    want = {tuple(sorted((x, y))) for a, b in ((0, 0), (100, 100), (0, 100), (0, 60), (61, 100)) for x in group[a] for y in group[b] if x != y}
    assert len(got) == len(set(got)) and set(got) == want
