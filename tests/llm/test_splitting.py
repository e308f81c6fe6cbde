from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm.splitting import WORDS, split_oversized, split_text

MARKS = st.sampled_from([" ", " ", " ", ", ", ". ", "\n", "\n\n", "\r\n", "\t"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcXYZ§é", min_size=1, max_size=6), MARKS), max_size=400), st.integers(10, 60), st.text("abc ", max_size=9))
def test_pieces_cover_fit_and_overlap(words, limit, heading):
    overlap = limit // 5
    text = "".join(a + b for a, b in words)
    n = len(WORDS.findall(text))
    pieces = split_text(text, heading, limit, overlap)
    assert [w for a, b, c in pieces for w in range(b, c)] == list(range(n))
    for k, (a, b, c) in enumerate(pieces):
        assert c - a <= limit and c > b
        assert a == (b if k == 0 else b - overlap)
        assert k == 0 or a >= pieces[k - 1][0]  # the overlap lies in the piece before
    assert (len(pieces) > 1) == (n > limit)


def test_natural_boundaries_are_kept():
    part = lambda t, n: " ".join(f"{t}{i}." for i in range(n))
    text = part("Alpha", 60) + "\n\n" + part("Beta", 60) + "\n\n" + part("Gamma", 60)
    assert [b for _, b, _ in split_text(text, None, 90, 10)] == [0, 60, 120]


def test_text_without_marks_and_very_long_text():
    assert max(c - a for a, _, c in split_text("w " * 5000)) <= 800
    assert len(split_text("word. " * 300_000)) >= 300_000 // 800


def test_operator_defined_cases(spark):
    long = "word " * 900
    rows = [(1, long, "H"), (1, long, "H"), (2, long, None), (3, "word " * 800, "H"), (4, None, "H"), (5, "", "H"), (6, " \n\t", "H"), (None, long, "H")]
    df = spark.createDataFrame(rows, "hit_id long, text string, heading string").withColumn("_key", F.lit(0)).withColumn("piece", F.lit("x")).withColumn("token_count", F.lit(3))
    out = split_oversized(df, "hit_id", "text", "heading").orderBy("hit_id", "piece_no").collect()
    assert [(r["hit_id"], r["piece_no"], r["n_pieces"]) for r in out] == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2)]
    assert out[2]["heading"] is None and out[0]["heading"] == "H" and len(out[1]["piece"].split()) == out[1]["n_words"]
    assert split_oversized(df.limit(0), "hit_id", "text", "heading").count() == 0
