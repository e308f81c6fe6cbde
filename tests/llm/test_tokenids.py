import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import tokenids

pytestmark = pytest.mark.skipif(not os.path.exists(tokenids.RANKS), reason="no rank file")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300).filter(lambda t: t.isprintable() or t.encode("utf-8", "ignore").decode() == t), st.integers(1, 40))
def test_parts_give_the_ids_of_the_whole(text, size):
    assert list(tokenids.encode(text, size=size)) == list(tokenids.encode(text))
    assert tokenids.decode(tokenids.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "é", " ", "123", "!?", "\x1c", "　", "日本"]), max_size=60), st.integers(1, 9))
def test_parts_around_white_space(pieces, size):
    text = "".join(pieces)
    assert "".join(tokenids.parts(text, size)) == text
    assert list(tokenids.encode(text, size=size)) == list(tokenids.encode(text))


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenids.RANKS.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no such file")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for text in ("Plain text, with 12 numbers.", "<|endoftext|> is text\n\n  here", "Ünïcödé — 日本 👍🏽", "don't won't I'LL"):
        assert list(tokenids.encode(text)) == other.encode(text, add_special_tokens=False).ids


def test_operator_defined_cases(spark):
    long = "abc def, " * 60_000
    df = spark.createDataFrame([(1, ""), (2, None), (3, "Hello world"), (3, "Hello world"), (4, long), (5, "x" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("_key", F.lit(1))
    out = tokenids.token_ids(df, "doc_id", "text")
    assert dict(out.dtypes)["ids"] == "array<int>"
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 6 and got[1] == [] and got[2] == [] and got[3] == list(tokenids.encode("Hello world"))
    back = {r["doc_id"]: r["text"] for r in tokenids.token_text(out, "doc_id", "ids").collect()}
    assert back[4] == long and back[2] == "" and back[5] == "x" * 100_000
    assert tokenids.token_ids(df.limit(0), "doc_id", "text").count() == 0
