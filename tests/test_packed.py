import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.operators.packed import _best, _unquote, atoms, unpack


def values(cell, model=None):
    return [v for s in atoms(cell) for v in _best(s, model)]


@pytest.mark.parametrize(
    "cell, wanted",
    [
        ("a; b;c", ["a", "b", "c"]), ("a | b||c", ["a", "b", "c"]), ("a\nb\tc", ["a", "b", "c"]), ("- a\n- b", ["a", "b"]), ("• a", ["a"]), ("a；b", ["a", "b"]), ("a, b and c", ["a", "b", "c"]),
        ('"x; y", z', ["x; y", "z"]), ('"say ""hi"" now"|z', ['say "hi" now', "z"]), ("['a, 1', 'b']", ["a, 1", "b"]), ('["a", "b"]', ["a", "b"]), ("a;;b; ", ["a", "b"]), ("a; a", ["a", "a"]),
        (None, []), ("", []), ("  ", []), ("N/A", []), ("none", []), ("-", []), ("[]", []), (' "a b"  ', ["a b"]), ("x / y", ["x", "y"]), ("x/y", ["x", "y"]), ("[a; b]", ["a", "b"]), ('"', ['"']),
    ],
)
def test_cells(cell, wanted):
    assert values(cell) == wanted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc;,|/ \"x", min_size=1, max_size=8).map(str.strip).filter(lambda x: x and not x.startswith('"') and not x.endswith('"')), min_size=1, max_size=5), st.sampled_from(["; ", "|", "\n", ", "]))
def test_quoted_values_come_back(items, mark):
    cell = mark.join('"' + x.replace('"', '""') + '"' for x in items)
    assert values(cell) == [_unquote('"' + x.replace('"', '""') + '"') for x in items] == items


def test_learned_splits_keep_frequent_values_whole(spark):
    rows = [(i, "Mass and balance") for i in range(40)] + [(100 + i, "AB-1 and AB-2") for i in range(3)] + [(200 + i, f"AB-{i % 3 + 1}") for i in range(60)]
    out = unpack(spark.createDataFrame(rows, "id long, c string"), "id", ["c"])
    got = {r["id"]: [] for r in out.collect()}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        got[r["id"]].append(r["val"])
    assert got[100] == ["AB-1", "AB-2"]


def test_values_of_many_parts_that_the_column_knows_stay_whole(spark):
    title = "Scope, purpose, roles, duties, and records"
    rows = [(i, f'"{title}"; Part {i % 3}') for i in range(60)] + [(100, title), (101, f"{title}; Part 1"), (102, "Part 1, Part 2")]
    got = {}
    for r in sorted(unpack(spark.createDataFrame(rows, "id long, c string"), "id", ["c"]).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["id"], []).append(r["val"])
    assert got[100] == [title] and got[101] == [title, "Part 1"] and got[102] == ["Part 1", "Part 2"]


def test_a_cell_is_read_alike_in_small_and_large_columns(spark):
    rows = [(i, "Mass and balance") for i in range(40)] + [(50 + i, f"AB-{i % 9}") for i in range(60)] + [(150, "AB-1 and AB-2")]
    more = [(1000 + i, r[1]) for i, r in enumerate(rows * 30)]
    read = [sorted((r["pos"], r["val"]) for r in unpack(spark.createDataFrame(x, "id long, c string"), "id", ["c"]).where("id = 150").collect()) for x in (rows, rows + more)]
    assert read[0] == read[1] == [(1, "AB-1"), (2, "AB-2")]


def test_rounds_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="settle"):
        unpack(spark.createDataFrame([(1, "a, b")], "id long, c string"), "id", ["c"], rounds=0)


def test_repeats_nulls_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a;b", None), (1, "a;b", None), (2, None, "x"), (None, "a", "b")], "id long, c string, d string").withColumn("cell", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("field", F.lit(3))
    out = sorted(map(tuple, unpack(df, "id", ["c", "d"]).collect()))
    assert out == [(1, "c", 1, "a"), (1, "c", 2, "b"), (2, "d", 1, "x")]
    assert unpack(df.limit(0), "id", ["c", "d"]).count() == 0


def test_long_cell():
    assert len(values("; ".join(f"v{i}" for i in range(50_000)))) == 50_000
