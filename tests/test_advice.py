
import pytest

from docmill.operators import conflicts
from docmill.plans import audits, rollups
from docmill.session import read_table
from tests.compare import assert_same, database


@pytest.mark.parametrize("block", [7, 5000])
def test_candidate_pairs_are_all_pairs(spark, data, block):
    r = audits.requirements(spark, data)
    df = conflicts.candidate_pairs(r, "rtm_id", "statement", "acceptance_criteria", r["sources"], block=block)
    assert_same(df, database(data), audits._PAIRS + "SELECT * FROM k")


def test_candidate_pairs_has_no_cap_on_partners(spark):
    rows = [(i, "the clinic system shall record every order of the day", "within 5 seconds" if i % 2 else "within 9 seconds", ["S-A-1"]) for i in range(40)]
    df = conflicts.candidate_pairs(spark.createDataFrame(rows, "k long, s string, c string, w array<string>"), "k", "s", "c", conflicts.F.col("w"), block=9)
    got = df.collect()
    assert len(got) == 40 * 39 // 2 and sum(r["signalled"] for r in got) == 20 * 20 and not any(r["apart"] for r in got)


def test_every_order_gets_one_id(spark, data):
    got = rollups.QUERIES["id_assignment"](spark, data).collect()
    keys = [r["o_orderkey"] for r in read_table(spark, data, "orders").select("o_orderkey").collect()]
    assert sorted(r["o_orderkey"] for r in got) == sorted(keys) and len({r["new_id"] for r in got}) == len(keys)


def test_no_relation_is_lost(spark):
    rows = [("a", "supports", "D01#S1#c01"), ("b", "replaces", None), ("c", None, "D01#S1#c01"), ("d", " GAP ", None)]
    got = {r["req_id"]: r.asDict() for r in rollups.all_relations(spark.createDataFrame(rows, "req_id string, relation string, evidence_chunk_id string")).collect()}
    assert [got["a"]["supports"], got["b"]["other"], got["c"]["other"], got["d"]["GAP"]] == ["D", "I", "D", "I"]
    assert all(sum(v != "" for k, v in r.items() if k != "req_id") == 1 for r in got.values())
