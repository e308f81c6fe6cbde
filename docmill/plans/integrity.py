"""Queries on references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.packed import unpack
from docmill.operators.references import Reference, Register, orphans
from docmill.session import read_table

CHUNK_ID = r"D\d{2}#S[^#\s]+#c\d{2,}"
PACKED = ["controls", "regulations", "evidence_chunks", "source_documents"]


def _orphans(spark: SparkSession, folder: str, leaves: bool) -> DataFrame:
    """Orphans over the foreign-key graph; with leaves also those of tables that nothing refers to and p3_found doesn't ask for."""

    def table(name: str) -> DataFrame:
        return read_table(spark, folder, name)

    conflicts, rtm = table("conflicts"), table("rtm")
    registers = [
        Register("chunks", table("chunks"), "chunk_id", "ingested_at", "retired_at"),
        Register("conflicts", conflicts, "conflict_id", "detected_at", "retired_at"),
        Register("rtm", rtm, "req_id", "recorded_at", "retired_at"),
    ]
    kind = F.lower(F.trim("item_type"))
    cited = rtm.select("rtm_id", "req_id", "recorded_at", F.explode(F.regexp_extract_all(F.coalesce("evidence_chunks", F.lit("")), F.lit(CHUNK_ID), F.lit(0))).alias("evidence_chunks"))
    refs = [
        Reference("compliance", table("compliance"), "row_id", "evidence_chunk_id", "mapped_at", {"chunks": None}),
        Reference(
            "review_queue", table("review_queue"), "row_id", "item_id", "queued_at",
            {"conflicts": kind == "conflict", "rtm": kind.isNull() | ~kind.isin("conflict", "injection_quarantine")},
        ),
        Reference("findings", table("findings"), "row_id", "req_id", "raised_at", {"rtm": None}),
        Reference("findings", table("findings"), "row_id", "conflict_id", "raised_at", {"conflicts": None}),
        Reference("conflicts", conflicts, "conflict_id", "req_a", "detected_at", {"rtm": None}, own_key="conflict_id"),
        Reference("conflicts", conflicts, "conflict_id", "req_b", "detected_at", {"rtm": None}, own_key="conflict_id"),
        Reference("rtm", cited, "rtm_id", "evidence_chunks", "recorded_at", {"chunks": None}, own_key="req_id"),
    ]
    if leaves:
        refs.append(Reference("compliance", table("compliance"), "row_id", "req_id", "mapped_at", {"rtm": None}))
        refs.append(Reference("validation_29148", table("validation_29148"), "score_id", "req_id", "scored_at", {"rtm": None}))
    return orphans(registers, refs)


CHECKED = (("compliance", "evidence_chunk_id"), ("review_queue", "item_id"), ("findings", "req_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans of the three checked references."""
    wanted = F.lit(False)
    for name, column in CHECKED:
        wanted = wanted | ((F.col("src_table") == name) & (F.col("column") == column))
    return (
        _orphans(spark, folder, False).where(wanted & (F.col("kind") == "direct")).select("src_table", F.col("row_id").cast("long").alias("row_id"), "period", "reason")
    )


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, column and month, direct and inherited."""
    return (
        _orphans(spark, folder, True)
        .groupBy("src_table", "column", "period", "kind", "reason", "depth")
        .agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("key").alias("n_keys"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values packed in four fields of rtm."""
    return unpack(read_table(spark, folder, "rtm"), "rtm_id", PACKED)


_KEY = "nullif(lower(trim({0}, e' \\t\\r\\n\\v\\f')), '')"
_CTE = f"""
    WITH life AS (
        SELECT 'chunks' AS register, {_KEY.format("chunk_id")} AS k, min(ingested_at) AS since, max(retired_at) AS until FROM chunks GROUP BY 2
        UNION ALL SELECT 'conflicts', {_KEY.format("conflict_id")}, min(detected_at), max(retired_at) FROM conflicts GROUP BY 2
        UNION ALL SELECT 'rtm', {_KEY.format("req_id")}, min(recorded_at), max(retired_at) FROM rtm GROUP BY 2
    ), refs AS (
        SELECT DISTINCT 'compliance' AS src_table, row_id, mapped_at AS ts, 'chunks' AS register, {_KEY.format("evidence_chunk_id")} AS k FROM compliance
        UNION ALL SELECT DISTINCT 'review_queue', row_id, queued_at, CASE WHEN item_type = 'conflict' THEN 'conflicts' ELSE 'rtm' END, {_KEY.format("item_id")}
        FROM review_queue WHERE item_type IS NULL OR item_type <> 'injection_quarantine'
        UNION ALL SELECT DISTINCT 'findings', row_id, raised_at, 'rtm', {_KEY.format("req_id")} FROM findings
    )
    SELECT src_table, row_id, strftime(ts, '%Y-%m') AS period,
           CASE WHEN l.k IS NULL THEN 'missing' WHEN since > ts THEN 'late' ELSE 'deleted' END AS reason
    FROM refs r LEFT JOIN life l ON r.register = l.register AND r.k = l.k
    WHERE r.k IS NOT NULL AND (l.k IS NULL OR since > ts OR until <= ts)
"""
_REPORT = f"""
    WITH RECURSIVE life AS (
        SELECT 'chunks' AS register, {_KEY.format("chunk_id")} AS k, min(ingested_at) AS since, max(retired_at) AS until FROM chunks GROUP BY 2
        UNION ALL SELECT 'conflicts', {_KEY.format("conflict_id")}, min(detected_at), max(retired_at) FROM conflicts GROUP BY 2
        UNION ALL SELECT 'rtm', {_KEY.format("req_id")}, min(recorded_at), max(retired_at) FROM rtm GROUP BY 2
    ), cited AS (SELECT rtm_id, req_id, recorded_at, unnest(regexp_extract_all(coalesce(evidence_chunks, ''), '{CHUNK_ID}')) AS c FROM rtm),
    refs AS (
        SELECT DISTINCT 'compliance' AS src_table, 'evidence_chunk_id' AS col, row_id::VARCHAR AS row_id, mapped_at AS ts, 'chunks' AS register, {_KEY.format("evidence_chunk_id")} AS k, NULL::VARCHAR AS own FROM compliance
        UNION ALL SELECT DISTINCT 'review_queue', 'item_id', row_id::VARCHAR, queued_at, CASE WHEN lower(trim(item_type, ' ')) = 'conflict' THEN 'conflicts' ELSE 'rtm' END, {_KEY.format("item_id")}, NULL
        FROM review_queue WHERE item_type IS NULL OR lower(trim(item_type, ' ')) <> 'injection_quarantine'
        UNION ALL SELECT DISTINCT 'findings', 'req_id', row_id::VARCHAR, raised_at, 'rtm', {_KEY.format("req_id")}, NULL FROM findings
        UNION ALL SELECT DISTINCT 'findings', 'conflict_id', row_id::VARCHAR, raised_at, 'conflicts', {_KEY.format("conflict_id")}, NULL FROM findings
        UNION ALL SELECT DISTINCT 'conflicts', 'req_a', conflict_id, detected_at, 'rtm', {_KEY.format("req_a")}, {_KEY.format("conflict_id")} FROM conflicts
        UNION ALL SELECT DISTINCT 'conflicts', 'req_b', conflict_id, detected_at, 'rtm', {_KEY.format("req_b")}, {_KEY.format("conflict_id")} FROM conflicts
        UNION ALL SELECT DISTINCT 'rtm', 'evidence_chunks', rtm_id::VARCHAR, recorded_at, 'chunks', {_KEY.format("c")}, {_KEY.format("req_id")} FROM cited
        UNION ALL SELECT DISTINCT 'compliance', 'req_id', row_id::VARCHAR, mapped_at, 'rtm', {_KEY.format("req_id")}, NULL FROM compliance
        UNION ALL SELECT DISTINCT 'validation_29148', 'req_id', score_id::VARCHAR, scored_at, 'rtm', {_KEY.format("req_id")}, NULL FROM validation_29148
    ), seen AS (
        SELECT r.*, CASE WHEN l.k IS NULL THEN 'missing' WHEN since > ts THEN 'late' WHEN until <= ts THEN 'deleted' END AS reason
        FROM refs r LEFT JOIN life l ON r.register = l.register AND r.k = l.k WHERE r.k IS NOT NULL
    ), found AS (
        SELECT src_table, col, row_id, ts, k, own, reason, 0 AS depth FROM seen WHERE reason IS NOT NULL
        UNION SELECT s.src_table, s.col, s.row_id, s.ts, s.k, s.own, 'inherited', f.depth + 1 FROM found f JOIN seen s ON s.register = f.src_table AND s.k = f.own WHERE s.reason IS NULL AND f.depth < 20
    ), first AS (SELECT *, min(depth) OVER (PARTITION BY src_table, col, row_id) AS d FROM found)
    SELECT src_table, col AS column, strftime(ts, '%Y-%m') AS period, CASE WHEN depth = 0 THEN 'direct' ELSE 'indirect' END AS kind, reason, depth, count(DISTINCT row_id) AS n_rows, count(DISTINCT k) AS n_keys
    FROM first WHERE depth = d GROUP BY ALL
"""
QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found)}
SQL = {"p3_found": _CTE, "p3_report": _REPORT}
