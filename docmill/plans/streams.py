"""Queries on streams (run as batches here) and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import answers
from docmill.operators import chunking
from docmill.sources import markup
from docmill.session import read_table
from docmill.streaming import events


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of a day."""
    return events.windowed(read_table(spark, folder, "events"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with gaps of at least six hours."""
    return events.sessions(read_table(spark, folder, "events"), "6 hours")


def json_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """LLM-2: the properties of events, wrapped as models wrap their answers."""
    e = read_table(spark, folder, "events")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" done")))
    found = answers.recovered(wrapped)
    return e.select("event_id", found.isNotNull().alias("found"), F.get_json_object(found, "$.k").alias("k"))


def markup_sections(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-2: chunks written as markup, and their sections read again."""
    c = read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    plain = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    before = '<html><head><script>var x = 1 < 2;</script></head><body><p>Outside</p><div id="tabs"><nav><p>Menu</p></nav><div class="top navbar"><p>Bar</p></div><h2>7.1 <b>Part</b> one</h2><p>'
    after = "</p><h3>Notes &amp; terms</h3><ul><li>None<li><b>At</b> all</ul><footer><p>Foot</p></footer></div><p>Below</p></body></html>"
    html = F.concat(F.lit(before), plain, F.lit(after))
    return markup.sections(c.select("chunk_id", html.alias("html")), "chunk_id", "html").select("chunk_id", "section", "heading", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def marked_sections(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-3: chunks written as marked sections, document by document, and read again."""
    c = read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    one = F.concat(F.lit("### "), "section", F.lit(" | "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.regexp_replace("text", "### ", ""))
    files = c.select("chunk_id", one.alias("content"))
    return chunking.marked_sections(files, "chunk_id", "content").select("chunk_id", "section", "heading")


QUERIES = {f.__name__: f for f in (event_windows, event_sessions, json_recovery, markup_sections, marked_sections)}
SQL = {
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
        SELECT user_id, min(ts)::TIMESTAMP AS since, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS until, count(*) AS n FROM s GROUP BY user_id, s
    """,
    "json_recovery": "SELECT event_id, props IS NOT NULL AS found, json_extract_string(props, '$.k') AS k FROM events",
    "markup_sections": r"""
        WITH c AS (SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8209), ' -'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM chunks)
        SELECT chunk_id, '7.1' AS section, 'Part one' AS heading, md5(t) AS body_md5 FROM c WHERE t <> '' UNION ALL SELECT chunk_id, 'notes-terms', 'Notes & terms', md5('None' || chr(10) || 'At all') FROM c WHERE t IS NOT NULL
    """,
    "marked_sections": r"""
        SELECT DISTINCT chunk_id, trim(section) AS section, trim(coalesce(heading, ''), ' ') AS heading FROM chunks WHERE trim(text, e' \n\r\t') <> ''
    """,
}
