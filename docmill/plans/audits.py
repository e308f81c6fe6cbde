"""Queries on quality, citations, confidence, conflicts and privacy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import audit, confidence as conf, conflicts, privacy, quality, retrieval, similarity
from docmill.session import cut, lookup_join, read_table

CHUNK_ID = r"D\d{2}#S[^#\s]+#c\d{2,}"
_ROLES = ["rtm_id", "req_id", "statement", "acceptance_criteria", "verification_method", "evidence_chunks", "stakeholder_statements", "regulations", "origin", "confidence"]


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of rtm, each once, with cites and sources as arrays."""
    r = read_table(spark, folder, "rtm").dropDuplicates(["rtm_id"]).select(*_ROLES)
    return r.withColumns(
        {
            "cites": F.regexp_extract_all(F.coalesce("evidence_chunks", F.lit("")), F.lit(CHUNK_ID), F.lit(0)),
            "sources": F.regexp_extract_all(F.coalesce("stakeholder_statements", F.lit("")), F.lit(r"S-[A-Z]+-\d+"), F.lit(0)),
        }
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"])


def near_duplicate_first(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-7, DUP-1."""
    r = requirements(spark, folder)
    return similarity.first_near_duplicate(r.withColumn("t", T.tokens(F.col("statement"))), "rtm_id", "statement", "t").where("other is not null")


def unknown_chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-4, HAL-6."""
    return audit.unknown_ids(requirements(spark, folder), "rtm_id", "cites", chunks(spark, folder), "chunk_id")


def rule_scores_long(spark: SparkSession, folder: str) -> DataFrame:
    """QA-1, QA-2."""
    return _scored(spark, folder, False).select("rtm_id", "attribute", "rule_score")


def _scored(spark: SparkSession, folder: str, notes: bool) -> DataFrame:
    r = requirements(spark, folder)
    unknown = unknown_chunk_ids(spark, folder)
    bad = unknown.groupBy("rtm_id").agg(F.array_sort(F.collect_list("id")).alias("unknown"))
    twin = near_duplicate_first(spark, folder)
    if notes:  # the twin's text is part of a note; its key is enough for a score
        twin = lookup_join(twin, r.select(F.col("rtm_id").alias("other"), F.col("statement").alias("twin")), "other")
    else:
        twin = twin.withColumn("twin", F.lit("near"))
    full = r.join(bad, "rtm_id", "left").join(twin, "rtm_id", "left")
    none = F.array().cast("array<string>")
    scored = quality.rules(
        "statement", "acceptance_criteria", "verification_method", F.col("cites"), none, F.coalesce("unknown", none), F.col("sources"), F.coalesce(F.col("origin") == "control_gap", F.lit(False)), F.col("twin")
    )
    return quality.score_rows(full, ["rtm_id"], scored, notes)


def rule_pass_rate(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1."""
    s = rule_scores_long(spark, folder)
    return s.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.sum("rule_score").alias("passed"), F.bround(F.avg("rule_score"), 3).alias("pass_rate"))


def keyword_categories(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-14, PRJ-15, PRJ-16."""
    r = requirements(spark, folder).withColumn("c", quality.categories(F.col("statement")))
    kind = F.when(F.array_contains("c", "functional"), "FR").otherwise("NFR")
    return r.select("rtm_id", F.array_join("c", ",").alias("categories"), kind.alias("type"), quality.primary(F.col("c"), list(V.CATEGORIES)).alias("primary_category"))


def undefined_terms(spark: SparkSession, folder: str) -> DataFrame:
    """QA-6."""
    return chunks(spark, folder).select("chunk_id", F.explode(quality.undefined_terms(F.col("text"), V.GLOSSARY)).alias("term"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "validation_29148").dropDuplicates(["score_id"])


def score_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """QA-4."""
    return _scores(spark, folder).where("rule_score is not null").select("score_id", quality.agreement(F.col("rule_score"), F.col("llm_score")).alias("agreed"))


def adjudication_report(spark: SparkSession, folder: str) -> DataFrame:
    """QA-5: the twelve disagreements to decide first."""
    order = F.array_position(F.array(*[F.lit(a) for a in V.ATTRIBUTES]), F.col("attribute"))
    d = _scores(spark, folder).where("rule_score <> llm_score").withColumn("priority", order)
    return d.orderBy("priority", "req_id", "score_id").limit(12).select("score_id", "req_id", "attribute", "rule_score", "llm_score")


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    return audit.citation_rows(requirements(spark, folder), "rtm_id", F.concat_ws(" ", "statement", "acceptance_criteria", "regulations"))


def entity_extract(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-1: distinct citations of each document by kind."""
    rows = audit.citation_rows(read_table(spark, folder, "documents"), "doc_id", F.col("text"))
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def citation_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-2, HAL-3, HAL-4, HAL-7."""
    rows = cut(_cited(spark, folder))  # a few citations a row, read by the search and by the join
    v = audit.citation_verdicts(rows, audit.corpus_presence(rows, read_table(spark, folder, "chunks"), "chunk_id", "text"), ["430", "440", "450"])
    return v.select("rtm_id", "kind", "entity", "verdict", audit.severity(F.col("verdict"), F.lit(False)).alias("severity"))


def severity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-7: counts by kind, verdict and severity."""
    return citation_verdicts(spark, folder).groupBy("kind", "verdict", "severity").agg(F.count(F.lit(1)).alias("n"))


def quote_audit(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-5: the texts of all hits, as quotes of their chunks, against all chunks."""
    q = read_table(spark, folder, "hits").withColumn("c", F.array("chunk_id"))
    return audit.quote_verdicts(q, "hit_id", "text", "c", read_table(spark, folder, "chunks"), "chunk_id", "text")


#: A quoted passage, the evidence that a row of rtm gives.
QUOTED = r'["“]([^"”]{12,})["”]'


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return requirements(spark, folder).select("rtm_id", "cites", F.regexp_extract(F.concat_ws(" ", "statement", "acceptance_criteria"), QUOTED, 1).alias("quote")).where("quote <> ''")


def evidence_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-1, HAL-5: verdict of the first quoted passage of each row of rtm."""
    return audit.quote_verdicts(_passages(spark, folder), "rtm_id", "quote", "cites", read_table(spark, folder, "chunks"), "chunk_id", "text")


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """HAL-1: all verdicts on a row of rtm: citations, its quoted passage, and cited chunks that don't exist."""
    cited = citation_verdicts(spark, folder).select("rtm_id", F.col("kind").alias("entity_type"), "entity", "verdict", "severity")
    quotes = evidence_quotes(spark, folder).join(_passages(spark, folder).select("rtm_id", F.col("quote").alias("entity")), "rtm_id")
    quotes = quotes.select("rtm_id", F.lit("evidence_quote").alias("entity_type"), "entity", "verdict", audit.severity(F.col("verdict"), F.lit(False)).alias("severity"))
    ids = unknown_chunk_ids(spark, folder).select("rtm_id", F.lit("chunk_id").alias("entity_type"), F.col("id").alias("entity"), F.lit("fabricated").alias("verdict"), F.lit("medium").alias("severity"))
    return cited.unionByName(quotes).unionByName(ids)


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    """CNF-1, CNF-2, CNF-3, JOIN-2: confidence of every row of rtm, from its audit, scores and conflicts."""
    r = requirements(spark, folder)
    q = conf.quality(_scores(spark, folder), ["req_id"], "rule_score", "llm_score")
    disputed = read_table(spark, folder, "conflicts").where("lower(trim(status)) = 'open'")
    disputed = disputed.select(F.explode(F.array("req_a", "req_b")).alias("req_id")).distinct().withColumn("disputed", F.lit(True))
    rows = audit_rows(spark, folder)
    wrong = F.col("verdict").isin("fabricated", "misattributed")
    seen = rows.groupBy("rtm_id").agg(
        F.bool_or((F.col("entity_type") != "chunk_id") & wrong).alias("wrong"), F.bool_or(F.col("entity_type") == "chunk_id").alias("bad"), F.bool_or((F.col("entity_type") == "evidence_quote") & (F.col("verdict") == "verified")).alias("quoted")
    )
    full = lookup_join(r, q.join(disputed, "req_id", "full"), "req_id").join(seen, "rtm_id", "left")
    sources = F.array_distinct(F.transform("sources", conf.source_of))
    full = full.withColumn("support", conf.support(F.coalesce("quoted", F.lit(False)), F.col("cites"), sources, F.coalesce(F.col("origin") == "control_gap", F.lit(False))))
    caps = [(F.col("wrong"), 0.3, "fabricated or misattributed"), (F.col("disputed"), 0.5, "unresolved conflict"), (F.col("bad"), 0.3, "unknown citation")]
    return conf.confidence(full.withColumn("stated", F.col("confidence")), "support", "quality", caps).select("rtm_id", "support", F.bround("quality", 3).alias("quality"), "confidence", "escalate", "reasons")


def review_first(spark: SparkSession, folder: str) -> DataFrame:
    """CNF-4, SRT-1: all rows in the order of review: those to escalate first, then by confidence."""
    return confidence(spark, folder).orderBy(F.desc("escalate"), "confidence", "rtm_id").select("rtm_id", "confidence", "escalate")


def quantity_map(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S8."""
    q = conflicts.quantities(F.concat_ws(" ", "statement", "acceptance_criteria"))
    return requirements(spark, folder).select("rtm_id", F.explode(q).alias("unit", "v")).select("rtm_id", "unit", F.size("v").alias("n_values"), F.array_max("v").alias("largest"))


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    r = read_table(spark, folder, "rtm")
    last = r.groupBy("req_id").agg(F.max_by(F.struct("statement", "acceptance_criteria"), F.struct("version", "rtm_id")).alias("x"))
    return last.select("req_id", "x.*")


def conflict_signals(spark: SparkSession, folder: str) -> DataFrame:
    """CFL-1: signals of the recorded conflicts, from the newest versions of both sides."""
    c = read_table(spark, folder, "conflicts").dropDuplicates(["conflict_id"])
    n = _newest(spark, folder)
    a, b = [n.select(F.col("req_id").alias(f"req_{s}"), F.col("statement").alias(f"s{s}"), F.col("acceptance_criteria").alias(f"c{s}")) for s in "ab"]
    met = c.join(a, "req_a").join(b, "req_b")
    return met.select("conflict_id", conflicts.signals("sa", "sb", "ca", "cb").alias("found"))


def negation_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S9: recorded conflicts with a negation on one side only."""
    return conflict_signals(spark, folder).where(F.array_contains("found", "negation on one side only")).select("conflict_id")


def conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """CFL-3, JOIN-6, SRT-3: of all pairs of rows of rtm that are candidates of a conflict, the 24 to look at first."""
    found = conflicts.candidate_pairs(requirements(spark, folder), "rtm_id", "statement", "acceptance_criteria", F.col("sources"), most=24)
    return conflicts.ranked_pairs(found, F.col("signalled"), F.col("duplicate"), "score", ["a", "b"])


def conflict_report(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-3: the 24 recorded conflicts to look at first."""
    c = read_table(spark, folder, "conflicts").dropDuplicates(["conflict_id"])
    return conflicts.ranked_pairs(c, F.size("signals") > 0, F.col("similarity") >= 0.86, "similarity", ["conflict_id"]).select("conflict_id", "similarity")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.personal_spans(read_table(spark, folder, "documents"), "doc_id", "text")


def pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-1, SEC-2."""
    return _spans(spark, folder).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.start", "s.stop", "s.value")


def pii_masked(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-3, SEC-4."""
    s = _spans(spark, folder)
    return privacy.masked(s, "doc_id", privacy.vault(s, "doc_id"))


def pii_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-5: kinds still found in the masked texts; no rows are expected."""
    again = privacy.personal_spans(pii_masked(spark, folder), "doc_id", "masked")
    return again.select("doc_id", F.array_join(privacy.leaked_kinds(F.col("spans")), ",").alias("kinds")).where("kinds <> ''")


def injection_scan(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-6: documents by kind of suspicious instruction."""
    i = read_table(spark, folder, "documents").select("doc_id", F.explode(privacy.injections(F.col("text"))).alias("x"))
    return i.groupBy("doc_id", "x.kind", "x.severity").agg(F.count(F.lit(1)).alias("n"))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-7."""
    d = read_table(spark, folder, "documents").withColumn("cleaned", privacy.quarantined(F.col("text")))
    return d.select("doc_id", F.length("cleaned").alias("n_chars"), F.regexp_count("cleaned", F.lit(r"\[REMOVED: suspected")).alias("n_removed"))


def spotlight(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-8."""
    return read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(privacy.spotlight(F.col("doc_id"), F.col("text")).cast("binary")).alias("wrapped_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        near_duplicate_first, unknown_chunk_ids, rule_scores_long, rule_pass_rate, keyword_categories, undefined_terms, score_agreement, adjudication_report, entity_extract, citation_verdicts,
        severity_matrix, quote_audit, evidence_quotes, audit_rows, confidence, review_first, quantity_map, conflict_signals, negation_conflicts, conflict_pairs, conflict_report, pii_spans, pii_masked, pii_leak_check,
        injection_scan, quarantined, spotlight,
    )
}

_R = r"""
    r AS (SELECT DISTINCT rtm_id, req_id, coalesce(statement, '') AS s, statement, coalesce(acceptance_criteria, '') AS c, acceptance_criteria, verification_method, origin, regulations,
            regexp_extract_all(coalesce(evidence_chunks, ''), 'D\d{2}#S[^#\s]+#c\d{2,}') AS cites, regexp_extract_all(coalesce(stakeholder_statements, ''), 'S-[A-Z]+-\d+') AS sources FROM rtm),
    u AS (SELECT DISTINCT rtm_id, id FROM (SELECT rtm_id, unnest(cites) AS id FROM r) WHERE id NOT IN (SELECT chunk_id FROM chunks))
"""
_DUP = """
    t AS (SELECT rtm_id, statement, list_distinct(regexp_extract_all(lower(statement), '[a-z]+')) AS w FROM r WHERE statement IS NOT NULL),
    d AS (SELECT a.rtm_id, min(b.rtm_id) AS other FROM t a JOIN t b ON a.statement <> b.statement AND len(a.w) > 0 AND len(b.w) >= 0.8 * len(a.w) AND len(a.w) >= 0.8 * len(b.w)
          WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY 1)
"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


_WEAK = _quote(r"\b(?:" + "|".join(map(_escape, V.WEAK_WORDS)) + r")\b")
_ANY = lambda words: _quote("|".join(map(_escape, words)))
_SCORES = f"""
    WITH {_R}, {_DUP}, x AS (
        SELECT r.*, lower(s) AS ls, lower(c) AS lc, len(regexp_extract_all(lower(s), '\\bshall\\b')) AS n, trim(regexp_replace(c, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') = '' AS e,
               d.other IS NOT NULL AS dup, r.rtm_id IN (SELECT rtm_id FROM u) AS bad FROM r LEFT JOIN d ON r.rtm_id = d.rtm_id
    ), l AS (
        SELECT rtm_id, unnest(['necessary', 'unambiguous', 'complete', 'singular', 'feasible', 'verifiable', 'conforming', 'traceable']) AS attribute, unnest([
            CASE WHEN dup THEN 0 ELSE 1 END,
            CASE WHEN regexp_matches(ls, {_WEAK}) THEN 0 ELSE 1 END,
            CASE WHEN e OR regexp_matches(ls || chr(10) || lc, {_ANY(V.PLACEHOLDERS)}) THEN 0 ELSE 1 END,
            CASE WHEN n <> 1 OR contains(s, ';') OR regexp_matches(s, {_quote(V.COMPOUND)}) THEN 0 ELSE 1 END,
            CASE WHEN regexp_matches(ls || chr(10) || lc, {_ANY(V.ABSOLUTES)}) THEN 0 ELSE 1 END,
            CASE WHEN e OR coalesce(verification_method, '') NOT IN ('Test', 'Demonstration', 'Inspection', 'Analysis') OR regexp_matches(lc, {_WEAK})
                   OR NOT (regexp_matches(c, '[0-9]') OR regexp_matches(lc, {_ANY(V.OBSERVABLE)})) THEN 0 ELSE 1 END,
            CASE WHEN n = 0 OR NOT regexp_matches(s, '(?i)^\\s*(the|a|an)\\s+\\w+') OR regexp_matches(ls, '\\b(because|in order to|so that|rationale)\\b') THEN 0 ELSE 1 END,
            CASE WHEN bad OR (len(cites) = 0 AND len(sources) = 0 AND coalesce(origin, '') <> 'control_gap') THEN 0 ELSE 1 END]) AS rule_score FROM x
    )
"""
_CATS = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(statement, '')), {_quote('|'.join(f'(?:{p})' for p in ps))}) THEN '{c}' END" for c, ps in V.CATEGORIES.items())
_CITE = f"""
    WITH {_R}, h AS (SELECT rtm_id, concat_ws(' ', statement, acceptance_criteria, regulations) AS t FROM r),
    e AS (
        SELECT DISTINCT rtm_id, 'cfr_citation' AS kind, unnest(list_transform(list_zip(regexp_extract_all(t, {_quote(V.CFR)}, 1), regexp_extract_all(t, {_quote(V.CFR)}, 2)), lambda p: p[1] || ' CFR ' || p[2])) AS entity FROM h
        UNION SELECT DISTINCT rtm_id, 'cfr_citation', '§ ' || unnest(regexp_extract_all(t, {_quote(V.SECTION)}, 1)) FROM h
        UNION SELECT DISTINCT rtm_id, 'standard', unnest(list_transform(list_zip(regexp_extract_all(t, {_quote(V.STANDARD)}, 1), regexp_extract_all(t, {_quote(V.STANDARD)}, 2)), lambda p: p[1] || ' ' || p[2])) FROM h
        UNION SELECT DISTINCT rtm_id, 'fhir_resource', unnest(regexp_extract_all(t, {_quote(V.CAMEL)}, 1)) FROM h
    ), l AS (SELECT *, CASE WHEN kind = 'cfr_citation' THEN lower(split_part(regexp_replace(entity, '^(§ |[0-9]+ CFR )', ''), '(', 1)) ELSE lower(entity) END AS lookup FROM e),
    n AS (SELECT DISTINCT lower(regexp_replace(translate(text, '§—–', '   '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM chunks WHERE text IS NOT NULL),
    p AS (SELECT lookup, EXISTS (SELECT 1 FROM n WHERE contains(n.t, lookup)) AS there FROM (SELECT DISTINCT lookup FROM l)),
    k AS (SELECT l.*, there, entity IN ({", ".join(map(_quote, V.RESOURCES))}) AS known FROM l JOIN p USING (lookup)),
    f AS (SELECT rtm_id, regexp_matches(t, '(?i)\\bFHIR\\b|\\bresource\\b') AS said FROM h), g AS (SELECT rtm_id FROM k WHERE kind = 'fhir_resource' AND known),
    v AS (SELECT k.rtm_id, kind, entity, CASE WHEN there THEN 'verified' WHEN kind = 'cfr_citation' AND split_part(lookup, '.', 1) IN ('430', '440', '450') THEN 'fabricated'
              WHEN kind = 'fhir_resource' AND NOT known THEN 'fabricated' ELSE 'unverifiable' END AS verdict
          FROM k JOIN f USING (rtm_id) WHERE kind <> 'fhir_resource' OR there OR known OR said OR rtm_id IN (SELECT rtm_id FROM g)),
    w AS (SELECT *, CASE verdict WHEN 'fabricated' THEN 'medium' WHEN 'unverifiable' THEN 'low' ELSE 'none' END AS severity FROM v)
"""
_AUDIT = _CITE + f""",
    pq AS (SELECT rtm_id, cites, regexp_extract(concat_ws(' ', statement, acceptance_criteria), {_quote(QUOTED)}, 1) AS quote FROM r),
    pn AS (SELECT rtm_id, cites, quote, regexp_replace(lower(quote), '[^0-9a-z]', '', 'g') AS q FROM pq WHERE quote <> ''), pb AS (SELECT DISTINCT chunk_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS b FROM chunks),
    pv AS (SELECT rtm_id, quote, CASE WHEN length(q) < 12 THEN 'unverifiable' WHEN EXISTS (SELECT 1 FROM pb WHERE list_contains(pn.cites, chunk_id) AND contains(b, q)) THEN 'verified' WHEN EXISTS (SELECT 1 FROM pb WHERE contains(b, q)) THEN 'misattributed' ELSE 'fabricated' END AS verdict FROM pn),
    al AS (SELECT rtm_id, kind AS entity_type, entity, verdict, severity FROM w
        UNION ALL SELECT rtm_id, 'evidence_quote', quote, verdict, CASE verdict WHEN 'fabricated' THEN 'medium' WHEN 'misattributed' THEN 'medium' WHEN 'unverifiable' THEN 'low' ELSE 'none' END FROM pv
        UNION ALL SELECT rtm_id, 'chunk_id', id, 'fabricated', 'medium' FROM u)
"""
_CONF = _AUDIT + """,
    s2 AS (SELECT DISTINCT * FROM validation_29148), q2 AS (SELECT req_id, CASE WHEN avg(llm_score) IS NULL THEN coalesce(avg(rule_score), 0) ELSE (coalesce(avg(rule_score), 0) + avg(llm_score)) / 2 END AS quality FROM s2 GROUP BY 1),
    o2 AS (SELECT DISTINCT unnest([req_a, req_b]) AS req_id FROM conflicts WHERE lower(trim(status)) = 'open'),
    a2 AS (SELECT rtm_id, bool_or(entity_type <> 'chunk_id' AND verdict IN ('fabricated', 'misattributed')) AS wrong, bool_or(entity_type = 'chunk_id') AS bad, bool_or(entity_type = 'evidence_quote' AND verdict = 'verified') AS quoted FROM al GROUP BY 1),
    x2 AS (SELECT r.rtm_id, q2.quality, r.req_id IN (SELECT req_id FROM o2 WHERE req_id IS NOT NULL) AS disputed, coalesce(wrong, false) AS wrong, coalesce(bad, false) AS bad,
            CASE WHEN coalesce(quoted, false) OR len(list_distinct(list_transform(sources, lambda z: split_part(z, '-', 2)))) >= 2 THEN 1.0 WHEN len(cites) > 0 OR len(sources) > 0 THEN 0.75 WHEN origin = 'control_gap' THEN 0.5 ELSE 0.0 END AS support
          FROM r LEFT JOIN q2 ON r.req_id = q2.req_id LEFT JOIN a2 ON r.rtm_id = a2.rtm_id),
    y2 AS (SELECT *, 0.5 * support::DOUBLE + 0.5 * coalesce(quality, 0) AS a FROM x2), z2 AS (SELECT *, CASE WHEN wrong OR bad THEN least(a, 0.3) ELSE a END AS b FROM y2), f2 AS (SELECT *, CASE WHEN disputed THEN least(b, 0.5) ELSE b END AS raw FROM z2),
    out AS (SELECT rtm_id, support::DOUBLE AS support, round_even(quality, 3) AS quality, round_even(raw, 3) AS confidence, raw < 0.7 OR support = 0 AS escalate,
                   array_to_string(list_filter([CASE WHEN wrong THEN 'fabricated or misattributed' END, CASE WHEN disputed THEN 'unresolved conflict' END, CASE WHEN bad THEN 'unknown citation' END], lambda t: t IS NOT NULL), '; ') AS reasons FROM f2)
"""
_UNIT = "map {" + ", ".join(f"{_quote(k)}: {_quote(v)}" for k, v in V.UNITS.items()) + "}"
_PAIRS = f"""
    WITH {_R}, w AS (SELECT rtm_id, statement, concat_ws(' ', statement, acceptance_criteria) AS t, list_distinct(list_transform(list_filter(sources, lambda z: len(string_split(z, '-')) > 2), lambda z: split_part(z, '-', 2))) AS who FROM r),
    g AS (SELECT *, coalesce(regexp_matches(statement, {_quote(V.NEGATION)}), false) AS negated, regexp_matches(t, {_quote(V.AUTOMATION)}) AS auto, regexp_matches(t, {_quote(V.REVIEW)}) AS checked FROM w),
    x AS (SELECT rtm_id, unnest(regexp_extract_all(t, {_quote(V.QUANTITY)}, 1))::DOUBLE AS n, lower(unnest(regexp_extract_all(t, {_quote(V.QUANTITY)}, 2))) AS u FROM g),
    e AS (SELECT rtm_id, coalesce({_UNIT}[u], u) AS u, list_sort(list(DISTINCT n)) AS n FROM x GROUP BY ALL),
    d AS (SELECT DISTINCT y.rtm_id AS a, z.rtm_id AS b FROM e y JOIN e z ON y.u = z.u AND y.rtm_id < z.rtm_id AND y.n <> z.n),
    h AS (SELECT rtm_id, unnest(regexp_extract_all(lower(coalesce(statement, '')), '[a-z]{{3,}}')) AS w FROM g),
    b AS (SELECT rtm_id, CAST(('0x' || substr(md5(w), 31, 2))::INT AS INT) AS b, count(*)::DOUBLE AS n FROM h GROUP BY ALL), m AS (SELECT rtm_id, sqrt(sum(n * n)) AS m FROM b GROUP BY 1),
    s AS (SELECT y.rtm_id AS a, z.rtm_id AS b, round(sum(y.n * z.n) / (any_value(my.m) * any_value(mz.m)), 6) AS score FROM b y JOIN b z ON y.b = z.b AND y.rtm_id < z.rtm_id JOIN m my ON my.rtm_id = y.rtm_id JOIN m mz ON mz.rtm_id = z.rtm_id GROUP BY 1, 2),
    j AS (SELECT s.a, s.b, score, d.a IS NOT NULL OR ga.negated <> gb.negated OR (ga.auto AND gb.checked) OR (gb.auto AND ga.checked) AS signalled, score >= 0.86 AS duplicate,
                 len(ga.who) > 0 AND len(gb.who) > 0 AND len(list_intersect(ga.who, gb.who)) = 0 AS apart
          FROM s JOIN g ga ON ga.rtm_id = s.a JOIN g gb ON gb.rtm_id = s.b LEFT JOIN d ON d.a = s.a AND d.b = s.b WHERE score >= 0.55),
    k AS (SELECT * FROM j WHERE signalled OR duplicate OR apart)
"""
_URL = r"https?://[^\s)>\]]+"
_KNOWN_URL = r"(?i)^https?://[\w.-]*(?:hl7\.org|ecfr\.gov|hhs\.gov|healthit\.gov|usdoj\.gov|federalregister\.gov|nist\.gov)\b"
_SCAN = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, '{level}' AS severity, unnest(regexp_extract_all(text, {_quote(p)})) AS m FROM documents" if kind != "unknown_url" else
    f"SELECT doc_id, '{kind}', '{level}', unnest(list_filter(regexp_extract_all(text, {_quote('(?i)' + _URL)}), lambda u: NOT regexp_matches(u, {_quote(_KNOWN_URL)}))) FROM documents"
    for p, kind, level in V.INJECTIONS
)
SQL = {
    "injection_scan": f"SELECT doc_id, kind, severity, count(*) AS n FROM ({_SCAN}) WHERE m IS NOT NULL GROUP BY ALL",
    "undefined_terms": f"""
        WITH t AS (SELECT DISTINCT chunk_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[\\w-]+'))) AS term FROM chunks)
        SELECT chunk_id, term FROM t WHERE regexp_full_match(term, '[A-Z][A-Z0-9]+') AND upper(term) NOT IN ({", ".join(_quote(k.upper()) for k in V.GLOSSARY)})
    """,
    "conflict_signals": f"""
        WITH n AS (SELECT req_id, arg_max(struct_pack(s := statement, c := acceptance_criteria), struct_pack(v := version, i := rtm_id)) AS x FROM rtm GROUP BY 1), c AS (SELECT DISTINCT conflict_id, req_a, req_b FROM conflicts),
        m AS (SELECT conflict_id, a.x.s AS sa, b.x.s AS sb, concat_ws(' ', a.x.s, a.x.c) AS ta, concat_ws(' ', b.x.s, b.x.c) AS tb FROM c JOIN n a ON a.req_id = req_a JOIN n b ON b.req_id = req_b),
        q AS (SELECT conflict_id, 'a' AS side, unnest(regexp_extract_all(ta, {_quote(V.QUANTITY)}, 1))::DOUBLE AS n, lower(unnest(regexp_extract_all(ta, {_quote(V.QUANTITY)}, 2))) AS u FROM m
              UNION ALL SELECT conflict_id, 'b', unnest(regexp_extract_all(tb, {_quote(V.QUANTITY)}, 1))::DOUBLE, lower(unnest(regexp_extract_all(tb, {_quote(V.QUANTITY)}, 2))) FROM m),
        e AS (SELECT conflict_id, side, coalesce({_UNIT}[u], u) AS u, list_sort(list(DISTINCT n)) AS n FROM q GROUP BY ALL),
        d AS (SELECT y.conflict_id, list_sort(list('different values in ' || y.u)) AS l FROM e y JOIN e z ON y.conflict_id = z.conflict_id AND y.side = 'a' AND z.side = 'b' AND y.u = z.u AND y.n <> z.n GROUP BY 1)
        SELECT conflict_id, list_concat(coalesce(l, []), list_filter([CASE WHEN coalesce(regexp_matches(sa, {_quote(V.NEGATION)}), false) <> coalesce(regexp_matches(sb, {_quote(V.NEGATION)}), false) THEN 'negation on one side only' END,
            CASE WHEN (regexp_matches(ta, {_quote(V.AUTOMATION)}) AND regexp_matches(tb, {_quote(V.REVIEW)})) OR (regexp_matches(tb, {_quote(V.AUTOMATION)}) AND regexp_matches(ta, {_quote(V.REVIEW)})) THEN 'automation against review' END], lambda x: x IS NOT NULL)) AS found
        FROM m LEFT JOIN d USING (conflict_id)
    """,
    "near_duplicate_first": f"WITH {_R}, {_DUP} SELECT rtm_id, other FROM d",
    "unknown_chunk_ids": f"WITH {_R} SELECT rtm_id, id FROM u",
    "rule_scores_long": _SCORES + "SELECT rtm_id, attribute, rule_score FROM l",
    "rule_pass_rate": _SCORES + "SELECT attribute, count(*) AS n, sum(rule_score) AS passed, round_even(avg(rule_score), 3) AS pass_rate FROM l GROUP BY 1",
    "keyword_categories": f"""
        WITH {_R}, k AS (SELECT rtm_id, list_filter([{_CATS}], lambda x: x IS NOT NULL) AS c FROM r), m AS (SELECT rtm_id, CASE WHEN len(c) = 0 THEN ['functional'] ELSE c END AS c FROM k)
        SELECT rtm_id, array_to_string(c, ',') AS categories, CASE WHEN list_contains(c, 'functional') THEN 'FR' ELSE 'NFR' END AS type, c[1] AS primary_category FROM m
    """,
    "score_agreement": """
        SELECT DISTINCT score_id, CASE WHEN llm_score IS NULL THEN 'no_llm_score' WHEN rule_score = llm_score THEN 'agree' ELSE 'disagree' END AS agreed FROM validation_29148 WHERE rule_score IS NOT NULL
    """,
    "adjudication_report": f"""
        SELECT score_id, req_id, attribute, rule_score, llm_score FROM (SELECT DISTINCT * FROM validation_29148 WHERE rule_score <> llm_score)
        ORDER BY list_position([{", ".join(map(_quote, V.ATTRIBUTES))}], attribute), req_id, score_id LIMIT 12
    """,
    "entity_extract": f"""
        WITH e AS (
            SELECT doc_id, 'cfr_citation' AS kind, lower(unnest(list_transform(list_zip(regexp_extract_all(text, {_quote(V.CFR)}, 1), regexp_extract_all(text, {_quote(V.CFR)}, 2)), lambda p: p[1] || ' CFR ' || p[2]))) AS x FROM documents
            UNION ALL SELECT doc_id, 'cfr_citation', lower('§ ' || unnest(regexp_extract_all(text, {_quote(V.SECTION)}, 1))) FROM documents
            UNION ALL SELECT doc_id, 'standard', lower(unnest(list_transform(list_zip(regexp_extract_all(text, {_quote(V.STANDARD)}, 1), regexp_extract_all(text, {_quote(V.STANDARD)}, 2)), lambda p: p[1] || ' ' || p[2]))) FROM documents
            UNION ALL SELECT doc_id, 'fhir_resource', unnest(regexp_extract_all(text, {_quote(V.CAMEL)}, 1)) FROM documents)
        SELECT doc_id, kind, count(DISTINCT x) AS n FROM e GROUP BY ALL
    """,
    "citation_verdicts": _CITE + "SELECT rtm_id, kind, entity, verdict, severity FROM w",
    "severity_matrix": _CITE + "SELECT kind, verdict, severity, count(*) AS n FROM w GROUP BY ALL",
    "quote_audit": """
        WITH q AS (SELECT DISTINCT hit_id, chunk_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS q FROM hits WHERE length(trim(text, ' ')) > 0),
        c AS (SELECT DISTINCT chunk_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS b FROM chunks)
        SELECT hit_id, CASE WHEN length(q) < 12 THEN 'unverifiable' WHEN EXISTS (SELECT 1 FROM c WHERE c.chunk_id = q.chunk_id AND contains(b, q)) THEN 'verified'
            WHEN EXISTS (SELECT 1 FROM c WHERE contains(b, q)) THEN 'misattributed' ELSE 'fabricated' END AS verdict FROM q
    """,
    "evidence_quotes": _AUDIT + "SELECT rtm_id, verdict FROM pv",
    "audit_rows": _AUDIT + "SELECT * FROM al",
    "confidence": _CONF + "SELECT * FROM out",
    "review_first": _CONF + "SELECT rtm_id, confidence, escalate FROM out",
    "quantity_map": f"""
        WITH {_R}, t AS (SELECT rtm_id, concat_ws(' ', statement, acceptance_criteria) AS t FROM r),
        p AS (SELECT rtm_id, unnest(regexp_extract_all(t, {_quote(V.QUANTITY)}, 1))::DOUBLE AS n, lower(unnest(regexp_extract_all(t, {_quote(V.QUANTITY)}, 2))) AS u FROM t)
        SELECT rtm_id, coalesce({_UNIT}[u], u) AS unit, count(DISTINCT n) AS n_values, max(n) AS largest FROM p GROUP BY ALL
    """,
    "negation_conflicts": f"""
        WITH n AS (SELECT req_id, arg_max(struct_pack(s := statement), struct_pack(v := version, i := rtm_id)).s AS s FROM rtm GROUP BY 1)
        SELECT DISTINCT conflict_id FROM conflicts c JOIN n a ON c.req_a = a.req_id JOIN n b ON c.req_b = b.req_id
        WHERE coalesce(regexp_matches(a.s, {_quote(V.NEGATION)}), false) <> coalesce(regexp_matches(b.s, {_quote(V.NEGATION)}), false)
    """,
    "conflict_pairs": _PAIRS + "SELECT * FROM k ORDER BY signalled DESC, duplicate DESC, score DESC, a, b LIMIT 24",
    "conflict_report": """
        SELECT conflict_id, similarity FROM (SELECT DISTINCT * FROM conflicts) ORDER BY coalesce(len(signals), 0) > 0 DESC, similarity >= 0.86 DESC NULLS LAST, similarity DESC NULLS LAST, conflict_id LIMIT 24
    """,
    "spotlight": """
        WITH m AS (SELECT doc_id, text, substr(sha256(doc_id || chr(10) || text), 1, 10) AS m FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5('<<UNTRUSTED source=' || doc_id || ' id=' || m || '>>' || chr(10) || text || chr(10) || '<<END UNTRUSTED id=' || m || '>>') AS wrapped_md5 FROM m
    """,
}
