"""Queries on registers, evaluation, decisions, logs and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import evaluation as ev
from docmill.operators import metrics, quality, registers, state
from docmill.plans import decision
from docmill.plans.audits import chunks, requirements
from docmill.session import half_even, read_table


def _once(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return read_table(spark, folder, name).dropDuplicates([key])


BANDS = [(0.8, "high"), (0.6, "medium"), (0.4, "low")]


def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """RSK-1 as a general banding, here of retrieval scores."""
    h = _once(spark, folder, "hits", "hit_id").select(registers.band(F.col("score"), BANDS, "none").alias("band"))
    return h.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def worst_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-9, RSK-2: each requirement's row of highest similarity."""
    c = _once(spark, folder, "compliance", "row_id").where("req_id <> ''")
    return registers.worst(c, "req_id", F.col("similarity"), ["row_id"]).select("req_id", "row_id", "similarity")


def control_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """CMP-4, JOIN-9: chunks that no compliance row cites."""
    cited = read_table(spark, folder, "compliance").select(F.trim("evidence_chunk_id").alias("chunk_id")).where("chunk_id <> ''")
    return registers.uncovered(chunks(spark, folder), cited, "chunk_id").select("chunk_id")


def control_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-4, JOIN-10: share of each document's chunks that were ever retrieved."""
    return registers.coverage(chunks(spark, folder), read_table(spark, folder, "hits"), "doc_id", "chunk_id")


def section_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-11: cited chunks by document and section, both parsed from the id."""
    ids = requirements(spark, folder).select("rtm_id", F.explode("cites").alias("id"))
    p = F.split("id", "#")
    return ids.select(p[0].alias("doc_id"), F.expr("substr(split(id, '#')[1], 2)").alias("section"), "rtm_id").groupBy("doc_id", "section").agg(F.countDistinct("rtm_id").alias("n_rows"))


def rolled_up_controls(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-11, CMP-3: controls and citations of each requirement."""
    r = registers.rolled_up(_once(spark, folder, "compliance", "row_id").where("req_id <> ''"), ["req_id"], ["control_id", "citation"])
    return r.select("req_id", F.array_join("control_id", ";").alias("controls"), F.array_join("citation", ";").alias("citations"))


def rtm_links(spark: SparkSession, folder: str) -> DataFrame:
    """RTM-1, JOIN-5: documents and sections behind each requirement."""
    r = requirements(spark, folder)
    out = registers.exploded_links(r, "rtm_id", F.col("cites"), chunks(spark, folder), "chunk_id", ["doc_id", "section"])
    return out.select("rtm_id", F.array_join("doc_id", ";").alias("documents"), F.array_join("section", ";").alias("sections"))


RELATIONS = ["satisfies", "partially", "GAP"]


def traceability_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """TRC-1, AGG-6: requirement by relation, D where it is mapped to a chunk and I where it is not; `other` has all further relations and none."""
    return all_relations(_once(spark, folder, "compliance", "row_id"))


def traceability_documents(spark: SparkSession, folder: str) -> DataFrame:
    """TRC-1: row of rtm by document, in long form: D where it cites a chunk of it, I where it is derived."""
    r = requirements(spark, folder).select("rtm_id", F.when(F.coalesce(F.col("origin") == "control_gap", F.lit(False)), "I").otherwise("D").alias("mark"), F.explode("cites").alias("c"))
    return r.select("rtm_id", F.substring_index("c", "#", 1).alias("doc_id"), "mark").distinct()


def all_relations(rows: DataFrame) -> DataFrame:
    known = [*RELATIONS, "supports"]
    name = F.trim("relation")
    c = rows.withColumn("relation", F.when(name.isin(known), name).otherwise("other"))
    return registers.pivot_marks(c, "req_id", "relation", [*known, "other"], F.when(F.trim("evidence_chunk_id") != "", "D").otherwise("I"))


def open_issues(spark: SparkSession, folder: str) -> DataFrame:
    """SET-1, SET-2: issues of several registers."""
    f = _once(spark, folder, "findings", "row_id").where("not resolved")
    c = _once(spark, folder, "conflicts", "conflict_id").where("lower(trim(status)) = 'open'")
    g = _once(spark, folder, "compliance", "row_id").where("evidence_chunk_id is null")
    return registers.union_issues([("finding", f, F.col("row_id"), F.col("kind")), ("conflict", c, F.col("conflict_id"), F.col("relation")), ("gap", g, F.col("row_id"), F.col("control_id"))])


def approval_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """APR-1, SET-4: items of two registers for each role that must see them."""
    f = _once(spark, folder, "findings", "row_id").where("not resolved")
    c = _once(spark, folder, "conflicts", "conflict_id")
    parts = [
        (f, "finding", F.col("row_id"), ["owner"], F.lit("normal")),
        (c, "conflict", F.col("conflict_id"), ["owner", "officer"], F.when(F.col("similarity") >= 0.86, "high").otherwise("normal")),
    ]
    return registers.fan_out(parts).select("fan_id", "item_type", "item_id", "role", "priority")


def routing(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-15, CLR-1: the document of the first cited chunk that exists, else none."""
    return registers.routed(requirements(spark, folder), "rtm_id", F.col("cites"), chunks(spark, folder), "chunk_id", "doc_id", "none")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """LIM-2: hits of each query by sixes."""
    h = registers.batched(_once(spark, folder, "hits", "hit_id"), "query_id", ["hit_id"], 6)
    return h.groupBy("query_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("hit_id").alias("first_hit"))


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-15, EVL-2: precision, recall and F1 of each model's labels against the rule's."""
    v = _once(spark, folder, "validation_29148", "score_id").where("llm_score is not null and rule_score is not null")
    g = v.groupBy("llm_model").agg(F.count_if((F.col("llm_score") == 1) & (F.col("rule_score") == 1)).alias("tp"), F.count_if(F.col("llm_score") == 1).alias("found"), F.count_if(F.col("rule_score") == 1).alias("wanted"))
    return ev.scores(g, "tp", "found", "wanted")


def category_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-16: mean Jaccard similarity of the categories of statement and criteria, by origin."""
    r = requirements(spark, folder).withColumn("j", ev.overlap(quality.categories(F.col("statement")), quality.categories(F.col("acceptance_criteria"))))
    return r.groupBy("origin").agg(F.bround(F.avg("j"), 6).alias("mean_overlap"), F.count("j").alias("n"))


def usability_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-17: ten answers made of each order's key, as a test of the score's arithmetic."""
    answers = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.pmod(F.col("o_orderkey") * i, F.lit(5)) + 1).cast("int"))
    return read_table(spark, folder, "orders").select("o_orderkey", ev.usability(answers).alias("score"))


def pair_recall(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-3, JOIN-12: recorded conflicts whose two sides cite the same document, in either orientation."""
    c = _once(spark, folder, "conflicts", "conflict_id")
    r = read_table(spark, folder, "rtm").select("req_id", F.explode(F.regexp_extract_all(F.coalesce("evidence_chunks", F.lit("")), F.lit(r"D\d{2}"), F.lit(0))).alias("doc")).distinct()
    a = c.join(r.withColumnRenamed("req_id", "req_a"), "req_a")
    same = a.join(r.withColumnRenamed("req_id", "req_b"), ["req_b", "doc"]).select(F.col("req_b").alias("req_a"), F.col("req_a").alias("req_b"))
    return ev.either_way(same, c, "req_a", "req_b")


def evidence_match(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-1, JOIN-13: one-to-one pairs of query and chunk by falling score from 0.5."""
    h = _once(spark, folder, "hits", "hit_id").where("score is not null")
    best = h.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ev.greedy_match(best, "query_id", "chunk_id", "score", 0.5)


def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-6, EVL-5: mean rule score, attribute by rule set."""
    v = _once(spark, folder, "validation_29148", "score_id").groupBy("attribute", "rule_set").agg(half_even(F.avg("rule_score")).alias("m"))
    return ev.wide(v, ["attribute"], "rule_set", ["ruleset-1", "ruleset-2", "ruleset-3"], "m").withColumnsRenamed({f"ruleset-{k}": f"set_{k}" for k in (1, 2, 3)})


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-2."""
    return metrics.value_counts(_once(spark, folder, "findings", "row_id"), ["kind", "source", "resolved"])


def label_shares(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1, AGG-3."""
    v = _once(spark, folder, "validation_29148", "score_id")
    return metrics.shares(v, ["attribute"], {"agree": F.col("rule_score") == F.col("llm_score"), "met": F.col("rule_score") == 1})


def modal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-4."""
    return metrics.modal_share(_once(spark, folder, "validation_29148", "score_id"), ["req_id", "attribute"], "llm_score")


def label_flips(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-5."""
    return metrics.flips(_once(spark, folder, "validation_29148", "score_id"), ["req_id", "attribute"], "llm_score")


def repeated_calls(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-13."""
    return metrics.repeats(_once(spark, folder, "validation_29148", "score_id"), ["req_id", "attribute", "rule_set"], "rule_score")


def event_cost(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-12, AGG-19, MET-7."""
    return metrics.cost(read_table(spark, folder, "events"), ["event_type"], "value")


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-12 over a large fact table: a filter that reaches the scan, and sums that combine before the shuffle."""
    rows = read_table(spark, folder, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    g = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("l_returnflag", "l_linestatus", F.round("q", 2).alias("quantity"), F.round("r", 2).alias("revenue"), "n")


def last_event(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-6, JOIN-17: each user's last event."""
    return state.last_write(read_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


def findings_merge(spark: SparkSession, folder: str) -> DataFrame:
    """STA-3: findings of round 1 against those of round 2."""
    f = _once(spark, folder, "findings", "row_id").where("req_id <> ''")
    return state.merge_findings(f.where("round_no <= 1"), f.where("round_no = 2"), read_table(spark, folder, "rtm").where("retired_at is null"), ["req_id", "kind"], "req_id", 2)


def decision_fold(spark: SparkSession, folder: str) -> DataFrame:
    """STA-5, STA-6: status of each item after the log of decisions."""
    q = _once(spark, folder, "review_queue", "row_id").withColumn("decision", F.lower(F.trim("decision")))
    items = q.select("approval_id").where("approval_id is not null").distinct()
    return state.fold_decisions(items, q, "approval_id", [F.col("decided_at"), F.col("row_id")], {"accept": "approved", "reject": "rejected", "modify": "modified", "regenerate": "requeued"})


def id_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """STA-2, AGG-10, WIN-1: new ids for all orders, by kind and key, after the largest numbers taken."""
    o = read_table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "FR").otherwise("NFR").alias("kind"))
    return state.assign_ids(o, "kind", ["o_orderkey"], read_table(spark, folder, "rtm"), "req_id", "ERX").select("o_orderkey", "new_id")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """STA-9: how often each user's kind of event changed."""
    v = state.running_state(read_table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")
    return v.groupBy("user_id").agg(F.max("version").alias("n_changes"), F.count(F.lit(1)).alias("n_events"))


PROFILES = {
    "planned": {"stability": (1, 1.0), "size": (1, 1.0), "value": (1, 1.0)},
    "iterative": {"stability": (-1, 1.0), "size": (-1, 1.0)},
    "hybrid": {"size": (1, 2.0), "value": (-1, 1.0)},
}
RULES = {"R-PL": {"all": ["stability >= 4", "size >= 3"]}, "R-IT": {"any": ["stability <= 2", {"all": ["size < 2", "value < 3"]}]}, "R-NO": "missing > 1"}
FAMILIES = [(r"spec|srs", "specification"), (r"policy|regulation", "rule"), (r"mail|interview|note", "message"), (r"report|finding", "report")]


def _factors(spark: SparkSession, folder: str) -> DataFrame:
    """Three factors from 1 to 5 of each customer with orders."""
    o = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("p"), F.max("o_totalprice").alias("t"))
    return o.select(
        F.col("o_custkey").alias("custkey"),
        F.create_map(
            F.lit("stability"), (F.lit(6) - F.col("p")).cast("double"), F.lit("size"), F.least(F.lit(5), F.col("n")).cast("double"), F.lit("value"), F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.ceil(F.col("t") / 100000).cast("double")))
        ).alias("factors"),
    )


def mcda_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-1, AGG-8, SRT-4."""
    return decision.suitability(_factors(spark, folder), "custkey", "factors", PROFILES)


def fired_rules(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-2, PRJ-12."""
    return decision.fired(_factors(spark, folder), "custkey", "factors", RULES)


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-3."""
    f = _factors(spark, folder)
    cautions = f.where(F.col("factors")["size"] >= 5)
    return decision.recommended(mcda_ranking(spark, folder), "custkey", fired_rules(spark, folder), cautions)


def factor_medians(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-7."""
    return decision.medians(read_table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


def contested_items(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-4."""
    h = _once(spark, folder, "hits", "hit_id").where("score is not null")
    return decision.contested(h, "query_id", "doc_id", "score", 0.2)


def canonical_types(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-13."""
    return read_table(spark, folder, "documents").select("doc_id", decision.canonical(F.col("doc_type"), FAMILIES).alias("family"))


def primary_per_kind(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-6: the first hit of each document in each query."""
    return decision.first_of_kind(_once(spark, folder, "hits", "hit_id"), "query_id", "doc_id", ["rank_no", "hit_id"]).select("query_id", "doc_id", "hit_id")


def parsed_values(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-4 to PRJ-8: coercions of unevenly written columns."""
    r = read_table(spark, folder, "rtm").dropDuplicates(["rtm_id"])
    return r.select(
        "rtm_id", F.size(T.listed(F.col("stakeholder_statements"))).alias("n_listed"), T.one_of(F.lower(F.trim("approval_status")), ["approved", "rejected", "pending"], "pending").alias("status"),
        T.within(F.col("version"), 1, 5).alias("version"), T.truthy(F.col("origin")).alias("flag"),
    )


def public_view(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-1, PRJ-2: rows not withdrawn, without hidden columns."""
    return read_table(spark, folder, "rtm").dropDuplicates(["rtm_id"]).where("retired_at is null").select("rtm_id", "req_id", "version", "statement")


QUERIES = {
    f.__name__: f
    for f in (
        score_bands, worst_per_key, control_gaps, control_coverage, section_coverage, rolled_up_controls, rtm_links, traceability_pivot, traceability_documents, open_issues, approval_fanout, routing, batches, label_scores,
        category_overlap, usability_scores, pair_recall, evidence_match, metrics_wide, value_counts, label_shares, modal_labels, label_flips, repeated_calls, event_cost, revenue, last_event,
        findings_merge, decision_fold, id_assignment, versions, mcda_ranking, fired_rules, recommendations, factor_medians, contested_items, canonical_types, primary_per_kind, parsed_values, public_view,
    )
}

_RTM = r"""
    r AS (SELECT DISTINCT rtm_id, statement, acceptance_criteria, origin, regexp_extract_all(coalesce(evidence_chunks, ''), 'D\d{2}#S[^#\s]+#c\d{2,}') AS cites FROM rtm),
    c AS (SELECT DISTINCT chunk_id, doc_id, section FROM chunks)
"""
_CATS = {
    x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({x}, '')), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{c}' END" for c, ps in V.CATEGORIES.items()) + "], lambda x: x IS NOT NULL)"
    for x in ("statement", "acceptance_criteria")
}
_FACTORS = """
    WITH o AS (SELECT o_custkey AS custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS p, max(o_totalprice) AS t FROM orders GROUP BY 1),
    f AS (SELECT custkey, (6 - p)::DOUBLE AS stability, least(5, n)::DOUBLE AS size, least(5, greatest(1, ceil(t / 100000)))::DOUBLE AS value FROM o),
    s AS (SELECT custkey, unnest([{'profile': 'planned', 'k': 0, 'pct': round_even(100 * ((stability - 1) / 4 + (size - 1) / 4 + (value - 1) / 4) / 3, 1)},
        {'profile': 'iterative', 'k': 1, 'pct': round_even(100 * ((5 - stability) / 4 + (5 - size) / 4) / 2, 1)}, {'profile': 'hybrid', 'k': 2, 'pct': round_even(100 * ((size - 1) / 4 * 2 + (5 - value) / 4) / 3, 1)}]) AS x FROM f),
    m AS (SELECT custkey, x.profile AS profile, x.pct AS pct, row_number() OVER (PARTITION BY custkey ORDER BY x.pct DESC, x.k) AS place FROM s),
    g AS (SELECT custkey, unnest(list_filter([CASE WHEN stability >= 4 AND size >= 3 THEN 'R-PL' END, CASE WHEN stability <= 2 OR (size < 2 AND value < 3) THEN 'R-IT' END], lambda r: r IS NOT NULL)) AS rule_id FROM f)
"""
_V = "(SELECT DISTINCT * FROM validation_29148)"
SQL = {
    "score_bands": "SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' WHEN score IS NOT NULL THEN 'none' END AS band, count(*) AS n FROM (SELECT DISTINCT * FROM hits) GROUP BY 1",
    "worst_per_key": "SELECT req_id, row_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY similarity DESC NULLS LAST, row_id) AS k FROM (SELECT DISTINCT * FROM compliance) WHERE req_id <> '') WHERE k = 1",
    "control_gaps": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT trim(evidence_chunk_id, ' ') FROM compliance WHERE evidence_chunk_id IS NOT NULL)",
    "control_coverage": """
        WITH c AS (SELECT DISTINCT doc_id, chunk_id FROM chunks), h AS (SELECT DISTINCT doc_id, chunk_id, 1 AS t FROM hits)
        SELECT doc_id, count(*) AS n_expected, count(t) AS n_covered, round_even(count(t)::DOUBLE / count(*), 3) AS coverage FROM c LEFT JOIN h USING (doc_id, chunk_id) GROUP BY 1
    """,
    "section_coverage": f"WITH {_RTM}, i AS (SELECT rtm_id, unnest(cites) AS id FROM r) SELECT split_part(id, '#', 1) AS doc_id, substr(split_part(id, '#', 2), 2) AS section, count(DISTINCT rtm_id) AS n_rows FROM i GROUP BY 1, 2",
    "rolled_up_controls": """
        SELECT req_id, coalesce(array_to_string(list_sort(list(DISTINCT control_id) FILTER (control_id IS NOT NULL)), ';'), '') AS controls, coalesce(array_to_string(list_sort(list(DISTINCT citation) FILTER (citation IS NOT NULL)), ';'), '') AS citations
        FROM compliance WHERE req_id <> '' GROUP BY 1
    """,
    "rtm_links": f"""
        WITH {_RTM}, e AS (SELECT rtm_id, unnest(CASE WHEN len(cites) = 0 THEN [NULL] ELSE cites END) AS chunk_id FROM r)
        SELECT rtm_id, coalesce(array_to_string(list_sort(list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL)), ';'), '') AS documents, coalesce(array_to_string(list_sort(list(DISTINCT section) FILTER (section IS NOT NULL)), ';'), '') AS sections
        FROM e LEFT JOIN c USING (chunk_id) GROUP BY 1
    """,
    "traceability_pivot": """
        WITH c AS (SELECT DISTINCT req_id, trim(relation, ' ') AS relation, CASE WHEN trim(evidence_chunk_id, ' ') <> '' THEN 'D' ELSE 'I' END AS m FROM compliance)
        SELECT req_id, coalesce(min(m) FILTER (relation = 'satisfies'), '') AS satisfies, coalesce(min(m) FILTER (relation = 'partially'), '') AS partially, coalesce(min(m) FILTER (relation = 'GAP'), '') AS "GAP",
            coalesce(min(m) FILTER (relation = 'supports'), '') AS supports, coalesce(min(m) FILTER (relation IS NULL OR relation NOT IN ('satisfies', 'partially', 'GAP', 'supports')), '') AS other FROM c GROUP BY 1
    """,
    "traceability_documents": f"""
        WITH {_RTM}, e AS (SELECT rtm_id, CASE WHEN origin = 'control_gap' THEN 'I' ELSE 'D' END AS mark, unnest(cites) AS c FROM r) SELECT DISTINCT rtm_id, split_part(c, '#', 1) AS doc_id, mark FROM e
    """,
    "open_issues": """
        SELECT 'finding' AS kind, row_id::VARCHAR AS ref, kind AS detail FROM (SELECT DISTINCT * FROM findings WHERE NOT resolved)
        UNION ALL SELECT 'conflict', conflict_id, relation FROM (SELECT DISTINCT * FROM conflicts WHERE lower(trim(status, ' ')) = 'open')
        UNION ALL SELECT 'gap', row_id::VARCHAR, control_id FROM (SELECT DISTINCT * FROM compliance WHERE evidence_chunk_id IS NULL)
    """,
    "approval_fanout": """
        SELECT 'APR-0-' || row_id || '-0' AS fan_id, 'finding' AS item_type, row_id::VARCHAR AS item_id, 'owner' AS role, 'normal' AS priority FROM (SELECT DISTINCT * FROM findings WHERE NOT resolved)
        UNION ALL SELECT 'APR-1-' || conflict_id || '-' || k, 'conflict', conflict_id, CASE k WHEN 0 THEN 'owner' ELSE 'officer' END, CASE WHEN similarity >= 0.86 THEN 'high' ELSE 'normal' END
        FROM (SELECT DISTINCT * FROM conflicts), range(2) t(k)
    """,
    "routing": f"""
        WITH {_RTM}, e AS (SELECT rtm_id, unnest(cites) AS chunk_id, unnest(range(len(cites))) AS p FROM r), f AS (SELECT rtm_id, arg_min(doc_id, p) AS o FROM e JOIN c USING (chunk_id) GROUP BY 1)
        SELECT rtm_id, coalesce(o, 'none') AS owner FROM r LEFT JOIN f USING (rtm_id)
    """,
    "batches": """
        WITH h AS (SELECT query_id, hit_id, (row_number() OVER (PARTITION BY query_id ORDER BY hit_id) - 1) // 6 AS batch_no FROM (SELECT DISTINCT * FROM hits))
        SELECT query_id, batch_no, count(*) AS n, min(hit_id) AS first_hit FROM h GROUP BY 1, 2
    """,
    "label_scores": f"""
        WITH g AS (SELECT llm_model, count(*) FILTER (llm_score = 1 AND rule_score = 1) AS tp, count(*) FILTER (llm_score = 1) AS found, count(*) FILTER (rule_score = 1) AS wanted FROM {_V} WHERE llm_score IS NOT NULL AND rule_score IS NOT NULL GROUP BY 1),
        s AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS p, CASE WHEN wanted > 0 THEN tp / wanted ELSE 0 END AS r FROM g)
        SELECT llm_model, tp, found, wanted, round_even(p, 3) AS precision, round_even(r, 3) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM s
    """,
    "category_overlap": f"""
        WITH {_RTM}, x AS (SELECT origin, {_CATS["statement"]} AS a0, {_CATS["acceptance_criteria"]} AS b0 FROM r), y AS (SELECT origin, CASE WHEN len(a0) = 0 THEN ['functional'] ELSE a0 END AS a, CASE WHEN len(b0) = 0 THEN ['functional'] ELSE b0 END AS b FROM x)
        SELECT origin, round_even(avg(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))), 6) AS mean_overlap, count(*) AS n FROM y GROUP BY 1
    """,
    "usability_scores": "SELECT o_orderkey, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN (o_orderkey * i) % 5 ELSE 4 - (o_orderkey * i) % 5 END)) * 2.5::DOUBLE AS score FROM orders",
    "pair_recall": r"""
        WITH r AS (SELECT DISTINCT req_id, unnest(regexp_extract_all(coalesce(evidence_chunks, ''), 'D\d{2}')) AS doc FROM rtm), c AS (SELECT DISTINCT req_a, req_b FROM conflicts)
        SELECT DISTINCT least(req_a, req_b) AS req_a, greatest(req_a, req_b) AS req_b FROM c JOIN r a ON a.req_id = req_a JOIN r b ON b.req_id = req_b AND a.doc = b.doc WHERE req_a <> req_b
    """,
    "metrics_wide": f"""
        WITH v AS (SELECT attribute, rule_set, round_even(avg(rule_score), 3) AS m FROM {_V} GROUP BY 1, 2)
        SELECT attribute, max(m) FILTER (rule_set = 'ruleset-1') AS set_1, max(m) FILTER (rule_set = 'ruleset-2') AS set_2, max(m) FILTER (rule_set = 'ruleset-3') AS set_3 FROM v GROUP BY 1
    """,
    "value_counts": """
        WITH f AS (SELECT DISTINCT * FROM findings) SELECT 'kind' AS name, kind AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'resolved', resolved::VARCHAR, count(*) FROM f GROUP BY 2
    """,
    "label_shares": f"""
        WITH g AS (SELECT attribute, count(*) AS n, count(*) FILTER (rule_score = llm_score) AS n_agree, count(*) FILTER (rule_score = 1) AS n_met FROM {_V} GROUP BY 1)
        SELECT *, round_even(n_agree / n, 3) AS share_agree, round_even(n_met / n, 3) AS share_met FROM g
    """,
    "modal_labels": f"""
        WITH c AS (SELECT req_id, attribute, llm_score, count(*) AS c FROM {_V} WHERE llm_score IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY req_id, attribute ORDER BY c DESC, llm_score) AS k FROM c)
        SELECT req_id, attribute, max(llm_score) FILTER (k = 1) AS mode, sum(c) AS n, count(*) AS n_values, round_even(max(c) / sum(c), 3) AS share FROM r GROUP BY 1, 2
    """,
    "label_flips": f"""
        WITH g AS (SELECT req_id, attribute, count(DISTINCT llm_score) AS d FROM {_V} WHERE llm_score IS NOT NULL GROUP BY 1, 2)
        SELECT count(*) AS n_groups, count(*) FILTER (d > 1) AS n_flipped, round_even(count(*) FILTER (d > 1) / count(*), 3) AS flip_rate FROM g
    """,
    "repeated_calls": f"""
        WITH g AS (SELECT count(*) AS n, count(DISTINCT rule_score) AS d FROM {_V} GROUP BY req_id, attribute, rule_set HAVING count(*) > 1)
        SELECT count(*) AS n_repeated, count(*) FILTER (d = 1) AS n_same, coalesce(sum(n), 0) AS n_calls FROM g
    """,
    "event_cost": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1",
    "revenue": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """,
    "last_event": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "findings_merge": """
        WITH f AS (SELECT DISTINCT * FROM findings WHERE req_id <> ''), a AS (SELECT DISTINCT req_id, kind, true AS o FROM f WHERE round_no <= 1), b AS (SELECT DISTINCT req_id, kind, true AS x FROM f WHERE round_no = 2),
        m AS (SELECT req_id, kind, o, x, req_id IN (SELECT req_id FROM rtm WHERE retired_at IS NULL) AS live FROM a FULL JOIN b USING (req_id, kind)),
        s AS (SELECT req_id, kind, CASE WHEN o IS NULL THEN 'new' WHEN x IS NULL AND live THEN 'resolved' ELSE 'kept' END AS state FROM m)
        SELECT *, CASE WHEN state = 'resolved' THEN 2 END AS resolved_round FROM s
    """,
    "decision_fold": """
        WITH q AS (SELECT DISTINCT approval_id, row_id, lower(trim(decision, ' ')) AS d, decided_at FROM review_queue), v AS (SELECT * FROM q WHERE d IN ('accept', 'reject', 'modify', 'regenerate')),
        f AS (SELECT approval_id, d, row_number() OVER (PARTITION BY approval_id ORDER BY decided_at NULLS FIRST, row_id) AS k, count(*) OVER (PARTITION BY approval_id) AS n FROM v)
        SELECT i.approval_id, coalesce(CASE f.d WHEN 'accept' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'modify' THEN 'modified' WHEN 'regenerate' THEN 'requeued' END, 'pending') AS status, coalesce(n, 0) AS n_decisions
        FROM (SELECT DISTINCT approval_id FROM q WHERE approval_id IS NOT NULL) i LEFT JOIN f ON i.approval_id = f.approval_id AND k = 1
    """,
    "id_assignment": r"""
        WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'FR' ELSE 'NFR' END AS kind FROM orders),
        t AS (SELECT regexp_extract(req_id, '^([A-Z]+)-ERX-(\d+)$', 1) AS kind, max(try_cast(regexp_extract(req_id, '^([A-Z]+)-ERX-(\d+)$', 2) AS INT)) AS top FROM rtm GROUP BY 1),
        n AS (SELECT o_orderkey, o.kind, row_number() OVER (PARTITION BY o.kind ORDER BY o_orderkey) + coalesce(top, 0) AS i FROM o LEFT JOIN t USING (kind))
        SELECT o_orderkey, kind || '-ERX-' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS new_id FROM n
    """,
    "versions": """
        WITH e AS (SELECT user_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, sum(c) AS n_changes, count(*) AS n_events FROM e GROUP BY 1
    """,
    "mcda_ranking": _FACTORS + "SELECT custkey, profile, pct, place FROM m",
    "fired_rules": _FACTORS + "SELECT custkey, rule_id FROM g",
    "recommendations": _FACTORS
    + """, t AS (SELECT custkey, max(profile) FILTER (place = 1) AS top, max(profile) FILTER (place = 2) AS runner_up, max(pct) - min(pct) AS d FROM m WHERE place <= 2 GROUP BY 1)
        SELECT custkey, top, runner_up, round_even(d, 1) AS margin, custkey NOT IN (SELECT custkey FROM g) OR custkey IN (SELECT custkey FROM f WHERE size >= 5) OR d < 5 AS escalate FROM t""",
    "factor_medians": "SELECT l_returnflag, l_linestatus, median(l_quantity) AS median, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2",
    "contested_items": "SELECT query_id, doc_id, min(score) AS low, max(score) AS high FROM hits WHERE score IS NOT NULL GROUP BY 1, 2 HAVING max(score) - min(score) >= 0.2",
    "canonical_types": """
        SELECT doc_id, CASE WHEN coalesce(trim(doc_type), '') = '' THEN 'unknown' WHEN regexp_matches(lower(doc_type), 'spec|srs') THEN 'specification' WHEN regexp_matches(lower(doc_type), 'policy|regulation') THEN 'rule'
            WHEN regexp_matches(lower(doc_type), 'mail|interview|note') THEN 'message' WHEN regexp_matches(lower(doc_type), 'report|finding') THEN 'report' ELSE doc_type END AS family FROM documents
    """,
    "primary_per_kind": "SELECT query_id, doc_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank_no NULLS FIRST, hit_id) AS k FROM (SELECT DISTINCT * FROM hits)) WHERE k = 1",
    "parsed_values": """
        SELECT DISTINCT rtm_id, len(list_filter(list_transform(string_split(coalesce(stakeholder_statements, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '' AND x <> 'nan')) AS n_listed,
            CASE WHEN lower(trim(approval_status, ' ')) IN ('approved', 'rejected', 'pending') THEN lower(trim(approval_status, ' ')) ELSE 'pending' END AS status,
            CASE WHEN version BETWEEN 1 AND 5 THEN version END AS version, coalesce(lower(trim(origin, ' ')) IN ('true', '1', 'yes'), false) AS flag FROM rtm
    """,
    "public_view": "SELECT DISTINCT rtm_id, req_id, version, statement FROM rtm WHERE retired_at IS NULL",
}
