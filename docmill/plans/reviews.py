"""Queries on contracts, control mapping, intake, lookups and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import conflicts, contracts, evaluation as ev, intake, metrics, privacy, quality, registers, retrieval
from docmill.plans import audits, decision, rollups
from docmill.session import cut, half_even, lookup_join, read_table

CONTRACT = contracts.Contract(
    id_form=r"^(FR|NFR)-[A-Z]+-\d{2,}$",
    domains={"verification_method": V.METHODS, "approval_status": ["pending", "approved", "rejected"]},
    filled=("statement", "acceptance_criteria"),
    duty=("statement", "shall"),
    least=18,
    most=500,
    least_of={"FR": 12, "NFR": 600},
)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    r = read_table(spark, folder, "rtm")
    return r.withColumn("cites", F.regexp_extract_all(F.coalesce("evidence_chunks", F.lit("")), F.lit(audits.CHUNK_ID), F.lit(0)))


def contract_errors(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-17: what each row of rtm breaks of the contract, rows of one version being a set."""
    return contracts.record_errors(_records(spark, folder), "version", "rtm_id", "req_id", CONTRACT, "cites", F.col("origin") == "control_gap", read_table(spark, folder, "chunks"), "chunk_id")


def contract_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-18: the directive for each version's set."""
    return contracts.directives(contracts.set_sizes(read_table(spark, folder, "rtm"), "version", "rtm_id", F.substring_index("req_id", "-", 1)), "version", CONTRACT)


def list_errors(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-19: the properties of events, where they hold no list of objects."""
    return read_table(spark, folder, "events").select("event_id", contracts.list_error(F.col("props"), "k", 1).alias("error")).where("error is not null")


def merged_scores(spark: SparkSession, folder: str) -> DataFrame:
    """QA-3, QA-4, JOIN-1: rule scores of every row of rtm beside the newest second score of its requirement and attribute."""
    rules = audits._scored(spark, folder, True)
    ids = read_table(spark, folder, "rtm").select("rtm_id", "req_id").distinct()
    v = read_table(spark, folder, "validation_29148").groupBy("req_id", "attribute").agg(F.max_by(F.struct("llm_score", "note"), F.struct("scored_at", "score_id")).alias("x"))
    second = v.select(F.struct("req_id", "attribute").alias("at"), F.col("x.llm_score").alias("llm_score"), F.col("x.note").alias("llm_note"))
    asked = rules.join(ids, "rtm_id").withColumn("at", F.struct("req_id", "attribute"))
    full = lookup_join(asked.select("rtm_id", "attribute", "rule_score", "rule_note", "at"), second, "at").drop("at")
    said = full.select("rtm_id", "attribute", "llm_score", "llm_note")
    return quality.merged_scores(full.select("rtm_id", "attribute", "rule_score", "rule_note"), said, ["rtm_id", "attribute"], V.WEAKLY_DECIDABLE)


def _controls(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "compliance").where("trim(control_id) <> ''").groupBy("control_id").agg(F.min("rationale").alias("obligation"))


def control_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-8, CMP-1: for each row of rtm whose id is divisible by 20, the three controls nearest to it among all, from 0.3."""
    c = _controls(spark, folder).withColumn("v", retrieval.hashed_vector(F.col("obligation")))
    r = read_table(spark, folder, "rtm").where("rtm_id % 20 = 0").dropDuplicates(["rtm_id"]).select("rtm_id", retrieval.hashed_vector(F.col("statement")).alias("qv"))
    return retrieval.block_topk(c, "control_id", "v", r, "rtm_id", "qv", 3, least=0.3)


def offered_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """CMP-2: of the recorded mappings, those of a pair that was offered, with a relation that may be given."""
    ids = read_table(spark, folder, "rtm").select("rtm_id", "req_id").distinct()
    offered = control_candidates(spark, folder).join(ids, "rtm_id").select("req_id", "control_id").distinct()
    c = read_table(spark, folder, "compliance").where(F.trim("relation").isin("satisfies", "partially")).select("row_id", "req_id", "control_id").distinct()
    return c.join(offered, ["req_id", "control_id"], "left_semi").select("row_id", "req_id", "control_id")


def missing_controls(spark: SparkSession, folder: str) -> DataFrame:
    """CMP-3, JOIN-3, PRJ-11: rows of rtm about security, privacy or regulation whose requirement has no control; with their categories."""
    r = read_table(spark, folder, "rtm").select("rtm_id", "req_id", "statement").distinct()
    r = r.select("rtm_id", "req_id", quality.categories(F.col("statement")).alias("c"))
    some = r.where(F.arrays_overlap("c", F.array(*[F.lit(x) for x in ("security", "privacy", "regulatory")])))
    mapped = read_table(spark, folder, "compliance").where("trim(control_id) <> ''").select("req_id").distinct().withColumn("mapped", F.lit(True))
    return lookup_join(some, mapped, "req_id").where("mapped is null").select("rtm_id", F.array_join("c", ",").alias("categories"))


def queue_order(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-10, SRT-2: pending items of any role with their rank: 0 for high priority, 1 for all others, then by id; the first 50."""
    q = read_table(spark, folder, "review_queue").dropDuplicates(["row_id"])
    return of_queue(q, None, "pending").orderBy("rank", "approval_id", "row_id").limit(50).select("row_id", "approval_id", "required_role", "rank")


def of_queue(queue: DataFrame, role: str | None, status: str | None) -> DataFrame:
    """PRJ-10: items of a role and status, None being any; adds rank, 0 for high priority and 1 for all others."""
    if role is not None:
        queue = queue.where(F.col("required_role") == role)
    if status is not None:
        queue = queue.where(F.col("status") == status)
    return queue.withColumn("rank", F.when(F.col("priority") == "high", 0).otherwise(1))


def first_tests(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-5: the twenty rows of rtm to look at first: those tested first, of them those of unsure confidence, then by id."""
    r = read_table(spark, folder, "rtm").dropDuplicates(["rtm_id"])
    first = F.coalesce(F.lower(F.trim("verification_method")) == "test", F.lit(False))
    return r.orderBy(F.desc(first), F.desc(F.coalesce(F.col("confidence") < 0.7, F.lit(False))), "rtm_id").limit(20).select("rtm_id", "req_id")


def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-8: each hit's chunk by its id, and the number of chunks of its document and section."""
    c = read_table(spark, folder, "chunks").select("chunk_id", "doc_id", "section").distinct()
    h = read_table(spark, folder, "hits").select("hit_id", "chunk_id", F.struct("doc_id", "section").alias("place")).distinct()
    own = lookup_join(h, c.select("chunk_id", F.lit(True).alias("there")), "chunk_id")
    place = c.groupBy(F.struct("doc_id", "section").alias("place")).agg(F.count(F.lit(1)).alias("n_section"))
    return lookup_join(own, place, "place").select("hit_id", F.coalesce("there", F.lit(False)).alias("found"), F.coalesce("n_section", F.lit(0)).alias("n_section"))


def merged_sources(spark: SparkSession, folder: str) -> DataFrame:
    """SET-7: for each recorded duplicate, the cited chunks of both sides' newest versions, in order, each once."""
    r = read_table(spark, folder, "rtm")
    newest = r.groupBy("req_id").agg(F.max_by("evidence_chunks", F.struct("version", "rtm_id")).alias("e"))
    ids = F.regexp_extract_all(F.coalesce("e", F.lit("")), F.lit(audits.CHUNK_ID), F.lit(0))
    n = newest.select("req_id", ids.alias("ids"))
    c = read_table(spark, folder, "conflicts").where("relation = 'duplicate'").select("conflict_id", "req_a", "req_b").distinct()
    met = c.join(n.select(F.col("req_id").alias("req_a"), F.col("ids").alias("a")), "req_a", "left").join(n.select(F.col("req_id").alias("req_b"), F.col("ids").alias("b")), "req_b", "left")
    none = F.array().cast("array<string>")
    return met.select("conflict_id", F.array_join(F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("b", none))), ";").alias("sources"))


def decided_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-18: decisions on requirements, with the number of versions and of open findings of each."""
    q = read_table(spark, folder, "review_queue").where("decision is not null").select("row_id", F.trim("item_id").alias("req_id"), "decision").distinct()
    r = read_table(spark, folder, "rtm").groupBy("req_id").agg(F.countDistinct("version").alias("n_versions"))
    f = read_table(spark, folder, "findings").where("not resolved").groupBy("req_id").agg(F.countDistinct("row_id").alias("n_open"))
    met = lookup_join(lookup_join(q, r, "req_id").where("n_versions is not null"), f, "req_id")
    return met.select("row_id", "req_id", "decision", "n_versions", F.coalesce("n_open", F.lit(0)).alias("n_open"))


def seeds_caught(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-3, JOIN-16: recall of the requirements that a rule found ambiguous by what the second scorer found."""
    f = read_table(spark, folder, "findings").where("kind = 'ambiguity' and trim(req_id) <> ''").select(F.trim("req_id").alias("req_id"), "source").distinct()
    return ev.caught(f.where("source = 'rule'").select("req_id"), f.where("source = 'llm'").select("req_id"), "req_id")


def replayed_injections(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-7: documents whose text holds a high instruction, as it is and after quarantine: how many still hold one."""
    return ev.replayed(read_table(spark, folder, "documents").select("doc_id", "text"), "text", {"undefended": F.col("text"), "defended": privacy.quarantined(F.col("text"))}, [p for p, _, level in V.INJECTIONS if level == "high"])


def top_choice(spark: SparkSession, folder: str) -> DataFrame:
    """EVL-6: how often the profile that a customer's fired rule names is ranked first, and among the first two."""
    named = rollups.fired_rules(spark, folder).select("custkey", F.when(F.col("rule_id") == "R-PL", "planned").when(F.col("rule_id") == "R-IT", "iterative").alias("profile")).where("profile is not null").distinct()
    return ev.hits_at(rollups.mcda_ranking(spark, folder), named, "custkey", "profile", "place")


def own_choice(spark: SparkSession, folder: str) -> DataFrame:
    """SDL-5, SDL-7: customers with usable factors, the engine's first profile and whether it is the one their market segment picks."""
    f = rollups._factors(spark, folder)
    usable = decision.usable(f, "custkey", "factors", 3, spare=2)
    picks = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), decision.canonical(F.col("c_mktsegment"), [(r"build|machin", "planned"), (r"auto", "iterative"), (r".", "hybrid")]).alias("pick"))
    return decision.consistent(decision.suitability(usable, "custkey", "factors", rollups.PROFILES), "custkey", picks, "pick")


def origin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-18: numbers of rows of rtm by origin, as one map for each version."""
    m = metrics.count_map(read_table(spark, folder, "rtm").dropDuplicates(["rtm_id"]), ["version"], F.coalesce("origin", F.lit("none")))
    return m.select("version", F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";").alias("counts"))


def metrics_summary(spark: SparkSession, folder: str) -> DataFrame:
    """MET-1 to MET-7, SET-6, EVL-5: section, metric and value of the corpus, requirements, scores, audit, decisions and calls."""
    c = read_table(spark, folder, "chunks").select("chunk_id", "doc_id", F.size(T.words(F.col("text"))).alias("n")).distinct()
    corpus = c.agg(F.countDistinct("doc_id").alias("source_documents"), F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("chunk_tokens_total"), F.avg("n").alias("chunk_tokens_mean"))
    r = read_table(spark, folder, "rtm").select("rtm_id", "req_id", "origin", F.regexp_extract_all(F.coalesce("evidence_chunks", F.lit("")), F.lit(audits.CHUNK_ID), F.lit(0)).alias("cites")).distinct()
    derived = F.coalesce(F.col("origin") == "control_gap", F.lit(False))
    reqs = r.agg(
        F.count(F.lit(1)).alias("requirements_total"), F.count_if(F.col("req_id").startswith("FR-")).alias("requirements_fr"), F.count_if(F.col("req_id").startswith("NFR-")).alias("requirements_nfr"),
        F.avg((F.size("cites") > 0).cast("int")).alias("traceability_rate"), F.avg(derived.cast("int")).alias("derived_rate"), F.count_if((F.size("cites") == 0) & ~derived).alias("integrity_violations"),
    )
    docs = r.select(F.explode("cites").alias("x")).agg(F.countDistinct(F.substring_index("x", "#", 1)).alias("documents_cited"))
    v = read_table(spark, folder, "validation_29148").dropDuplicates(["score_id"])
    compared = F.col("agreement").isin("agree", "disagree")
    scored = v.agg(
        F.avg(F.when(compared, (F.col("agreement") == "agree").cast("int"))).alias("scorer_agreement"), F.count_if(F.col("agreement") == "disagree").alias("disagreements"),
        F.count_if(F.coalesce(F.trim("human_adjudication"), F.lit("")) != "").alias("human_adjudicated"),
    )
    passed = v.groupBy(F.concat(F.lit("pass_rate_"), F.col("attribute")).alias("metric")).agg(F.avg("rule_score").alias("value"))
    a = audits.citation_verdicts(spark, folder)
    audit = a.agg(F.count(F.lit(1)).alias("citations_checked"), F.count_if(F.col("verdict") == "fabricated").alias("fabricated"), F.count_if(F.col("verdict") == "unverifiable").alias("unverifiable"), F.avg((F.col("verdict") == "fabricated").cast("int")).alias("hallucination_rate"))
    q = read_table(spark, folder, "review_queue").dropDuplicates(["row_id"]).where("item_type = 'requirement_baseline' and decision is not null")
    human = q.agg(F.avg(F.col("decision").isin("modify", "reject", "regenerate").cast("int")).alias("human_correction_rate"))
    e = read_table(spark, folder, "events").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value_total"), F.countDistinct("event_type").alias("tags"))
    tables = [metrics.long(t, s) for s, t in (("corpus", corpus), ("requirements", reqs), ("requirements", docs), ("validation", scored), ("audit", audit), ("review", human), ("cost", e))]
    tables.append(passed.select(F.lit("validation").alias("section"), "metric", "value"))
    return metrics.concatenated(tables).select("section", "metric", F.round("value", 4).alias("value"))


def answer_issues(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S10, INT-1: vague or incomplete criteria of rtm, a figure being due where the row is tested."""
    r = read_table(spark, folder, "rtm").select("rtm_id", "acceptance_criteria", "verification_method").distinct()
    issue = intake.answer_issue(F.col("acceptance_criteria"), F.lower(F.trim("verification_method")) == "test")
    return r.select("rtm_id", issue.alias("x")).where("x is not null").select("rtm_id", "x.issue", "x.detail")


def explained_side(spark: SparkSession, folder: str) -> DataFrame:
    """STA-10: the side of each recorded conflict whose newest statement its explanation is nearest to, if any."""
    n = audits._newest(spark, folder).select("req_id", "statement")
    c = read_table(spark, folder, "conflicts").select("conflict_id", "req_a", "req_b", "explanation").distinct()
    met = c.join(n.select(F.col("req_id").alias("req_a"), F.col("statement").alias("sa")), "req_a").join(n.select(F.col("req_id").alias("req_b"), F.col("statement").alias("sb")), "req_b")
    facts = F.array(F.struct(F.lit("a").alias("id"), F.col("sa").alias("text")), F.struct(F.lit("b").alias("id"), F.col("sb").alias("text")))
    return met.select("conflict_id", intake.attributed(F.col("explanation"), facts).alias("side"))


def intake_statements(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-9: the statements of all documents, masked and quarantined."""
    return intake.taken_in(read_table(spark, folder, "documents"), "doc_id", "text")[0]


def intake_events(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-9: what was masked, quarantined or suspicious in them."""
    return intake.taken_in(read_table(spark, folder, "documents"), "doc_id", "text")[1]


def pii_restored(spark: SparkSession, folder: str) -> DataFrame:
    """SEC-4: hashes of all documents after masking and restoring them."""
    s = cut(audits._spans(spark, folder))
    v = cut(privacy.vault(s, "doc_id"))
    back = intake.restored(privacy.masked(s, "doc_id", v), "doc_id", "masked", v, "security_officer")
    return back.select("doc_id", F.md5(F.col("restored").cast("binary")).alias("text_md5"))


def known_sources(spark: SparkSession, folder: str) -> DataFrame:
    """THR-1: the cited chunks of each row of rtm that exist, and whether it needs a proposal: none exists and it is no duty yet."""
    r = _records(spark, folder)
    kept = contracts.kept_links(r, "rtm_id", F.col("cites"), read_table(spark, folder, "chunks"), "chunk_id")
    duty = r.select("rtm_id", F.coalesce(F.lower("statement").contains("shall"), F.lit(False)).alias("duty")).distinct()
    return kept.join(duty, "rtm_id").select("rtm_id", F.array_join("kept", ";").alias("kept"), ((F.size("kept") == 0) & ~F.col("duty")).alias("proposed"))


def risk_levels(spark: SparkSession, folder: str) -> DataFrame:
    """RSK-1, RSK-2: each row of rtm with the band of its requirement's highest similarity to a control, Unassessed without any."""
    r = read_table(spark, folder, "rtm").select("rtm_id", "req_id").distinct()
    c = read_table(spark, folder, "compliance").where("trim(req_id) <> ''").select("req_id", "similarity")
    return registers.worst_level(r, "req_id", c, F.col("similarity"), [(0.75, "Critical"), (0.5, "High"), (0.25, "Medium")], "Low").select("rtm_id", "level")


def best_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """LLM-8: of the scorings of each requirement and attribute that with the fewest failures, the last of them on ties."""
    v = read_table(spark, folder, "validation_29148").select("req_id", "attribute", "score_id", "scored_at", (2 - F.coalesce("rule_score", F.lit(0)) - F.coalesce("llm_score", F.lit(0))).alias("errors"))
    rows = v.where("req_id is not null").withColumn("turn", F.unix_micros("scored_at"))
    best = rows.groupBy("req_id", "attribute").agg(F.min_by("score_id", F.struct("errors", -F.col("turn"), -F.col("score_id"))).alias("score_id"))
    return best.select("req_id", "attribute", "score_id")


def kept_adjudications(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-14: the scorings of round 2 with what people had entered for the same requirement and attribute in earlier rounds."""
    v = read_table(spark, folder, "validation_29148").select("score_id", "req_id", "attribute", "round_no", "human_adjudication").distinct()
    old = v.where("round_no < 2").select("req_id", "attribute", "human_adjudication")
    return ev.kept_verdicts(v.where("round_no = 2"), old, ["req_id", "attribute"], "human_adjudication").select("score_id", "human_adjudication")


def statement_owners(spark: SparkSession, folder: str) -> DataFrame:
    """CFL-2: the stakeholders behind each row of rtm, sorted."""
    r = audits.requirements(spark, folder)
    return r.select("rtm_id", F.array_join(F.array_sort(conflicts.stakeholders(F.col("sources"))), ";").alias("owners"))


def duplicate_merges(spark: SparkSession, folder: str) -> DataFrame:
    """CFL-4: of the 24 recorded duplicates to look at first, which requirement is merged into which."""
    c = read_table(spark, folder, "conflicts").where("relation = 'duplicate'").dropDuplicates(["conflict_id"])
    pairs = [(x["req_a"], x["req_b"]) for x in conflicts.ranked_pairs(c, F.size("signals") > 0, F.col("similarity") >= 0.86, "similarity", ["conflict_id"]).collect()]  # a report of 24
    ids = {x for p in pairs for x in p}
    n = audits.requirements(spark, folder).where(F.col("req_id").isin(list(ids))).groupBy("req_id").agg(F.max(F.size("sources")).alias("n")).collect()
    into = conflicts.merge_duplicates(pairs, {x["req_id"]: x["n"] for x in n})
    return spark.createDataFrame(sorted(into.items()), "req_id string, merged_into string")


QUERIES = {
    f.__name__: f
    for f in (
        known_sources, risk_levels, best_attempts, kept_adjudications, statement_owners, duplicate_merges, contract_errors, contract_repairs, list_errors, merged_scores, control_candidates, offered_mappings, missing_controls, queue_order, first_tests, chunk_lookup, merged_sources, decided_requirements, seeds_caught,
        replayed_injections, top_choice, own_choice, origin_counts, metrics_summary, answer_issues, explained_side, intake_statements, intake_events, pii_restored,
    )
}

_CITES = audits.CHUNK_ID
_RTM = f"""
    r AS (SELECT DISTINCT rtm_id, req_id, version, statement, acceptance_criteria, verification_method, approval_status, origin, confidence,
            list_distinct(regexp_extract_all(coalesce(evidence_chunks, ''), '{_CITES}')) AS cites FROM rtm)
"""
_LIST = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
_HASHED = """
    w AS (SELECT key, unnest(regexp_extract_all(lower(coalesce(t, '')), '[a-z]{3,}')) AS w FROM s), b AS (SELECT key, CAST(('0x' || substr(md5(w), 31, 2))::INT AS INT) AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
    m AS (SELECT key, sqrt(sum(n * n)) AS m FROM b GROUP BY 1)
"""
_CANDIDATES = f"""
    WITH s AS (SELECT 'r' || rtm_id AS key, statement AS t FROM (SELECT DISTINCT rtm_id, statement FROM rtm WHERE rtm_id % 20 = 0)
               UNION ALL SELECT 'c' || control_id, min(rationale) FROM compliance WHERE trim(control_id, ' ') <> '' GROUP BY control_id), {_HASHED},
    p AS (SELECT x.key AS a, y.key AS c, round(sum(x.n * y.n) / (any_value(mx.m) * any_value(my.m)), 6) AS score FROM b x JOIN b y ON x.b = y.b AND x.key LIKE 'r%' AND y.key LIKE 'c%' JOIN m mx ON mx.key = x.key JOIN m my ON my.key = y.key GROUP BY 1, 2),
    k AS (SELECT substr(a, 2)::BIGINT AS rtm_id, substr(c, 2) AS control_id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS rank_no FROM p),
    o AS (SELECT * FROM k WHERE rank_no <= 3 AND score >= 0.3)
"""
_VAGUE = sorted(set(V.WEAK_WORDS + V.VAGUE_ANSWERS), key=lambda w: (-len(w), w))
_WORD = lambda w: "'\\b" + audits._escape(w).replace("'", "''") + "\\b'"
_HIGH = "|".join(f"(?:{p})" for p, _, level in V.INJECTIONS if level == "high")
SQL = {
    "known_sources": f"""
        WITH o AS (SELECT DISTINCT rtm_id, statement, regexp_extract_all(coalesce(evidence_chunks, ''), '{_CITES}') AS l FROM rtm), e AS (SELECT rtm_id, unnest(l) AS c, unnest(range(len(l))) AS p FROM o),
        f AS (SELECT rtm_id, c, min(p) AS p FROM e WHERE c IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY 1, 2), k AS (SELECT rtm_id, string_agg(c, ';' ORDER BY p) AS kept FROM f GROUP BY 1)
        SELECT o.rtm_id, coalesce(kept, '') AS kept, kept IS NULL AND NOT coalesce(contains(lower(statement), 'shall'), false) AS proposed FROM o LEFT JOIN k ON o.rtm_id = k.rtm_id
    """,
    "risk_levels": """
        WITH w AS (SELECT req_id, max(similarity) AS w FROM compliance WHERE trim(req_id, ' ') <> '' GROUP BY 1), r AS (SELECT DISTINCT rtm_id, req_id FROM rtm)
        SELECT rtm_id, CASE WHEN w >= 0.75 THEN 'Critical' WHEN w >= 0.5 THEN 'High' WHEN w >= 0.25 THEN 'Medium' WHEN w IS NOT NULL THEN 'Low' ELSE 'Unassessed' END AS level FROM r LEFT JOIN w ON r.req_id = w.req_id
    """,
    "best_attempts": """
        SELECT req_id, attribute, score_id FROM (SELECT *, row_number() OVER (PARTITION BY req_id, attribute ORDER BY 2 - coalesce(rule_score, 0) - coalesce(llm_score, 0), scored_at DESC NULLS FIRST, score_id DESC) AS k
            FROM (SELECT DISTINCT * FROM validation_29148 WHERE req_id IS NOT NULL)) WHERE k = 1
    """,
    "kept_adjudications": """
        WITH v AS (SELECT DISTINCT score_id, req_id, attribute, round_no, human_adjudication FROM validation_29148), o AS (SELECT req_id, attribute, max(human_adjudication) AS h FROM v WHERE round_no < 2 GROUP BY 1, 2)
        SELECT score_id, coalesce(h, '') AS human_adjudication FROM v LEFT JOIN o USING (req_id, attribute) WHERE round_no = 2
    """,
    "statement_owners": r"""
        WITH r AS (SELECT DISTINCT rtm_id, regexp_extract_all(coalesce(stakeholder_statements, ''), 'S-[A-Z]+-\d+') AS s FROM rtm) SELECT rtm_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(s, lambda x: split_part(x, '-', 2)))), ';'), '') AS owners FROM r
    """,
    "contract_errors": f"""
        WITH {_RTM}, l AS (SELECT *, coalesce(nullif(trim(req_id, ' '), ''), '#' || rtm_id) AS label FROM r),
        f AS (SELECT version, req_id, min(rtm_id) AS first FROM r WHERE req_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
        c AS (SELECT rtm_id, unnest(cites) AS id FROM r), u AS (SELECT rtm_id, id FROM c WHERE id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)), n AS (SELECT rtm_id, count(*) AS n FROM u GROUP BY 1)
        SELECT version, rtm_id, 'id_form' AS check_id, label || ': not an id of this form' AS message FROM l WHERE NOT coalesce(regexp_matches(req_id, '{CONTRACT.id_form}'), false)
        UNION ALL SELECT version, rtm_id, 'domain', label || ': verification_method is not one of {", ".join(sorted(V.METHODS))}' FROM l WHERE NOT coalesce(verification_method IN ({_LIST(V.METHODS)}), false)
        UNION ALL SELECT version, rtm_id, 'domain', label || ': approval_status is not one of approved, pending, rejected' FROM l WHERE NOT coalesce(approval_status IN ('pending', 'approved', 'rejected'), false)
        UNION ALL SELECT version, rtm_id, 'empty', label || ': statement is empty' FROM l WHERE trim(coalesce(statement, ''), ' ') = ''
        UNION ALL SELECT version, rtm_id, 'empty', label || ': acceptance_criteria is empty' FROM l WHERE trim(coalesce(acceptance_criteria, ''), ' ') = ''
        UNION ALL SELECT version, rtm_id, 'duty', label || ': statement has no shall' FROM l WHERE NOT coalesce(contains(lower(statement), 'shall'), false)
        UNION ALL SELECT l.version, rtm_id, 'duplicate', label || ': the id is taken' FROM l JOIN f ON l.version = f.version AND l.req_id = f.req_id WHERE rtm_id <> first
        UNION ALL SELECT version, l.rtm_id, 'unknown_source', label || ': unknown source ' || id FROM l JOIN u ON l.rtm_id = u.rtm_id
        UNION ALL SELECT version, l.rtm_id, 'no_source', label || ': neither cited nor derived' FROM l LEFT JOIN n ON l.rtm_id = n.rtm_id WHERE coalesce(origin, '') <> 'control_gap' AND len(cites) <= coalesce(n, 0)
    """,
    "contract_repairs": f"""
        WITH s AS (SELECT version, count(DISTINCT rtm_id) AS n, count(DISTINCT rtm_id) FILTER (split_part(req_id, '-', 1) = 'FR') AS fr, count(DISTINCT rtm_id) FILTER (split_part(req_id, '-', 1) = 'NFR') AS nfr FROM rtm GROUP BY 1),
        d AS (SELECT version, list_filter([CASE WHEN n < {CONTRACT.least} THEN 'add ' || ({CONTRACT.least} - n) || ' new records' END, CASE WHEN n > {CONTRACT.most} THEN 'merge or remove ' || (n - {CONTRACT.most}) || ' records' END,
            CASE WHEN fr < {CONTRACT.least_of["FR"]} THEN 'FR: ' || ({CONTRACT.least_of["FR"]} - fr) || ' more, {CONTRACT.least_of["FR"]} are due' END,
            CASE WHEN nfr < {CONTRACT.least_of["NFR"]} THEN 'NFR: ' || ({CONTRACT.least_of["NFR"]} - nfr) || ' more, {CONTRACT.least_of["NFR"]} are due' END], lambda x: x IS NOT NULL) AS l FROM s)
        SELECT version, len(l) = 0 AS ok, CASE WHEN len(l) = 0 THEN 'keep the number of records and mend the fields named' ELSE array_to_string(l, '; ') END AS directive FROM d
    """,
    "list_errors": """
        SELECT event_id, CASE WHEN props IS NULL OR json_type(props, '$.k') IS NULL OR json_type(props, '$.k') <> 'ARRAY' THEN 'k is no list' ELSE 'k: 0 of 1 objects' END AS error FROM events
        WHERE props IS NULL OR json_type(props, '$.k') IS NULL OR json_type(props, '$.k') <> 'ARRAY' OR len(list_filter(json_extract(props, '$.k[*]'), lambda x: json_type(x) = 'OBJECT')) < 1
    """,
    "control_candidates": _CANDIDATES + "SELECT rtm_id, control_id, score, rank_no FROM o",
    "offered_mappings": _CANDIDATES
    + ", i AS (SELECT DISTINCT req_id, control_id FROM o JOIN rtm USING (rtm_id)) SELECT DISTINCT row_id, req_id, control_id FROM compliance JOIN i USING (req_id, control_id) WHERE trim(relation, ' ') IN ('satisfies', 'partially')",
    "missing_controls": f"""
        WITH {_RTM}, k AS (SELECT rtm_id, req_id, {rollups._CATS["statement"]} AS c FROM r)
        SELECT rtm_id, array_to_string(c, ',') AS categories FROM k WHERE list_has_any(c, ['security', 'privacy', 'regulatory']) AND (req_id IS NULL OR req_id NOT IN (SELECT req_id FROM compliance WHERE trim(control_id, ' ') <> '' AND req_id IS NOT NULL))
    """,
    "queue_order": "SELECT row_id, approval_id, required_role, CASE WHEN priority = 'high' THEN 0 ELSE 1 END AS rank FROM (SELECT DISTINCT * FROM review_queue WHERE status = 'pending') ORDER BY rank, approval_id NULLS FIRST, row_id LIMIT 50",
    "first_tests": f"WITH {_RTM} SELECT rtm_id, req_id FROM r ORDER BY coalesce(lower(trim(verification_method, ' ')) = 'test', false) DESC, coalesce(confidence < 0.7, false) DESC, rtm_id LIMIT 20",
    "chunk_lookup": """
        WITH c AS (SELECT DISTINCT chunk_id, doc_id, section FROM chunks), n AS (SELECT doc_id, section, count(*) AS n FROM c GROUP BY 1, 2), h AS (SELECT DISTINCT hit_id, chunk_id, doc_id, section FROM hits)
        SELECT hit_id, coalesce(h.chunk_id IN (SELECT chunk_id FROM c WHERE chunk_id IS NOT NULL), false) AS found, coalesce(n, 0) AS n_section FROM h LEFT JOIN n ON h.doc_id = n.doc_id AND h.section = n.section
    """,
    "decided_requirements": """
        WITH q AS (SELECT DISTINCT row_id, trim(item_id, ' ') AS req_id, decision FROM review_queue WHERE decision IS NOT NULL), r AS (SELECT req_id, count(DISTINCT version) AS n_versions FROM rtm GROUP BY 1),
        f AS (SELECT req_id, count(DISTINCT row_id) AS n_open FROM findings WHERE NOT resolved GROUP BY 1)
        SELECT row_id, q.req_id, decision, n_versions, coalesce(n_open, 0) AS n_open FROM q JOIN r ON q.req_id = r.req_id LEFT JOIN f ON q.req_id = f.req_id
    """,
    "seeds_caught": """
        WITH f AS (SELECT DISTINCT trim(req_id, ' ') AS req_id, source FROM findings WHERE kind = 'ambiguity' AND trim(req_id, ' ') <> ''), s AS (SELECT req_id FROM f WHERE source = 'rule')
        SELECT count(*) AS n_seeds, count(*) FILTER (req_id IN (SELECT req_id FROM f WHERE source = 'llm')) AS n_caught, round_even(count(*) FILTER (req_id IN (SELECT req_id FROM f WHERE source = 'llm')) / count(*), 3) AS recall FROM s
    """,
    "top_choice": rollups._FACTORS
    + """, e AS (SELECT DISTINCT custkey, CASE rule_id WHEN 'R-PL' THEN 'planned' ELSE 'iterative' END AS profile FROM g), x AS (SELECT place FROM e LEFT JOIN m USING (custkey, profile))
        SELECT count(*) AS n, round_even(count(*) FILTER (place = 1) / count(*), 3) AS top1, round_even(count(*) FILTER (place <= 2) / count(*), 3) AS top2 FROM x""",
    "own_choice": rollups._FACTORS
    + """, c AS (SELECT c_custkey AS custkey, CASE WHEN regexp_matches(lower(c_mktsegment), 'build|machin') THEN 'planned' WHEN lower(c_mktsegment) LIKE '%auto%' THEN 'iterative' ELSE 'hybrid' END AS pick FROM customer)
        SELECT custkey, pick, profile AS engine_top, pick = profile AS consistent FROM m JOIN c USING (custkey) WHERE place = 1""",
    "origin_counts": "WITH g AS (SELECT version, coalesce(origin, 'none') AS o, count(DISTINCT rtm_id) AS n FROM rtm GROUP BY 1, 2) SELECT version, array_to_string(list_sort(list(o || '=' || n)), ';') AS counts FROM g GROUP BY 1",
    "metrics_summary": audits._CITE
    + f""", c2 AS (SELECT DISTINCT chunk_id, doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n FROM chunks),
        q2 AS (SELECT DISTINCT rtm_id, req_id, origin, regexp_extract_all(coalesce(evidence_chunks, ''), '{_CITES}') AS cites FROM rtm), v2 AS (SELECT DISTINCT * FROM validation_29148),
        o2 AS (SELECT DISTINCT * FROM review_queue WHERE item_type = 'requirement_baseline' AND decision IS NOT NULL),
        x AS (SELECT 'corpus' AS section, 'source_documents' AS metric, count(DISTINCT doc_id)::DOUBLE AS value FROM c2 UNION ALL SELECT 'corpus', 'chunks', count(*) FROM c2 UNION ALL SELECT 'corpus', 'chunk_tokens_total', sum(n) FROM c2
        UNION ALL SELECT 'corpus', 'chunk_tokens_mean', avg(n) FROM c2 UNION ALL SELECT 'requirements', 'requirements_total', count(*) FROM q2 UNION ALL SELECT 'requirements', 'requirements_fr', count(*) FROM q2 WHERE req_id LIKE 'FR-%'
        UNION ALL SELECT 'requirements', 'requirements_nfr', count(*) FROM q2 WHERE req_id LIKE 'NFR-%' UNION ALL SELECT 'requirements', 'traceability_rate', avg((len(cites) > 0)::INT) FROM q2
        UNION ALL SELECT 'requirements', 'derived_rate', avg((coalesce(origin, '') = 'control_gap')::INT) FROM q2 UNION ALL SELECT 'requirements', 'integrity_violations', count(*) FROM q2 WHERE len(cites) = 0 AND coalesce(origin, '') <> 'control_gap'
        UNION ALL SELECT 'requirements', 'documents_cited', count(DISTINCT split_part(c, '#', 1)) FROM (SELECT unnest(cites) AS c FROM q2) UNION ALL SELECT 'validation', 'scorer_agreement', avg((agreement = 'agree')::INT) FROM v2 WHERE agreement IN ('agree', 'disagree')
        UNION ALL SELECT 'validation', 'disagreements', count(*) FROM v2 WHERE agreement = 'disagree' UNION ALL SELECT 'validation', 'human_adjudicated', count(*) FROM v2 WHERE coalesce(trim(human_adjudication, ' '), '') <> ''
        UNION ALL SELECT 'validation', 'pass_rate_' || attribute, avg(rule_score) FROM v2 GROUP BY attribute UNION ALL SELECT 'audit', 'citations_checked', count(*) FROM w UNION ALL SELECT 'audit', 'fabricated', count(*) FROM w WHERE verdict = 'fabricated'
        UNION ALL SELECT 'audit', 'unverifiable', count(*) FROM w WHERE verdict = 'unverifiable' UNION ALL SELECT 'audit', 'hallucination_rate', avg((verdict = 'fabricated')::INT) FROM w
        UNION ALL SELECT 'review', 'human_correction_rate', avg((decision IN ('modify', 'reject', 'regenerate'))::INT) FROM o2 UNION ALL SELECT 'cost', 'calls', count(*) FROM events UNION ALL SELECT 'cost', 'value_total', sum(value) FROM events
        UNION ALL SELECT 'cost', 'tags', count(DISTINCT event_type) FROM events)
        SELECT section, metric, round(value, 4) AS value FROM x
    """,
    "answer_issues": f"""
        WITH {_RTM}, x AS (SELECT rtm_id, coalesce(acceptance_criteria, '') AS t, lower(trim(verification_method, ' ')) = 'test' AS q FROM r),
        h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(t), {_WORD(w)}) THEN '{w}' END" for w in _VAGUE)}], lambda w: w IS NOT NULL) AS hits FROM x)
        SELECT rtm_id, CASE WHEN len(hits) > 0 THEN 'vague' ELSE 'incomplete' END AS issue, CASE WHEN len(hits) > 0 THEN 'vague wording: ' || array_to_string(hits[1:3], ', ') ELSE 'no figure where one is needed' END AS detail
        FROM h WHERE NOT regexp_matches(t, '{V.NO_ANSWER.replace("'", "''")}') AND (len(hits) > 0 OR (coalesce(q, false) AND NOT regexp_matches(t, '[0-9]')))
    """,
    "merged_sources": f"""
        WITH n AS (SELECT req_id, regexp_extract_all(coalesce(arg_max(coalesce(evidence_chunks, ''), struct_pack(v := version, i := rtm_id)), ''), '{_CITES}') AS ids FROM rtm GROUP BY 1),
        c AS (SELECT DISTINCT conflict_id, req_a, req_b FROM conflicts WHERE relation = 'duplicate'), l AS (SELECT conflict_id, list_concat(coalesce(a.ids, []), coalesce(b.ids, [])) AS l FROM c LEFT JOIN n a ON a.req_id = req_a LEFT JOIN n b ON b.req_id = req_b)
        SELECT conflict_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';'), '') AS sources FROM l
    """,
    "explained_side": f"""
        WITH n AS (SELECT req_id, arg_max(struct_pack(s := statement), struct_pack(v := version, i := rtm_id)).s AS s FROM rtm GROUP BY 1), c AS (SELECT DISTINCT conflict_id, req_a, req_b, explanation FROM conflicts),
        w AS (SELECT conflict_id, {", ".join(f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')), lambda z: NOT list_contains([{_LIST(V.ANSWER_STOPS)}], z)) AS {y}" for x, y in (("explanation", "e"), ("a.s", "x"), ("b.s", "y")))}
              FROM c JOIN n a ON a.req_id = req_a JOIN n b ON b.req_id = req_b),
        q AS (SELECT conflict_id, len(e) AS n, len(list_intersect(e, x)) / greatest(len(x), 1) AS sx, len(list_intersect(e, y)) / greatest(len(y), 1) AS sy FROM w)
        SELECT conflict_id, CASE WHEN n < 4 OR greatest(sx, sy) < 0.34 THEN NULL WHEN sx >= sy THEN 'a' ELSE 'b' END AS side FROM q
    """,
    "pii_restored": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
}
