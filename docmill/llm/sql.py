"""SQL of those queries of this package that SQL can express, for an independent check."""

from docmill.llm.consensus import MET, NOT_MET

_MET = "'" + "', '".join(MET) + "'"
_NOT = "'" + "', '".join(NOT_MET) + "'"
_SAID = r"lower(regexp_replace(trim(human_adjudication, e' \t\r\n.!' || chr(160)), '\s+', ' ', 'g'))"
_VOTES = f"""
    WITH v AS (SELECT DISTINCT * FROM validation_29148 WHERE req_id IS NOT NULL AND attribute IS NOT NULL),
    l AS (SELECT req_id, attribute, coalesce(nullif(trim(rule_set, ' '), ''), '?') AS who, rule_score AS label FROM v
          UNION ALL SELECT req_id, attribute, coalesce(nullif(trim(llm_model, ' '), ''), '?'), llm_score FROM v
          UNION ALL SELECT req_id, attribute, coalesce(nullif(trim(adjudicator, ' '), ''), '?'), CASE WHEN {_SAID} IN ({_MET}) THEN 1 WHEN {_SAID} IN ({_NOT}) THEN 0 END FROM v),
    w AS (SELECT req_id, attribute, who, avg(label) AS one FROM l WHERE label IN (0, 1) GROUP BY ALL)
"""

SQL = {
    "p1_found": r"""
        SELECT DISTINCT hit_id FROM hits WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 800
    """,
    "p2_found": """
        WITH t AS (
            SELECT rtm_id, list_distinct(regexp_extract_all(lower(coalesce(statement, '') || ' ' || coalesce(acceptance_criteria, '')), '[a-z0-9]+')) AS w
            FROM (SELECT DISTINCT rtm_id, statement, acceptance_criteria FROM rtm)
        )
        SELECT a.rtm_id AS rtm_id_a, b.rtm_id AS rtm_id_b FROM t a JOIN t b
          ON a.rtm_id < b.rtm_id AND len(a.w) > 0 AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
        WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
    """,
    "p1_cover": r"""
        SELECT DISTINCT hit_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n_words, true AS fits, true AS overlaps FROM hits WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 800
    """,
    "p2_groups": """
        WITH RECURSIVE t AS (
            SELECT rtm_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(statement, '') || ' ' || coalesce(acceptance_criteria, '')), '[a-z0-9]+'))) AS w
            FROM (SELECT DISTINCT rtm_id, statement, acceptance_criteria FROM rtm)
        ), c AS (SELECT w, min(rtm_id) AS class_id FROM t WHERE len(w) > 0 GROUP BY w),
        e AS (
            SELECT a.class_id AS x, b.class_id AS y FROM c a JOIN c b ON a.class_id <> b.class_id AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
            WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
        ), r AS (SELECT class_id AS x, class_id AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        g AS (SELECT x AS class_id, min(y) AS group_id FROM r GROUP BY 1), d AS (SELECT x AS class_id, count(*) AS n_links FROM e GROUP BY 1)
        SELECT rtm_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM t JOIN c USING (w) JOIN g USING (class_id) LEFT JOIN d USING (class_id)
    """,
    "p4_agreement": _VOTES + """,
        g AS (SELECT count(*) AS m, sum(one) AS ones, sum(one * one + (1 - one) * (1 - one)) AS own FROM w GROUP BY req_id, attribute HAVING count(*) > 1),
        s AS (SELECT count(*) AS n_items, sum(m) AS m, sum(ones) AS ones, sum((ones * ones + (m - ones) * (m - ones) - own) / (m - 1)) AS agree FROM g),
        x AS (SELECT n_items, agree / m AS o, (ones * (ones - 1) + (m - ones) * (m - ones - 1)) / (m * (m - 1)) AS e FROM s)
        SELECT n_items, round(o, 4) AS observed, round(e, 4) AS expected, round(1 - (1 - o) / (1 - e), 4) AS alpha FROM x
    """,
    "p6_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
