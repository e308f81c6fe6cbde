"""Queries on text, chunks and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import chunking, retrieval
from docmill.session import half_even, read_table


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-1, FN-S2."""
    return read_table(spark, folder, "documents").select("doc_id", F.length(T.clean(F.col("text"))).alias("n_clean"), F.md5(T.clean(F.col("text")).cast("binary")).alias("clean_md5"))


def normal_text(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-14."""
    d = read_table(spark, folder, "documents")
    return d.select("doc_id", F.length(T.only_words(F.col("text"))).alias("n_letters"), F.md5(T.only_words(F.col("text")).cast("binary")).alias("words_md5"))


def slug_ids(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-7."""
    return read_table(spark, folder, "chunks").select("chunk_id", T.slug(F.col("heading")).alias("slug")).distinct()


def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-9, TXT-11."""
    d = read_table(spark, folder, "documents").select("doc_id", "text")
    return chunking.window_rows(d, "doc_id", "text", 200, 40).select("doc_id", "n_tokens", "window_no", "start", "window_tokens")


def chunk_build(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-10, WIN-1, AGG-20."""
    c = read_table(spark, folder, "chunks").withColumn("ord", F.col("chunk_id"))
    return chunking.chunk_numbers(c, "doc_id", "section", "ord", "text", 200, 40, 60, 20).select("doc_id", "section", "start", "chunk_no", F.col("chunk_id").alias("new_id"), "token_count")


def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-20: chunks and tokens per document."""
    c = read_table(spark, folder, "chunks").select("chunk_id", "doc_id", F.size(T.words(F.col("text"))).alias("n")).distinct()  # words are counted before anything is shuffled
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_tokens"), half_even(F.avg("n"), 3).alias("mean_tokens"), F.max("n").alias("max_tokens"))


def id_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-12 over the chunk ids as retrieved."""
    return chunking.id_problems(read_table(spark, folder, "hits").dropDuplicates(["hit_id"]), "chunk_id", "doc_id", "section")


def paragraph_rows(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-13."""
    p = chunking.paragraph_rows(read_table(spark, folder, "documents"), "doc_id", "text")
    return p.select("doc_id", "para_no", F.length("paragraph").alias("n_chars"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """FN-S11."""
    s = T.sentences(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


def designators(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-4, TXT-5: lettered groups of a document's lines, merged up to 60 tokens."""
    d = read_table(spark, folder, "documents").where("text is not null")
    lines = F.filter(F.split("text", r"\r?\n"), lambda p: F.trim(p) != "")
    merged = chunking.merged_groups(chunking.designator_groups(lines), 60)
    return d.select("doc_id", F.posexplode(merged).alias("pos", "g")).select("doc_id", "pos", "g.first", "g.last", "g.tokens")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-2: ten nearest vectors of every vector whose id is divisible by 20, among all."""
    e = read_table(spark, folder, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.block_topk(e, "vec_id", "embedding", q, "query_id", "qv", 10)


def allowlisted_topk(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-3: the same among allowed labels only."""
    e = read_table(spark, folder, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.block_topk(retrieval.allowed(e, "label", [0, 2, 4]), "vec_id", "embedding", q, "query_id", "qv", 5)


def distance_topk(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-12: the same by squared distance."""
    e = read_table(spark, folder, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.block_topk(e, "vec_id", "embedding", q, "query_id", "qv", 5, metric="l2", digits=5)


def best_in_pool(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-9: the best hit of each query in each document, ties to the first rank."""
    h = read_table(spark, folder, "hits").where("score is not null").dropDuplicates(["hit_id"])
    best = h.groupBy("query_id", "doc_id").agg(F.max(F.struct("score", (-F.col("hit_id")).alias("neg"))).alias("b"), F.count(F.lit(1)).alias("pool"))
    return best.select("query_id", "doc_id", (-F.col("b.neg")).alias("hit_id"), F.col("b.score").alias("score"), "pool")


def facet_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-5, WIN-2, WIN-5: hits of each query fused over facets."""
    h = read_table(spark, folder, "hits").dropDuplicates(["hit_id"]).where("score is not null and facet is not null")
    depth = F.row_number().over(W.partitionBy("query_id", "facet").orderBy(F.desc("score"), "hit_id"))
    return retrieval.fuse(h.withColumn("depth", depth), "query_id", "facet", "facet", "depth", "chunk_id", 3, 16)


def budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-7: hits of each query within 1,000 words."""
    h = read_table(spark, folder, "hits").dropDuplicates(["hit_id"]).withColumn("n_words", F.size(T.words(F.col("text"))))
    r = h.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "hit_id")))
    return retrieval.pack(r, "query_id", "place", "n_words", 1000).select("query_id", "hit_id", "place", "n_words", "running")


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-11: five chunks sharing most words with each requirement whose id is divisible by 20."""
    c = read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    q = read_table(spark, folder, "rtm").where("rtm_id % 20 = 0").select("rtm_id", "statement").distinct()
    return retrieval.lexical_topk(c, "chunk_id", "text", q, "rtm_id", "statement", 5)


def hashed_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-1: buckets and counts of every statement."""
    r = read_table(spark, folder, "rtm").select("rtm_id", "statement").distinct()
    return r.select("rtm_id", F.explode(retrieval.hashed_terms(F.col("statement"))).alias("bucket", "n"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-10: each chunk's sentences nearest to its heading."""
    c = read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", retrieval.excerpt(F.col("text"), F.col("heading")).alias("excerpt"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: hits are ranked by facet, fused, and packed into each query's budget."""
    h = read_table(spark, folder, "hits").dropDuplicates(["hit_id"]).where("score is not null and facet is not null")
    depth = F.row_number().over(W.partitionBy("query_id", "facet").orderBy(F.desc("score"), "hit_id"))
    fused = retrieval.fuse(h.withColumn("depth", depth), "query_id", "facet", "facet", "depth", "chunk_id", 3, 16)
    size = read_table(spark, folder, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", F.size(T.words(F.col("text"))).alias("n_words"))
    return retrieval.pack(fused.join(size, "chunk_id", "left"), "query_id", "rank_no", "n_words", 1000).select("query_id", "rank_no", "facet", "chunk_id", "n_words", "running")


QUERIES = {
    f.__name__: f
    for f in (clean_text, normal_text, slug_ids, token_windows, chunk_build, chunk_totals, id_roundtrip, paragraph_rows, sentence_counts, designators, cosine_topk, allowlisted_topk, distance_topk, best_in_pool, facet_fusion, budget_pack, lexical_topk, hashed_embedding, excerpts, evidence)
}
# Spark's \s and that of DuckDB are the same six ASCII characters but for the vertical tab, which these texts don't hold.
_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
_TOPK = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (
        SELECT query_id, vec_id, round({score}, {digits}) + 0.0 AS score FROM q CROSS JOIN embeddings {where}
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank_no FROM s)
    SELECT query_id, vec_id, score, rank_no FROM r WHERE rank_no <= {k}
"""
_FUSED = """
    h AS (SELECT DISTINCT * FROM hits WHERE score IS NOT NULL AND facet IS NOT NULL),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY score DESC, hit_id) AS depth FROM h),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY depth, facet) AS n FROM d WHERE depth <= 3),
    fused AS (SELECT query_id, facet, chunk_id, depth, row_number() OVER (PARTITION BY query_id ORDER BY depth, facet, chunk_id) AS rank_no FROM f WHERE n = 1 QUALIFY rank_no <= 16)
"""
SQL = {
    "sentence_counts": r"""
        WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
            lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
        SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s
    """,
    "clean_text": r"""
        WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8209), ' -'), '[ \t]+', ' ', 'g'), '\n{3,}', e'\n\n', 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS c FROM documents)
        SELECT doc_id, length(c) AS n_clean, md5(c) AS clean_md5 FROM c
    """,
    "normal_text": """
        WITH c AS (SELECT doc_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS c FROM documents)
        SELECT doc_id, length(c) AS n_letters, md5(c) AS words_md5 FROM c
    """,
    "slug_ids": """
        SELECT chunk_id, coalesce(nullif(substr(trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), ''), 'sec') AS slug
        FROM (SELECT DISTINCT * FROM chunks)
    """,
    "token_windows": f"""
        WITH t AS (SELECT doc_id, len({_WORDS.format("text")}) AS n_tokens FROM documents),
        w AS (SELECT doc_id, n_tokens, unnest(range(0, CASE WHEN n_tokens <= 200 THEN 1 ELSE CAST(ceil((n_tokens - 200) / 160.0) AS BIGINT) * 160 + 1 END, 160)) AS start FROM t WHERE n_tokens > 0)
        SELECT doc_id, n_tokens, start // 160 AS window_no, start, least(200, n_tokens - start) AS window_tokens FROM w
    """,
    "chunk_build": f"""
        WITH t AS (SELECT DISTINCT doc_id, section, chunk_id AS ord, len({_WORDS.format("text")}) AS n FROM chunks),
        w AS (SELECT *, unnest(range(0, CASE WHEN n <= 200 THEN 1 ELSE CAST(ceil((n - 200) / 160.0) AS BIGINT) * 160 + 1 END, 160)) AS start FROM t WHERE n > 0),
        k AS (SELECT *, least(200, n - start) AS token_count FROM w WHERE least(200, n - start) >= 20 AND (n <= 200 OR least(200, n - start) >= 60)),
        x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, section, start) AS chunk_no FROM k)
        SELECT doc_id, section, start, chunk_no, doc_id || '#S' || section || '#c' || CASE WHEN chunk_no < 10 THEN '0' ELSE '' END || chunk_no AS new_id, token_count FROM x
    """,
    "chunk_totals": f"""
        WITH t AS (SELECT DISTINCT chunk_id, doc_id, len({_WORDS.format("text")}) AS n FROM chunks)
        SELECT doc_id, count(*) AS n_chunks, sum(n) AS n_tokens, round_even(avg(n), 3) AS mean_tokens, max(n) AS max_tokens FROM t GROUP BY doc_id
    """,
    "id_roundtrip": r"""
        WITH h AS (SELECT DISTINCT hit_id, chunk_id, doc_id, section FROM hits),
        g AS (SELECT chunk_id, count(*) AS n, min(doc_id) AS d, min(section) AS s, regexp_extract(chunk_id, '^(.+?)#S(.*)#c(\d{2,})$', 1) AS a, regexp_extract(chunk_id, '^(.+?)#S(.*)#c(\d{2,})$', 2) AS b FROM h GROUP BY chunk_id)
        SELECT chunk_id, CASE WHEN n > 1 THEN 'repeated' WHEN a = '' THEN 'malformed' ELSE 'inconsistent' END AS problem, n FROM g WHERE n > 1 OR a = '' OR a <> d OR b <> s
    """,
    "paragraph_rows": r"""
        WITH p AS (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\n[ \t\n\r\f\v]*\n'), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS p FROM documents),
        f AS (SELECT doc_id, list_filter(p, lambda x: x <> '' AND NOT (starts_with(x, '#') AND len(string_split(x, ' ')) < 8)) AS f FROM p)
        SELECT doc_id, unnest(range(1, len(f) + 1)) AS para_no, length(unnest(f)) AS n_chars FROM f
    """,
    "cosine_topk": _TOPK.format(score="list_dot_product(qv::DOUBLE[], embedding::DOUBLE[])", digits=6, where="", k=10),
    "allowlisted_topk": _TOPK.format(score="list_dot_product(qv::DOUBLE[], embedding::DOUBLE[])", digits=6, where="WHERE label IN (0, 2, 4)", k=5),
    "distance_topk": _TOPK.format(score="-list_sum(list_transform(list_zip(qv, embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))", digits=5, where="", k=5),
    "best_in_pool": """
        SELECT query_id, doc_id, hit_id, score, pool FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, hit_id) AS r, count(*) OVER (PARTITION BY query_id, doc_id) AS pool
            FROM (SELECT DISTINCT * FROM hits WHERE score IS NOT NULL)) WHERE r = 1
    """,
    "facet_fusion": f"WITH {_FUSED} SELECT query_id, facet, chunk_id, depth, rank_no FROM fused",
    "budget_pack": f"""
        WITH h AS (SELECT DISTINCT hit_id, query_id, score, len({_WORDS.format("text")}) AS n_words FROM hits),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, hit_id) AS place FROM h),
        r AS (SELECT *, sum(n_words) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS running FROM p)
        SELECT query_id, hit_id, place, n_words, running FROM r WHERE running <= 1000 OR place = 1
    """,
    "lexical_topk": """
        WITH c AS (SELECT DISTINCT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM chunks),
        q AS (SELECT DISTINCT rtm_id, unnest(list_distinct(regexp_extract_all(lower(statement), '[a-z]{4,}'))) AS w FROM rtm WHERE rtm_id % 20 = 0),
        s AS (SELECT rtm_id, chunk_id, count(*) AS overlap FROM c JOIN q USING (w) GROUP BY ALL)
        SELECT rtm_id, chunk_id, overlap, row_number() OVER (PARTITION BY rtm_id ORDER BY overlap DESC, chunk_id) AS rank_no FROM s QUALIFY rank_no <= 5
    """,
    "hashed_embedding": """
        WITH w AS (SELECT DISTINCT rtm_id, statement FROM rtm), t AS (SELECT rtm_id, unnest(regexp_extract_all(lower(coalesce(statement, '')), '[a-z]{3,}')) AS w FROM w)
        SELECT rtm_id, CAST(('0x' || substr(md5(w), 31, 2))::INT AS INT) AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL
    """,
    "evidence": f"""
        WITH {_FUSED}, z AS (SELECT DISTINCT chunk_id, len({_WORDS.format("text")}) AS n_words FROM chunks),
        r AS (SELECT query_id, rank_no, facet, chunk_id, n_words, sum(coalesce(n_words, 0)) OVER (PARTITION BY query_id ORDER BY rank_no ROWS UNBOUNDED PRECEDING) AS running,
                     row_number() OVER (PARTITION BY query_id ORDER BY rank_no) AS k FROM fused LEFT JOIN z USING (chunk_id))
        SELECT query_id, rank_no, facet, chunk_id, n_words, running FROM r WHERE running <= 1000 OR k = 1
    """,
}
