"""Queries of the training-data problems, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import consensus, leakage, neardup, splitting, stuffing, tokenids
from docmill.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hits that the splitting operator cuts into pieces."""
    return splitting.split_oversized(read_table(spark, folder, "hits"), "hit_id", "text", "heading").select("hit_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized hit."""
    return splitting.split_oversized(read_table(spark, folder, "hits"), "hit_id", "text", "heading")


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of every oversized hit: its words, whether all pieces fit, and whether all but the first repeat 120 words and no word is lost."""
    p = p1_pieces(spark, folder).withColumn("own", F.col("start_word") + F.col("n_words") - F.col("new_word"))
    repeats = F.when(F.col("piece_no") == 1, F.col("new_word") == F.col("start_word")).otherwise(F.col("new_word") - F.col("start_word") == splitting.OVERLAP)
    g = p.groupBy("hit_id").agg(F.max(F.col("start_word") + F.col("n_words")).alias("n_words"), F.bool_and(F.col("n_words") <= splitting.LIMIT).alias("fits"), F.bool_and(repeats).alias("repeats"), F.sum("own").alias("own"))
    return g.select("hit_id", F.col("n_words").cast("long").alias("n_words"), "fits", (F.col("repeats") & (F.col("own") == F.col("n_words"))).alias("overlaps"))


#: Jaccard similarity of two rows' words from which they are near-duplicates in this project's data.
ALIKE = 0.7


def _alike(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(read_table(spark, folder, "rtm"), "rtm_id", ["statement", "acceptance_criteria"], ALIKE)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of near-duplicate rows of rtm."""
    return neardup.pairs(*_alike(spark, folder)).select(F.col("key_a").alias("rtm_id_a"), F.col("key_b").alias("rtm_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of rtm with its class of equal word sets, its group and its class's number of links."""
    members, links = _alike(spark, folder)
    return neardup.groups(links, members).withColumnRenamed("key", "rtm_id")


ITEM = ["req_id", "attribute"]


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    sources = {"rule_set": F.col("rule_score"), "llm_model": F.col("llm_score"), "adjudicator": consensus.verdict(F.col("human_adjudication"))}
    return consensus.votes(read_table(spark, folder, "validation_29148"), "score_id", ITEM, sources)


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(_votes(spark, folder), ITEM)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose agreed verdict is "not met"."""
    return p4_verdicts(spark, folder).where("verdict = 0").select("req_id", "attribute")


def p4_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict and agreement of every item."""
    return _consensus(spark, folder)[0]


def p4_annotators(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of every rule set, model and adjudicator."""
    return _consensus(spark, folder)[1].join(read_table(spark, folder, "annotators").select(F.col("annotator_id").alias("annotator"), "kind").distinct(), "annotator", "left")


def p4_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How far all labels agree beyond chance."""
    return consensus.overall_agreement(_votes(spark, folder), ITEM)


def p4_unread(spark: SparkSession, folder: str) -> DataFrame:
    """Wordings of adjudications that hold no verdict, with their numbers."""
    return consensus.unread(read_table(spark, folder, "validation_29148").dropDuplicates(["score_id"]), "human_adjudication")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenids.token_ids(read_table(spark, folder, "documents"), "doc_id", "text")


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text after encoding and decoding."""
    return tokenids.token_text(p6_ids(spark, folder), "doc_id", "ids")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat at least half of an evaluation text."""
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the share of the item's words and the number of parts."""
    return leakage.leaked_items(read_table(spark, folder, "documents"), "doc_id", "text", read_table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of keywords, links or tags instead of sentences."""
    return stuffing.page_fillers(read_table(spark, folder, "documents"), "doc_id", "text").where("stuffed").select("doc_id")


def p8_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages, units and words each shape of the corpus has."""
    return (
        stuffing.line_shapes(read_table(spark, folder, "documents"), "doc_id", "text")
        .groupBy("kind", "shape")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_units").alias("n_units"), F.sum("n_words").alias("n_words"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p2_groups, p4_found, p4_verdicts, p4_annotators, p4_agreement, p4_unread, p6_ids, p6_text, p7_found, p7_leaks, p8_found, p8_shapes)}
