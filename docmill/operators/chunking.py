"""Sections, windows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.session import running_numbers


def paragraph_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-13 and WIN-1: key, para_no (from 1), paragraph; texts without a paragraph give no row."""
    return df.select(key, F.posexplode(T.paragraphs(F.col(text))).alias("para_no", "paragraph")).withColumn("para_no", F.col("para_no") + 1)


def window_rows(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """TXT-9: key, n_tokens, window_no (from 0), start, window_tokens, window_text of every text that has tokens."""
    tokens = df.select(key, T.words(F.col(text)).alias("_t")).withColumn("n_tokens", F.size("_t")).where("n_tokens > 0")
    cut = tokens.select(key, "n_tokens", "_t", F.posexplode(T.windows(F.col("n_tokens"), size, overlap)).alias("window_no", "start"))
    part = F.slice("_t", F.col("start") + 1, F.lit(size))
    return cut.select(key, "n_tokens", "window_no", "start", F.size(part).alias("window_tokens"), F.array_join(part, " ").alias("window_text"))


def chunk_numbers(sections: DataFrame, doc: str, section: str, order: str, text: str, size: int = 800, overlap: int = 120, least: int = 60, floor: int = 20) -> DataFrame:
    """TXT-10 without the text: doc, section, order, window_no, start, chunk_no, chunk_id, token_count of the chunks that are kept.

    Windows under `floor` tokens are dropped, those under `least` only where the section has several. chunk_no counts
    kept chunks of a document over its sections, by ranges of the order, so a document that holds a large share of the
    sections isn't gathered. Sections delivered several times count once; no text is shuffled.
    """
    rows = window_rows(sections.select(F.struct(F.col(doc).alias("doc"), F.col(section).alias("section"), F.col(order).alias("ord")).alias("_s"), text), "_s", text, size, overlap)
    kept = rows.where((F.col("window_tokens") >= floor) & ((F.col("n_tokens") <= size) | (F.col("window_tokens") >= least)))
    narrow = kept.select("_s.doc", "_s.ord", "_s.section", "window_no", "start", "window_tokens").distinct()
    out = running_numbers(narrow, "doc", ["ord", "section", "window_no"], "chunk_no")
    ident = F.concat(F.col("doc").cast("string"), F.lit("#S"), F.col("section").cast("string"), F.lit("#c"), F.format_string("%02d", "chunk_no"))
    return out.select(F.col("doc").alias(doc), F.col("section").alias(section), F.col("ord").alias(order), "window_no", "start", "chunk_no", ident.alias("chunk_id"), F.col("window_tokens").alias("token_count"))


def chunk_rows(sections: DataFrame, doc: str, section: str, order: str, text: str, size: int = 800, overlap: int = 120, least: int = 60, floor: int = 20) -> DataFrame:
    """TXT-10: doc, section, start, chunk_no, chunk_id, token_count, chunk_text of the chunks that are kept; see chunk_numbers."""
    numbers = chunk_numbers(sections, doc, section, order, text, size, overlap, least, floor)
    numbers = numbers.select(F.struct(F.col(doc).alias("doc"), F.col(section).alias("section"), F.col(order).alias("ord")).alias("_s"), *[F.col(c) for c in ("window_no", "start", "chunk_no", "chunk_id", "token_count")])
    rows = window_rows(sections.select(F.struct(F.col(doc).alias("doc"), F.col(section).alias("section"), F.col(order).alias("ord")).alias("_s"), text), "_s", text, size, overlap)
    met = numbers.join(rows.select("_s", "window_no", "window_text").dropDuplicates(["_s", "window_no"]), ["_s", "window_no"])
    return met.select(F.col("_s.doc").alias(doc), F.col("_s.section").alias(section), "start", "chunk_no", "chunk_id", "token_count", F.col("window_text").alias("chunk_text"))


def id_problems(chunks: DataFrame, chunk_id: str, doc: str, section: str) -> DataFrame:
    """TXT-12: chunk_id, problem (repeated, malformed or inconsistent) and n of ids that are not unique or don't round-trip."""
    parts = [F.regexp_extract(chunk_id, r"^(.+?)#S(.*)#c(\d{2,})$", k) for k in (1, 2)]
    one = chunks.groupBy(chunk_id).agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("_d"), F.min(section).alias("_s"))
    problem = F.when(F.col("n") > 1, "repeated").when(parts[0] == "", "malformed").when((parts[0] != F.col("_d")) | (parts[1] != F.col("_s")), "inconsistent")
    return one.select(chunk_id, problem.alias("problem"), "n").where("problem is not null")


def marked_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC-3: key, section_no, section, heading, body of a text whose sections begin with lines "### id | heading"."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n")), r"\n### "), lambda b: b.contains("|"))
    rows = df.select(key, F.posexplode(blocks).alias("section_no", "_b"))
    head = F.substring_index("_b", "\n", 1)
    body = F.regexp_replace(F.when(F.instr("_b", "\n") > 0, F.expr("substr(_b, instr(_b, '\n') + 1)")).otherwise(""), r"^\s+|\s+$", "")
    return rows.select(key, "section_no", F.trim(F.substring_index(head, "|", 1)).alias("section"), F.trim(F.expr("substr(substring_index(_b, '\n', 1), instr(_b, '|') + 1)")).alias("heading"), body.alias("body")).where("body <> ''")


def designator_groups(paragraphs: Column) -> Column:
    """TXT-4: groups of paragraphs by (a), (b) …: a paragraph opens a group only if its letter is the next expected one.

    Gives array<struct<letter, paras>>; paragraphs before the first designator form a group with a null letter.
    """
    letter = lambda p: F.regexp_extract(p, r"^\s*\(([a-z])\)", 1)
    start = F.struct(F.lit("a").alias("next"), F.array().cast("array<struct<letter:string,paras:array<string>>>").alias("groups"))

    def step(state: Column, p: Column) -> Column:
        groups = state["groups"]
        opens = letter(p) == state["next"]
        fresh = F.concat(groups, F.array(F.struct(F.when(opens, letter(p)).alias("letter"), F.array(p).alias("paras"))))
        n = F.size(groups)
        last = F.get(groups, n - 1)
        grown = F.concat(F.slice(groups, 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["letter"].alias("letter"), F.concat(last["paras"], F.array(p)).alias("paras"))))
        following = F.when(opens, F.chr((F.ascii(state["next"]) + 1).cast("long"))).otherwise(state["next"])
        return F.struct(following.alias("next"), F.when(opens | (n == 0), fresh).otherwise(grown).alias("groups"))

    return F.aggregate(paragraphs, start, step, lambda s: s["groups"])


def merged_groups(groups: Column, target: int) -> Column:
    """TXT-5: neighbouring groups merged while their tokens stay within the target: array<struct<first, last, tokens, text>>."""
    size = lambda g: F.size(T.words(F.array_join(g["paras"], "\n")))
    kind = "array<struct<first:string,last:string,tokens:int,text:string>>"

    def step(done: Column, g: Column) -> Column:
        n, last = F.size(done), F.get(done, F.size(done) - 1)
        one = F.struct(g["letter"].alias("first"), g["letter"].alias("last"), size(g).alias("tokens"), F.array_join(g["paras"], "\n").alias("text"))
        both = F.struct(F.coalesce(last["first"], g["letter"]).alias("first"), g["letter"].alias("last"), (last["tokens"] + size(g)).alias("tokens"), F.concat_ws("\n", last["text"], F.array_join(g["paras"], "\n")).alias("text"))
        fits = (n > 0) & (last["tokens"] + size(g) <= target)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(one))).cast(kind)

    return F.aggregate(groups, F.array().cast(kind), step)
