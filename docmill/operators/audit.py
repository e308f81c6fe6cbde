"""Verification of citations and quotes against a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.session import cut, lookup_join


def cited(text: Column) -> Column:
    """HAL-1, FN-S6: array<struct<pos, kind, entity, lookup>> of code sections, bare sections, standards and resource names, in order."""

    def all_of(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))

    def entries(kind: str, names: Column, lookups: Column) -> Column:
        return F.transform(F.arrays_zip(names.alias("n"), lookups.alias("l")), lambda x: F.struct(F.lit(kind).alias("kind"), x["n"].alias("entity"), x["l"].alias("lookup")))

    section, bare = all_of(V.CFR, 2), all_of(V.SECTION, 1)
    code = F.zip_with(all_of(V.CFR, 1), section, lambda a, b: F.concat(a, F.lit(" CFR "), b))
    standard = F.zip_with(all_of(V.STANDARD, 1), all_of(V.STANDARD, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    camel = all_of(V.CAMEL, 1)
    base = lambda s: F.lower(F.substring_index(s, "(", 1))
    found = F.concat(
        entries("cfr_citation", code, F.transform(section, base)), entries("cfr_citation", F.transform(bare, lambda s: F.concat(F.lit("§ "), s)), F.transform(bare, base)),
        entries("standard", standard, F.transform(standard, T.normal)), entries("fhir_resource", camel, F.transform(camel, F.lower)),
    )
    return F.transform(found, lambda x, i: F.struct(i.alias("pos"), x["kind"].alias("kind"), x["entity"].alias("entity"), x["lookup"].alias("lookup")))


def citation_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, kind, entity, lookup and context of each citation once per row, without regard to case but for resource names.

    context says that a row speaks of interchange resources: by name, by the words FHIR or resource.
    """
    rows = df.select(F.col(key).alias("k"), cited(text).alias("c"), F.coalesce(text.rlike(r"(?i)\bFHIR\b|\bresource\b"), F.lit(False)).alias("said"))
    known = F.array(*[F.lit(r) for r in V.RESOURCES])
    context = F.col("said") | F.exists("c", lambda x: (x["kind"] == "fhir_resource") & F.array_contains(known, x["entity"]))
    same = lambda x: F.when(x["kind"] == "fhir_resource", x["entity"]).otherwise(F.lower(x["entity"]))
    rows = rows.withColumn("s", F.array_sort(F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), same(x).alias("same"), x["pos"].alias("pos"), x["entity"].alias("entity"), x["lookup"].alias("lookup")))))
    last = lambda i: F.get(F.col("s"), i - 1)
    first = F.filter("s", lambda x, i: (i == 0) | (last(i)["kind"] != x["kind"]) | (last(i)["same"] != x["same"]))
    return rows.select("k", context.alias("context"), F.explode(first).alias("x")).select(F.col("k").alias(key), "context", "x.kind", "x.entity", "x.lookup")


#: Strings that one automaton searches for at once; more are searched in blocks, each a pass over the corpus.
NEEDLES = 200_000


def containing(corpus: DataFrame, doc: str, text: Column, needles: DataFrame, needle: str) -> DataFrame:
    """needle and d: every corpus row (by its id d) whose text contains a needle anywhere, each pair once.

    One narrow pass over the corpus for each NEEDLES distinct needles: an automaton of all of them reads every text
    once, and only ids leave the pass. Null and empty needles and null texts match nothing.
    """
    import ahocorasick

    wanted = cut(needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct())
    blocks = -(-wanted.count() // NEEDLES)
    rows = corpus.select(F.col(doc).alias("d"), text.alias("t")).where("d is not null and t is not null")
    kind = rows.schema["d"].dataType.simpleString()
    found = None
    for block in range(blocks):
        part = [r["needle"] for r in wanted.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).collect()]  # about NEEDLES

        def search(batches: Iterator[pa.RecordBatch], part: list[str] = part) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for k, w in enumerate(part):
                machine.add_word(w, k)
            machine.make_automaton()
            for batch in batches:
                at, which = [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    hits = {k for _, k in machine.iter(t)}
                    at += [row] * len(hits)
                    which += [part[k] for k in hits]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=["needle", "d"])

        one = rows.mapInArrow(search, f"needle string, d {kind}")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.select(F.lit("").alias("needle"), "d").where("false")
    return found.distinct()


def corpus_presence(lookups: DataFrame, corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """HAL-2 to HAL-4, TXT-15: lookup and n_docs, the number of corpus rows whose normalised text contains it; 0 if none.

    Containment is that of characters, so parts of longer words count: 164.30 is found in 164.308. Corpus rows
    delivered several times count once, by their id.
    """
    wanted = lookups.select("lookup").where("lookup <> ''").distinct()
    hits = containing(corpus, doc, T.normal(F.col(text)), wanted, "lookup").groupBy(F.col("needle").alias("lookup")).agg(F.count(F.lit(1)).alias("n_docs"))
    return wanted.join(hits, "lookup", "left").select("lookup", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def severity(verdict: Column, critical: Column) -> Column:
    """HAL-7."""
    return (
        F.when(verdict == "fabricated", F.when(critical, "high").otherwise("medium")).when(verdict == "misattributed", "medium").when(verdict == "unverifiable", "low").otherwise("none")
    )


def citation_verdicts(rows: DataFrame, presence: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """HAL-2 to HAL-4: verdict of each citation from the presence of its lookup in the corpus.

    A present one is verified. An absent section of a part that the corpus holds is fabricated; an absent resource
    name too, if the row speaks of resources and the name isn't a known one. All other absent ones are unverifiable,
    and absent unknown names outside such a context are no citations.
    """
    joined = lookup_join(rows, presence, "lookup")
    there = F.coalesce(F.col("n_docs") > 0, F.lit(False))
    known = F.col("entity").isin(V.RESOURCES)
    part = F.substring_index("lookup", ".", 1)
    verdict = (
        F.when(there, "verified").when((F.col("kind") == "cfr_citation") & part.isin(parts or V.CORPUS_PARTS), "fabricated").when((F.col("kind") == "fhir_resource") & ~known, "fabricated").otherwise("unverifiable")
    )
    return joined.where((F.col("kind") != "fhir_resource") | there | known | F.col("context")).withColumn("verdict", verdict)


#: Letters of a seed, and seeds of which the smallest stands for all: any quote of at least both together shares one with its source.
SEED, WINDOW = 12, 32
#: Places of the filter that seeds of quotes leave for the corpus: a fixed size.
FILTER = 1 << 20


def _seeds(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Columns but the last, seed and pos (from 0) of the seeds of each text: the smallest hash of each WINDOW runs of SEED letters."""
    for batch in batches:
        at, seeds, places = [], [], []
        for row, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            b = np.frombuffer(t.encode(), np.uint8).astype(np.uint64)
            n = len(b) - SEED + 1
            if n < WINDOW:
                continue
            h = np.zeros(n, np.uint64)
            for k in range(SEED):
                h = h * np.uint64(0x9E3779B97F4A7C15) + b[k : k + n]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            first = np.unique(np.arange(n - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1))
            if wanted is not None:
                first = first[wanted[(h[first] & np.uint64(FILTER - 1)).astype(np.int64)]]
            at.append(np.full(len(first), row))
            seeds.append(h[first].view(np.int64))
            places.append(first.astype(np.int32))
        rows = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
        kept = [batch.column(k).take(rows) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(seeds) if at else [], pa.int64()), pa.array(np.concatenate(places) if at else [], pa.int32())], names=[*batch.schema.names[:-1], "seed", "pos"])


def quote_verdicts(quotes: DataFrame, key: str, quote: str, cites: str, chunks: DataFrame, chunk_id: str, text: str, least: int = SEED) -> DataFrame:
    """HAL-5: key and verdict of each quote, compared by letters and digits only.

    unverifiable if shorter than `least`; verified if a cited chunk holds it, misattributed if any other does, else
    fabricated. Every quote of all rows is searched for in every chunk: a long quote by its seed that the fewest chunks
    share (a seed that none has rules it out), its place there by a hash of what stands at it; a short one by an automaton.
    Quotes' texts don't travel, only their hashes. Null and empty quotes give no row; keys and chunks count once.
    """
    rows = quotes.select(F.col(key).alias("k"), T.only_words(F.col(quote)).alias("q"), F.col(cites).alias("c"), (F.length(F.trim(F.col(quote))) > 0).alias("some")).where("some and k is not null")
    asked = cut(rows.select("k", "c", F.xxhash64("q").alias("qh"), F.length("q").alias("n")).dropDuplicates(["k"]))
    body = chunks.select(F.col(chunk_id).alias("id"), T.only_words(F.col(text)).alias("body")).where(F.length("body") >= least)
    kind = body.schema["id"].dataType.simpleString()
    long = SEED + WINDOW - 1

    own_seeds = cut(rows.where(F.length("q") >= long).select(F.xxhash64("q").alias("qh"), F.length("q").alias("n"), "q").mapInArrow(_seeds, "qh long, n int, seed long, pos int").distinct())
    wanted = np.zeros(FILTER, bool)
    for r in own_seeds.select(F.expr(f"seed & {FILTER - 1}").alias("p")).distinct().collect():  # at most FILTER
        wanted[r["p"]] = True
    held = cut(body.where(F.length("body") >= long).mapInArrow(lambda it: _seeds(it, wanted), f"id {kind}, seed long, pos int").distinct())
    numbers = held.groupBy("seed").agg(F.countDistinct("id").alias("docs"))
    rated = lookup_join(own_seeds, numbers, "seed").withColumn("docs", F.coalesce("docs", F.lit(0)))
    best = rated.groupBy("qh", "n").agg(F.min_by(F.struct("docs", "seed", "pos"), F.struct("docs", "seed", "pos")).alias("b")).where("b.docs > 0")
    best = best.select("qh", "n", "b.seed", F.col("b.pos").alias("offset"))
    places = best.join(held, "seed").select("id", "qh", "n", (F.col("pos") - F.col("offset")).alias("at")).where("at >= 0").distinct()
    hits = places.join(body, "id").where(F.xxhash64(F.substring("body", F.col("at") + 1, F.col("n"))) == F.col("qh")).select("qh", "id")

    short = rows.where(F.length("q").between(least, long - 1)).select("q").distinct()
    brief = containing(body, "id", F.col("body"), short, "q").select(F.xxhash64("needle").alias("qh"), F.col("d").alias("id"))
    hits = cut(hits.unionByName(brief).distinct())

    cited = asked.where(F.col("n") >= least).select("k", F.explode("c").alias("id"), "qh").select("k", F.struct("qh", "id").alias("pair")).distinct()
    own = lookup_join(cited, hits.select(F.struct("qh", "id").alias("pair"), F.lit(True).alias("own")), "pair").where("own").select("k", "own").distinct()
    anywhere = lookup_join(asked.select("k", "qh", "n"), hits.select("qh").distinct().withColumn("there", F.lit(True)), "qh")
    verdict = F.when(F.col("n") < least, "unverifiable").when(F.col("own"), "verified").when(F.col("there"), "misattributed").otherwise("fabricated")
    return anywhere.join(own, "k", "left").select(F.col("k").alias(key), verdict.alias("verdict"))


def unknown_ids(df: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """JOIN-4, HAL-6: key and id of every cited id that the register doesn't hold, each once."""
    rows = df.select(F.col(key), F.explode(F.array_distinct(ids)).alias("id")).where("id <> ''")
    there = known.select(F.col(known_id).alias("id")).distinct().withColumn("_there", F.lit(True))
    return lookup_join(rows, there, "id").where("_there is null").select(key, "id").distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-5: the first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
