"""Readers of configuration, cases, transcripts and state, and writers of snapshots and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as TX
from docmill.sources.files import flattened


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text files, one row each."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-5, SRC-6: path and the fields of the schema of YAML files, one row for each file, or for each member of one that is a list.

    Fields that a file lacks are null; files that aren't YAML, or hold neither a mapping nor a list of them, give no row.
    """
    from collections.abc import Iterator

    import pandas as pd

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"]):
                try:
                    found = yaml.safe_load(content)
                except yaml.YAMLError:
                    continue
                for x in found if isinstance(found, list) else [found]:
                    if isinstance(x, dict):
                        rows.append((path_, json.dumps(x, default=str)))
            yield pd.DataFrame(rows, columns=["path", "body"])

    read = whole_texts(spark, path).mapInPandas(parse, "path string, body string")
    return read.select("path", F.from_json("body", schema).alias("x")).select("path", "x.*")


def case_documents(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """SRC-6: case_id, doc and text of the documents of cases (case_id, path, documents: array<struct<id, path, text>>).

    A document's own text counts, else that of the file its path names beside the case's file; null where there is neither.
    """
    docs = cases.select("case_id", F.regexp_replace("path", "[^/]*$", "").alias("folder"), F.explode("documents").alias("d"))
    docs = docs.select("case_id", F.col("d.id").alias("doc"), F.col("d.text").alias("own"), F.concat("folder", "d.path").alias("path"))
    return docs.join(texts.select("path", "content"), "path", "left").select("case_id", "doc", F.coalesce("own", "content").alias("text"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """SRC-9: the slots of a state kept as one JSON file, by a schema; None if there is none yet."""
    return spark.read.schema(schema).json(path, multiLine=True) if _exists(spark, path) else None


def read_transcripts(spark: SparkSession, path: str, masked: Column | None = None) -> DataFrame:
    """SRC-13: statement_id, source, question and text of interview transcripts (JSON files of {source, answers: [{question, answer}]}).

    Statements are numbered anew by source over all files, in order of file and answer; `masked` is applied to the text
    (column `text`) again. Unanswered questions are left out.
    """
    from docmill.session import running_numbers

    t = spark.read.schema("source string, answers array<struct<question:string,answer:string>>").json(path, multiLine=True)
    rows = t.select("source", F.col("_metadata.file_path").alias("file"), F.posexplode("answers").alias("pos", "a")).select("source", "file", "pos", "a.question", F.col("a.answer").alias("text")).where("trim(text) <> ''")
    numbered = running_numbers(rows, "source", ["file", "pos"], "n")
    ident = F.concat(F.lit("S-"), F.upper(TX.slug(F.col("source"))), F.lit("-"), F.format_string("%02d", "n"))
    return numbered.select(ident.alias("statement_id"), "source", "question", (F.col("text") if masked is None else masked).alias("text"))


def write_snapshot(tables: dict[str, DataFrame], folder: str, fresh: bool = False) -> list[str]:
    """SNK-4, SRC-10: replaces each table of a snapshot folder; one without rows is dropped, and with fresh all others too.

    Arrays, structs and maps are flattened as for CSV. A table is written beside the old one and then takes its place, so
    a lost job leaves the old snapshot. Returns the names of the tables kept.
    """
    kept = []
    for name, df in tables.items():
        spark = df.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        new, old = fs_path(f"{folder}/_new_{name}"), fs_path(f"{folder}/{name}")
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        empty = df.isEmpty()
        if not empty:
            flattened(df).write.mode("overwrite").parquet(new.toString())
            kept.append(name)
        fs.delete(old, True)
        if not empty:
            fs.rename(new, old)
    if fresh and tables:
        spark = next(iter(tables.values())).sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.isDirectory() and status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
    return kept


def read_snapshot(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """SRC-10: a table of a snapshot, or an empty one of its schema if there is none."""
    return spark.read.parquet(f"{folder}/{name}") if _exists(spark, f"{folder}/{name}") else spark.createDataFrame([], T.StructType.fromDDL(schema))


def run_manifest(spark: SparkSession, timings: dict[str, float], tables: dict[str, DataFrame], knowledge: DataFrame) -> DataFrame:
    """SNK-8, AGG-19: one row: seconds and minutes in all, seconds by step, rows and a digest by table, and a digest of the knowledge files.

    knowledge holds path and content. A table's digest is the sum of its rows' 64-bit hashes, so order doesn't matter; it
    is made by partial sums.
    """
    total = sum(timings.values())
    rows = None
    for name, df in tables.items():
        hashed = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
        one = df.select(hashed.cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "n", "digest")
        rows = one if rows is None else rows.unionByName(one)
    listed = F.array_sort(F.collect_list(F.struct("name", "n", "digest")))
    summary = rows.agg(listed.alias("tables")) if rows is not None else spark.range(1).select(F.array().cast("array<struct<name:string,n:bigint,digest:string>>").alias("tables"))
    prints = knowledge.select(F.concat_ws(":", F.regexp_extract("path", "[^/]*$", 0), F.sha2("content", 256)).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("knowledge"))  # a few files
    steps = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in timings.items()])) if timings else F.create_map().cast("map<string,double>")
    one = summary.withColumn("_j", F.lit(1)).join(prints.withColumn("_j", F.lit(1)), "_j")  # one row each
    return one.select(F.lit(round(total, 1)).alias("seconds"), F.lit(round(total / 60, 1)).alias("minutes"), steps.alias("steps"), "tables", "knowledge")
