"""Readers and writers of files, with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "chunk_id string, doc_id string, section string, heading string, text string, token_count int"
CALL = "event string, call_id string, model_key string, prompt string, text string, latency_s double, prompt_tokens int, completion_tokens int, attempts int, created_at string, tag string, error string"
#: Columns never shown outside.
HIDDEN = ("fact_ids",)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: chunks from JSON lines."""
    return spark.read.schema(CHUNK).json(path)


def read_log(spark: SparkSession, path: str, schema: str = CALL) -> tuple[DataFrame, DataFrame]:
    """SRC-8: (rows, broken) of a JSON-lines log; broken lines are kept apart, as text."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    names = [f.name for f in T.StructType.fromDDL(schema)]
    return parsed.where("r is not null and r._broken is null").select(*[F.col(f"r.{n}") for n in names]), parsed.where("r is null or r._broken is not null").select("value")


def read_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC-2: a CSV table of text columns, nulls as empty texts."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"').fillna("")


def read_csv_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-7, SRC-10: a CSV table, or an empty one of its schema if there is none."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-1: path, content, sha256 and bytes of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def verified(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """TXT-8: files with state ok, changed (another hash than in the manifest) or unlisted."""
    listed = manifest.select(key, F.col("sha256").alias("_listed"))
    state = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_listed") == F.col("sha256"), "ok").otherwise("changed")
    return files.join(listed, key, "left").withColumn("state", state).drop("_listed")


def flattened(df: DataFrame) -> DataFrame:
    """SNK-5: for flat files: arrays joined by semicolons, structs and maps as JSON, hidden columns left out."""
    out = []
    for f in df.schema.fields:
        if f.name in HIDDEN:
            continue
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str], protect: bool | None = None) -> None:
    """SNK-1, SNK-3: a CSV table of the columns in order; refuses to overwrite if protected (or PROTECT_OUTPUTS is 1)."""
    guarded = os.environ.get("PROTECT_OUTPUTS") == "1" if protect is None else protect
    flattened(df).select(*columns).write.mode("errorifexists" if guarded else "overwrite").csv(path, header=True, escape='"')


def write_lines(df: DataFrame, path: str) -> None:
    """SNK-2: appends rows as JSON lines."""
    df.write.mode("append").json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """SNK-6: chunk ids and vectors as Parquet, clustered by document, so that a source filter skips files."""
    chunks.select("doc_id", "chunk_id", "vector").repartitionByRange("doc_id", "chunk_id").sortWithinPartitions("doc_id", "chunk_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """SRC-11: the vectors of an index; an error if they are not as many as the chunks."""
    index = spark.read.parquet(path)
    n, m = index.count(), chunks.count()
    if n != m:
        raise ValueError(f"the index has {n} vectors for {m} chunks")
    return index


def write_step(df: DataFrame, folder: str, step: str) -> None:
    """SNK-7, STA-8: a step's result; the writer's success mark makes it complete."""
    df.write.mode("overwrite").parquet(f"{folder}/{step}")


def read_step(spark: SparkSession, folder: str, step: str) -> DataFrame | None:
    """STA-8: a step's result if it is complete, else None, so that the step is run again."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{step}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    return spark.read.parquet(f"{folder}/{step}") if there else None
