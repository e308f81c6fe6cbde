"""Personal data and injected instructions in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.session import running_numbers

PATTERNS = [(kind, re.compile(p), g) for kind, p, g in V.PERSONAL]
SPAN = "array<struct<start:int,neg_size:int,ord:int,kind:string,stop:int,value:string>>"


def spans_of(text: str | None) -> list[dict]:
    """SEC-1: candidates of personal data with their places, before checks of digits and overlaps."""
    found = []
    for order, (kind, pattern, group) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            a, b = m.span(group)
            found.append({"start": a, "neg_size": a - b, "ord": order, "kind": kind, "stop": b, "value": m.group(group)})
    return found


def checked(span: Column) -> Column:
    """Whether a span's digits pass the check of its kind."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    card = F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    return F.when(span["kind"] == "DEA", T.weighted_check(digits)).when(span["kind"] == "NPI", T.prefixed_luhn(digits)).when(span["kind"] == "CARD", card).otherwise(True)


def resolved(spans: Column) -> Column:
    """SEC-2: spans that begin at or after the end of the last one kept; at equal starts the longer, then the kind's order."""
    start = F.struct(F.lit(-1).alias("stop"), F.array().cast(SPAN).alias("kept"))
    return F.aggregate(
        F.array_sort(F.filter(spans, checked)), start,
        lambda s, x: F.struct(F.when(x["start"] >= s["stop"], x["stop"]).otherwise(s["stop"]).alias("stop"), F.when(x["start"] >= s["stop"], F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept")),
        lambda s: s["kept"],
    )


def personal_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """SEC-1 and SEC-2: key, text and spans (resolved) of every row; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("neg_size", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("stop", pa.int32()), ("value", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([spans_of(x) for x in batch.column(1).to_pylist()], kind)], names=["_key", "_text", "spans"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, _text string, spans {SPAN}").select(F.col("_key").alias(key), F.col("_text").alias("text"), resolved(F.col("spans")).alias("spans"))


def vault(spans: DataFrame, key: str) -> DataFrame:
    """SEC-4 and WIN-4: kind, value, token: one stable token for each value, numbered by kind in order of first appearance.

    Order is that of the key and the place in its text. A kind may have any number of values (see running_numbers).
    """
    first = spans.select(F.col(key).alias("k"), F.explode("spans").alias("s")).groupBy("s.kind", "s.value").agg(F.min(F.struct("k", "s.start")).alias("first"))
    numbered = running_numbers(first, "kind", ["first", "value"], "n")
    return numbered.select("kind", "value", F.concat(F.lit("["), F.col("kind"), F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("token"))


def masked(spans: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """SEC-3: key and masked text, each span replaced by its token. Rows without a span are unchanged."""
    named = spans.select(F.col(key).alias("k"), F.posexplode("spans").alias("pos", "s")).select("k", "pos", "s.start", "s.stop", "s.kind", "s.value").join(tokens, ["kind", "value"])
    lists = named.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "stop", "token"))).alias("m"))
    joined = spans.select(F.col(key).alias("k"), "text").join(lists, "k", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate("m", start, lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring("text", s["at"] + 1, x["start"] - s["at"]), x["token"]).alias("out")), lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    return joined.select(F.col("k").alias(key), F.when(F.col("m").isNull(), F.col("text")).otherwise(body).alias("masked"))


def leaked_kinds(spans: Column) -> Column:
    """SEC-5: the sorted distinct kinds of spans."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kind"])))


def injections(text: Column) -> Column:
    """SEC-6: array<struct<kind, severity, match>> of suspicious instructions, by pattern and then by place."""
    t = F.coalesce(text, F.lit(""))

    def all_of(pattern: str, kind: str, level: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("severity"), m.alias("match")))

    return F.concat(*[all_of(*x) for x in V.INJECTIONS])


def quarantined(text: Column) -> Column:
    """SEC-7: the text's sentences by line, those with a high finding replaced by a fixed note."""
    high = "|".join(f"(?:{p})" for p, _, level in V.INJECTIONS if level == "high")
    return F.array_join(F.transform(T.sentences(text), lambda s: F.when(s.rlike(high), F.lit(V.QUARANTINE_NOTE)).otherwise(s)), "\n")


def spotlight(source: Column, text: Column) -> Column:
    """SEC-8: the text between markers that hold ten digits of its own hash."""
    mark = F.substring(F.sha2(F.concat(source.cast("string"), F.lit("\n"), text).cast("binary"), 256), 1, 10)
    return F.concat(F.lit("<<UNTRUSTED source="), source.cast("string"), F.lit(" id="), mark, F.lit(">>\n"), text, F.lit("\n<<END UNTRUSTED id="), mark, F.lit(">>"))
