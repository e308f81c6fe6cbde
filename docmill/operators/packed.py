"""Problem 5: several values packed in one field.

Method: a cell is cut into atoms at every mark that may separate values; quoted spans are atomic. Whether neighbouring
atoms are one value or two is learned by expectation maximisation over the whole column: a value costs what its
frequency says, and one not seen often costs what its form says. A Viterbi lattice takes the likeliest reading of each
cell.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import cut

#: What a cell holds when it merely says that there is nothing (compared in lower case).
NOTHING = frozenset(["", "-", "--", "–", "—", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "[]", "{}", "()", "not applicable", "keine", "."])
BLANK = " \t\r\n\v\f   -​    　﻿"
QUOTED = re.compile(r'"(?:[^"\\]|""|\\.)*"|“[^”]*”|«[^»]*»|`[^`]*`')
#: A list mark at the start of a line.
BULLET = re.compile(r"(?m)^[ \t ]*(?:[-*•‣◦▪–—·]|\(?\d{1,2}[.)])[ \t ]+")
#: Marks that always separate (outside quotes), and those that only may.
HARD = re.compile(r"[;；|｜\r\n\t]+|\|\|")
SOFT = re.compile(r"[,，、]|\s/\s|/|\s(?:and|und|et|&)\s", re.I)
TRIM = re.compile(f"^[{BLANK}]+|[{BLANK}]+$")
#: A value's form: digits, capitals and letters by kind, runs as one.
FORM = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-ZÀ-Þ]+"), "A"), (re.compile(r"[a-zß-ÿ]+"), "a"))
#: Weight of a value's form against its own frequency; rounds of expectation maximisation at most, and the change of the
#: model (total variation of each field's forms and values, against any model before) at which they end.
FORM_WEIGHT, ROUNDS, SETTLED = 0.5, 30, 1e-3
#: The model holds the values and forms of at least this share of a field's; so it has a bounded size, and a cell is read
#: alike however many other values the column has.
SHARE = 1 / 20_000
UNSEEN = 1e-9
#: Atoms that a value may span although no settled value of the field has as many; more are joined only if one has.
WIDEST = 4


def _trim(text: str) -> str:
    return TRIM.sub("", text)


@lru_cache(1 << 16)
def _unquote(text: str) -> str:
    """A value without enclosing quotes or brackets; doubled and escaped quotes inside once."""
    text = _trim(text)
    for _ in range(3):
        if len(text) > 1 and (text[0], text[-1]) in (('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("`", "`"), ("‘", "’")):
            inner = text[1:-1]
            if text[0] in "\"'":
                inner = inner.replace("\\" + text[0], text[0]).replace(text[0] * 2, text[0])
            text = _trim(inner)
        elif len(text) > 1 and (text[0], text[-1]) in (("[", "]"), ("{", "}")):
            text = _trim(text[1:-1])
        else:
            break
    return text


def _listed(text: str) -> list[str] | None:
    """Members of a cell that is a JSON or Python list, else None."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(found, list) and not any(isinstance(x, (list, dict, tuple, set)) for x in found):
            return ["" if x is None else str(x) for x in found]
    return None


def atoms(cell: str | None) -> list[list[tuple[str, str]]]:
    """The stretches of a cell between sure separators, each as a list of (mark before, atom).

    Null, blank and empty cells, and those that say there is nothing, have none. A quoted span is never cut.
    """
    text = _trim(cell or "")
    if text.lower() in NOTHING:
        return []
    members = _listed(text)
    if members is not None:
        return [[("", m)] for m in (_unquote(x) for x in members) if m]
    if text[:1] in "[{" and text[-1:] in "]}":
        text = _trim(text[1:-1])
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x01"

    text = BULLET.sub("\n", QUOTED.sub(keep, BULLET.sub("\n", text)))

    def back(x: str) -> str:
        return re.sub("\x00(\\d+)\x01", lambda m: kept[int(m.group(1))], x)

    found = []
    for stretch in HARD.split(text):
        out, at, mark = [], 0, ""
        for m in SOFT.finditer(stretch):
            out.append((mark, stretch[at : m.start()]))
            at, mark = m.end(), m.group()
        out.append((mark, stretch[at:]))
        if any(_trim(x) for _, x in out):
            found.append([(k, back(x)) for k, x in out])
    return found


@lru_cache(1 << 16)
def form(value: str) -> str:
    """The form of a value."""
    for pattern, to in FORM:
        value = pattern.sub(to, value)
    return value if len(value) <= 80 else hashlib.md5(value.encode("utf-8", "replace")).hexdigest()


def _value(stretch: list[tuple[str, str]], a: int, b: int) -> str:
    """Atoms a to b of a stretch read as one value."""
    return _unquote(stretch[a][1] + "".join(k + x for k, x in stretch[a + 1 : b]))


def _best(stretch: list[tuple[str, str]], model: dict[str, float] | None, widest: int = WIDEST) -> list[str]:
    """The likeliest values of a stretch; without a model every mark separates."""
    n = len(stretch)
    if n == 1 or model is None:
        return [v for k in range(n) if (v := _value(stretch, k, k + 1))]
    cost, cut = [0.0] + [math.inf] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        for a in range(max(0, b - widest), b):
            v = _value(stretch, a, b)
            if not v:
                c = 0.0 if b - a == 1 else math.inf
            else:
                own = model.get("v" + v, 0.0) * (1 - FORM_WEIGHT) + model.get("f" + form(v), 0.0) * FORM_WEIGHT
                c = -math.log(max(own, UNSEEN))
            if cost[a] + c < cost[b]:
                cost[b], cut[b] = cost[a] + c, a
    out, b = [], n
    while b:
        if v := _value(stretch, cut[b], b):
            out.append(v)
        b = cut[b]
    return out[::-1]


MARK, ATOM = "\x02", "\x01"
STRETCH = "array<struct<soft:boolean,text:string,marks:int>>"


def _packed(stretch: list[tuple[str, str]]) -> dict:
    """A stretch as a row: a settled value, or marks and atoms to be read; marks are those within a settled value."""
    if len(stretch) == 1:
        value = _value(stretch, 0, 1)
        return {"soft": False, "text": value, "marks": len(SOFT.findall(value))}
    return {"soft": True, "text": ATOM.join(k + MARK + x for k, x in stretch), "marks": 0}


def _loose(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(MARK, 1)) for x in text.split(ATOM)]


def _counted(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    """field, k, n: how often each value (v) and form (f) is read in rows of field, text, n."""
    for batch in batches:
        seen: Counter = Counter()
        for f, text, n in zip(*(c.to_pylist() for c in batch.columns)):
            for v in read(f, text):
                seen[f, "v" + v] += n
                seen[f, "f" + form(v)] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["field", "k", "n"])


def _model(counts: DataFrame) -> dict[str, dict[str, float]]:
    """Values and forms of at least SHARE of each field's, with their shares."""
    sums = cut(counts.groupBy("field", "k").agg(F.sum("n").alias("n")).withColumn("kind", F.substring("k", 1, 1)))
    totals = sums.groupBy("field", "kind").agg(F.sum("n").alias("all"))  # two rows a field
    found: dict[str, dict[str, float]] = {}
    for r in sums.join(F.broadcast(totals), ["field", "kind"]).where(F.col("n") >= F.col("all") * SHARE).select("field", "k", (F.col("n") / F.col("all")).alias("p")).collect():  # 2 / SHARE a field at most
        found.setdefault(r["field"], {})[r["k"]] = r["p"]
    return found


def _moved(old: dict[str, dict[str, float]], new: dict[str, dict[str, float]]) -> float:
    """The greatest total variation of a field's values or forms between two models."""
    most = 0.0
    for f in old.keys() | new.keys():
        a, b = old.get(f, {}), new.get(f, {})
        for kind in "vf":
            most = max(most, sum(abs(a.get(k, 0.0) - b.get(k, 0.0)) for k in a.keys() | b.keys() if k[0] == kind) / 2)
    return most


def unpack(df: DataFrame, key: str, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """key, field_name, pos and val: one row per value of the packed fields, pos counting from 1 in each cell.

    Rows delivered several times count once (by key). Null and blank cells, and those that merely say there is
    nothing, give no rows; empty members aren't counted; repeated values stay. Rows with a null key are left out.
    Cells are parsed once; the rounds read only distinct stretches with doubtful marks, each with its number. It is an
    error if `rounds` rounds don't settle.
    """
    cells = df.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)]).where(F.col("_key").isNotNull())
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, "_key").dropDuplicates(["_key"])  # one shuffle, which isn't coalesced: what follows is work, not data
    pairs = ", ".join(f"'{f}', _{k}" for k, f in enumerate(fields))
    long = cells.selectExpr("_key", f"stack({len(fields)}, {pairs}) as (field, cell)").where("cell is not null")
    kind = cells.schema["_key"].dataType.simpleString()
    arrow = pa.list_(pa.struct([("soft", pa.bool_()), ("text", pa.string()), ("marks", pa.int32())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [[_packed(s) for s in atoms(cell)] for cell in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(read, arrow)], names=["_key", "field", "stretches"])

    parsed = cut(long.mapInArrow(parse, f"_key {kind}, field string, stretches {STRETCH}").where("size(stretches) > 0"))
    every = parsed.select("field", F.explode("stretches").alias("s")).groupBy("field", "s.soft", "s.text").agg(F.count(F.lit(1)).alias("n"), F.max("s.marks").alias("marks"))
    every = cut(every)
    wide = {r["field"]: max(WIDEST, r["m"] + 1) for r in every.groupBy("field").agg(F.max("marks").alias("m")).collect()}
    base = cut(every.where("not soft and text <> ''").select("field", "text", "n").mapInArrow(lambda it: _counted(it, lambda f, t: [t]), "field string, k string, n long").groupBy("field", "k").agg(F.sum("n").alias("n")))
    doubtful = every.where("soft").select("field", "text", "n").repartition(tasks, "text")
    doubtful = cut(doubtful)
    models, before = _model(base), []
    for _ in range(rounds):
        last = models
        before.append(last)
        read = doubtful.mapInArrow(lambda it, m=last: _counted(it, lambda f, t: _best(_loose(t), m.get(f, {}), wide[f])), "field string, k string, n long")
        models = _model(base.unionByName(read))
        if any(_moved(old, models) < SETTLED for old in before):  # settled, or come round to a model it had before
            break
    else:
        raise RuntimeError(f"the values of {fields} did not settle in {rounds} rounds; raise rounds")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[str]] = {}
        for batch in batches:
            at, pos, val = [], [], []
            for row, (f, stretches) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                values = []
                for s in stretches:
                    if not s["soft"]:
                        values += [s["text"]] if s["text"] else []
                        continue
                    if (f, s["text"]) not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[f, s["text"]] = _best(_loose(s["text"]), models.get(f, {}), wide[f])
                    values += known[f, s["text"]]
                at += [row] * len(values)
                pos += range(1, len(values) + 1)
                val += values
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(val, pa.string())], names=["_key", "field_name", "pos", "val"])

    return parsed.mapInArrow(split, f"_key {kind}, field_name string, pos int, val string").withColumnRenamed("_key", key)
