"""Contracts that generated records and answers must keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.audit import unknown_ids
from docmill.session import lookup_join


@dataclass(frozen=True)
class Contract:
    """What a set of records must keep: form of ids, domains, filled fields, a word of duty, numbers of records by kind."""

    id_form: str
    domains: dict[str, list[str]] = field(default_factory=dict)
    filled: tuple[str, ...] = ()
    duty: tuple[str, str] | None = None
    least: int = 0
    most: int | None = None
    least_of: dict[str, int] = field(default_factory=dict)


def record_errors(df: DataFrame, group: str, key: str, ident: str, contract: Contract, cites: str, derived: Column, known: DataFrame, known_id: str) -> DataFrame:
    """PRJ-17: group, key, check_id and message of everything a record breaks; records without a fault give no row.

    check_id is id_form, duplicate (all but the smallest key of an id within a group), domain, empty, duty, unknown_source
    (once for each cited id that isn't known) or no_source (nothing known is cited and the record isn't derived). Null ids
    have no form and are no duplicates; rows with equal keys count once. The first five are one narrow pass.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(ident).alias("i"), F.array_distinct(F.coalesce(F.col(cites), F.array().cast("array<string>"))).alias("c"), F.coalesce(derived, F.lit(False)).alias("d"), *[F.col(x).cast("string").alias(f"f_{x}") for x in {*contract.domains, *contract.filled, *(contract.duty or ())[:1]}])
    rows = rows.where("k is not null").dropDuplicates(["k"])
    label = F.coalesce(F.nullif(F.trim("i"), F.lit("")), F.concat(F.lit("#"), F.col("k").cast("string")))
    error = lambda check, said: F.struct(F.lit(check).alias("check_id"), F.concat(label, F.lit(": "), F.lit(said)).alias("message"))
    found = [F.when(~F.coalesce(F.col("i").rlike(contract.id_form), F.lit(False)), error("id_form", "not an id of this form"))]
    found += [F.when(~F.coalesce(F.col(f"f_{x}").isin(names), F.lit(False)), error("domain", f"{x} is not one of {', '.join(sorted(names))}")) for x, names in contract.domains.items()]
    found += [F.when(F.coalesce(F.trim(f"f_{x}"), F.lit("")) == "", error("empty", f"{x} is empty")) for x in contract.filled]
    if contract.duty:
        x, word = contract.duty
        found.append(F.when(~F.coalesce(F.lower(f"f_{x}").contains(word), F.lit(False)), error("duty", f"{x} has no {word}")))
    plain = rows.select("g", "k", F.explode(F.array_compact(F.array(*found))).alias("e")).select("g", "k", "e.*")
    named = rows.where("i is not null").select("g", "k", "i", F.struct("g", "i").alias("id"))
    firsts = named.groupBy("id").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = lookup_join(named, firsts, "id").where("first <> k").select("g", "k", F.lit("duplicate").alias("check_id"), F.concat(label, F.lit(": the id is taken")).alias("message"))
    unknown = unknown_ids(rows, "k", "c", known, known_id)
    sides = rows.select("g", "k", "i", "d", F.size(F.filter("c", lambda x: x != "")).alias("n"))
    wrong = sides.join(unknown, "k").select("g", "k", F.lit("unknown_source").alias("check_id"), F.concat(label, F.lit(": unknown source "), F.col("id")).alias("message"))
    bare = sides.join(unknown.groupBy("k").agg(F.count(F.lit(1)).alias("u")), "k", "left").where("not d and n <= coalesce(u, 0)").select("g", "k", F.lit("no_source").alias("check_id"), F.concat(label, F.lit(": neither cited nor derived")).alias("message"))
    return plain.unionByName(twice).unionByName(wrong).unionByName(bare).select(F.col("g").alias(group), F.col("k").alias(key), "check_id", "message")


def set_sizes(df: DataFrame, group: str, key: str, kind: Column) -> DataFrame:
    """group, n and a map of kind to number of the records of each set, equal keys once."""
    by_kind = df.select(F.col(group).alias("g"), F.col(key).alias("k"), kind.alias("kind")).distinct().groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n"))
    return by_kind.groupBy("g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("kind", F.lit("")), "n"))).alias("kinds")).withColumnRenamed("g", group)


def directives(sizes: DataFrame, group: str, contract: Contract) -> DataFrame:
    """PRJ-18: group, ok and directive: what to add to or take from a set, by its shortfalls; keep the size if there is none."""
    n, none = F.col("n").cast("int"), F.lit("keep the number of records and mend the fields named")
    parts = [F.when(n < contract.least, F.concat(F.lit("add "), (contract.least - n).cast("string"), F.lit(" new records")))]
    if contract.most is not None:
        parts.append(F.when(n > contract.most, F.concat(F.lit("merge or remove "), (n - contract.most).cast("string"), F.lit(" records"))))
    for kind, least in contract.least_of.items():
        have = F.coalesce(F.try_element_at("kinds", F.lit(kind)), F.lit(0)).cast("int")
        parts.append(F.when(have < least, F.concat(F.lit(f"{kind}: "), (least - have).cast("string"), F.lit(f" more, {least} are due"))))
    lines = F.array_compact(F.array(*parts))
    return sizes.select(group, (F.size(lines) == 0).alias("ok"), F.when(F.size(lines) == 0, none).otherwise(F.array_join(lines, "; ")).alias("directive"))


def members(answer: Column, name: str) -> Column:
    """PRJ-19: the objects in the list `name` of a JSON answer, as texts; other members are left out, none for any other shape."""
    found = F.from_json(F.get_json_object(answer, f"$.{name}"), "array<string>")
    return F.coalesce(F.filter(found, lambda x: F.ltrim(x).startswith("{")), F.array().cast("array<string>"))


def list_error(answer: Column, name: str, least: int) -> Column:
    """PRJ-19: what is wrong with the list `name` of a JSON answer: no list, or fewer than `least` objects; null if it is right."""
    raw = F.get_json_object(answer, f"$.{name}")
    short = F.concat(F.lit(f"{name}: "), F.size(members(answer, name)).cast("string"), F.lit(f" of {least} objects"))
    return F.when(raw.isNull() | ~F.ltrim(raw).startswith("["), F.lit(f"{name} is no list")).when(F.size(members(answer, name)) < least, short)


def kept_links(df: DataFrame, key: str, links: Column, known: DataFrame, known_id: str) -> DataFrame:
    """THR-1: key and kept, the links of each row that name a known record, in order and each once; empty where none does."""
    rows = df.select(F.col(key).alias("k"), F.array_distinct(F.coalesce(links, F.array().cast("array<string>"))).alias("l")).where("k is not null").dropDuplicates(["k"])
    there = known.select(F.col(known_id).alias("id")).where("id is not null").distinct().withColumn("there", F.lit(True))
    found = lookup_join(rows.select("k", F.posexplode("l").alias("p", "id")), there, "id").where("there").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("f"))  # a row's few links
    return rows.select("k").join(found, "k", "left").select(F.col("k").alias(key), F.coalesce(F.transform("f", lambda x: x["id"]), F.array().cast("array<string>")).alias("kept"))


def filled_template(template: Column, fields: dict[str, Column]) -> Column:
    """FN-S13, SRC-12: a template with each {NAME} replaced by its field; nulls as empty, unknown names stay."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
