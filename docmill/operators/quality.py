"""Rule-based quality of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V


def _note(*cases: tuple[Column, Column | str], good: str) -> Column:
    """Score and note: the first case that holds gives 0 and its note, else 1 and the good one."""
    score, note = F, F
    for holds, said in cases:
        score = score.when(F.coalesce(holds, F.lit(False)), 0)
        note = note.when(F.coalesce(holds, F.lit(False)), said if isinstance(said, Column) else F.lit(said))
    return F.struct(score.otherwise(1).cast("int").alias("score"), note.otherwise(F.lit(good)).alias("note"))


def _some(found: Column, most: int) -> Column:
    return F.array_join(F.slice(found, 1, most), ", ")


def rules(statement: str, criteria: str, method: str, cites: Column, invalid: Column, unknown: Column, sources: Column, derived: Column, duplicate: Column) -> dict[str, Column]:
    """QA-1: the eight attributes of a statement, each as struct<score, note>.

    cites, invalid, unknown and sources are arrays; duplicate is the text of a near-duplicate or null. Null texts
    count as empty. Cases are tried in order; the first that holds decides. A list of phrases is one pattern; which of
    its phrases a text holds is looked up only where a note names them.
    """
    s, c = F.coalesce(F.col(statement), F.lit("")), F.coalesce(F.col(criteria), F.lit(""))
    low, both = F.lower(s), F.concat_ws("\n", s, c)
    shall = F.regexp_count(low, F.lit(r"\bshall\b"))
    compound = F.regexp_extract(s, V.COMPOUND, 0)
    empty = F.trim(F.regexp_replace(c, r"\s+", " ")) == ""
    observable = c.rlike("[0-9]") | T.any_of(c, V.OBSERVABLE, words=False)
    return {
        "necessary": _note((duplicate.isNotNull(), F.concat(F.lit("near-duplicate: "), F.substring(duplicate, 1, 60))), good="no near-duplicate"),
        "unambiguous": _note((T.any_of(s, V.WEAK_WORDS), F.concat(F.lit("weak terms: "), _some(T.hits_of(s, V.WEAK_WORDS), 4))), good="no weak term"),
        "complete": _note((empty, "no acceptance criteria"), (T.any_of(both, V.PLACEHOLDERS, words=False), F.concat(F.lit("open-ended: "), F.array_join(T.parts_of(both, V.PLACEHOLDERS), ", "))), good="complete"),
        "singular": _note(
            (shall > 1, F.concat(shall.cast("string"), F.lit(" times shall"))), (s.contains(";"), "semicolon"), (compound != "", F.concat(F.lit("compound: "), compound)), (shall == 0, "no shall"),
            good="one obligation",
        ),
        "feasible": _note((T.any_of(both, V.ABSOLUTES, words=False), F.concat(F.lit("absolute: "), _some(T.parts_of(both, V.ABSOLUTES), 2))), good="no absolute claim"),
        "verifiable": _note(
            (empty, "no acceptance criteria"), (~F.coalesce(F.col(method).isin(V.METHODS), F.lit(False)), "unknown method"),
            (T.any_of(c, V.WEAK_WORDS), F.concat(F.lit("weak terms: "), _some(T.hits_of(c, V.WEAK_WORDS), 3))), (~observable, "nothing observable"), good="observable",
        ),
        "conforming": _note((shall == 0, "no shall"), (~s.rlike(r"(?i)^\s*(the|a|an)\s+\w+"), "no actor"), (low.rlike(r"\b(because|in order to|so that|rationale)\b"), "rationale"), good="actor and shall"),
        "traceable": _note(
            (F.size(invalid) > 0, F.concat(F.lit("invalid: "), _some(invalid, 3))), (F.size(unknown) > 0, F.concat(F.lit("unknown: "), _some(unknown, 3))),
            ((F.size(cites) == 0) & (F.size(sources) == 0) & ~derived, "no source"), good="traced",
        ),
    }


def score_rows(df: DataFrame, keys: list[str], scored: dict[str, Column], notes: bool = True) -> DataFrame:
    """QA-2: keys, attribute, rule_score, rule_note: one row per statement and attribute, by one narrow pass; notes only if asked."""
    said = (lambda x: [x["note"].alias("rule_note")]) if notes else (lambda x: [])
    items = F.array(*[F.struct(F.lit(a).alias("attribute"), x["score"].alias("rule_score"), *said(x)) for a, x in scored.items()])
    return df.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")


def agreement(rule: Column, second: Column) -> Column:
    """QA-4: no_llm_score, agree or disagree."""
    return F.when(second.isNull(), "no_llm_score").when(rule == second, "agree").otherwise("disagree")


def read_scores(answer: Column, attributes: list[str]) -> Column:
    """QA-3: array<struct<attribute, llm_score, llm_note>> of a second scorer's JSON answer, in the given order.

    The answer holds {"scores": {attribute: {"score": n, "note": text}}} or {attribute: n}; a score other than 0 and 1,
    one that is missing and one of an answer without JSON is null, its note empty.
    """
    score = lambda a: F.coalesce(F.get_json_object(answer, f"$.scores.{a}.score"), F.get_json_object(answer, f"$.scores.{a}"))
    number = lambda a: score(a).try_cast("int")
    return F.array(*[F.struct(F.lit(a).alias("attribute"), F.when(number(a).isin(0, 1), number(a)).alias("llm_score"), F.coalesce(F.get_json_object(answer, f"$.scores.{a}.note"), F.lit("")).alias("llm_note")) for a in attributes])


def merged_scores(rules: DataFrame, second: DataFrame, keys: list[str], weak: list[str]) -> DataFrame:
    """QA-4, JOIN-1: rule scores left-joined with the second scorer's: keys, rule_score, llm_score, agreement, note.

    The note names both, led by a mark for attributes that a rule can decide only weakly. second has one row per key.
    """
    met = rules.join(second, keys, "left")
    said = F.concat(F.lit("rule: "), F.coalesce("rule_note", F.lit("")), F.when(F.trim(F.coalesce("llm_note", F.lit(""))) != "", F.concat(F.lit(" || llm: "), F.col("llm_note"))).otherwise(""))
    marked = F.when(F.col("attribute").isin(weak), F.concat(F.lit("[rule weakly decidable] "), said)).otherwise(said)
    return met.select(*keys, "rule_score", "llm_score", agreement(F.col("rule_score"), F.col("llm_score")).alias("agreement"), marked.alias("note"))


def undefined_terms(text: Column, known: list[str]) -> Column:
    """QA-6, FN-S7: acronyms of two or more capitals or digits that the glossary doesn't hold, compared in capitals."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w-])[A-Z][A-Z0-9]+(?![\w-])"), F.lit(0)))
    upper = F.array(*[F.lit(k.upper()) for k in known])
    return F.array_sort(F.filter(found, lambda a: ~F.array_contains(upper, F.upper(a))))


def categories(statement: Column) -> Column:
    """PRJ-14: categories whose keywords the statement holds, in order; functional if there are none."""
    low = F.lower(F.coalesce(statement, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(c)) for c, ps in V.CATEGORIES.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("functional"))).otherwise(found)


def primary(found: Column, order: list[str]) -> Column:
    """PRJ-16: the category that comes first in the order; null if the order holds none."""
    return F.get(F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains(found, c)), F.lit(0))
