"""Intake of statements: masking, quarantine, vague answers, attribution, and who may read what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import chunking, privacy
from docmill.session import cut, lookup_join


def taken_in(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """SEC-9: (statements: key, para_no, statement; events: key, para_no, kind, detail) of the paragraphs of texts.

    Personal data is masked first (tokens are stable over all texts), then sentences with instructions of high severity
    are replaced by the note. Events: phi_masked with the kinds masked, prompt_injection with the kind found,
    suspicious_link with the link. Null and blank texts have no paragraph. Keys are unique.
    """
    paras = chunking.paragraph_rows(df.where(F.col(key).isNotNull()), key, text).select(F.struct(F.col(key).alias("key"), "para_no").alias("at"), "paragraph")
    spans = cut(privacy.personal_spans(paras, "at", "paragraph"))
    masked = cut(privacy.masked(spans, "at", privacy.vault(spans, "at")))
    statements = masked.select(F.col("at.key").alias(key), "at.para_no", privacy.quarantined(F.col("masked")).alias("statement"))
    hidden = spans.where("size(spans) > 0").select("at", F.lit("phi_masked").alias("kind"), F.array_join(privacy.leaked_kinds(F.col("spans")), ",").alias("detail"))
    found = masked.select("at", F.explode(privacy.injections(F.col("masked"))).alias("x"))
    told = found.select("at", F.when(F.col("x.severity") == "high", "prompt_injection").otherwise("suspicious_link").alias("kind"), F.when(F.col("x.severity") == "high", F.col("x.kind")).otherwise(F.col("x.match")).alias("detail")).distinct()
    events = hidden.unionByName(told).select(F.col("at.key").alias(key), "at.para_no", "kind", "detail")
    return statements, events


def restored(masked: DataFrame, key: str, text: str, tokens: DataFrame, role: str, allowed: tuple[str, ...] = ("security_officer", "compliance_officer")) -> DataFrame:
    """SEC-4: key and text with its tokens replaced by their values, for the roles that may see them; others are refused.

    Tokens that the vault doesn't hold stay. A token that stands in a large share of the texts is looked up safely.
    """
    if role not in allowed:
        raise PermissionError(f"{role} may not see masked values")
    found = masked.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[[A-Z]+_\d+\]"), F.lit(0)))).alias("token"))
    named = lookup_join(found, tokens.select("token", "value"), "token").where("value is not null").groupBy("k").agg(F.collect_list(F.struct("token", "value")).alias("m"))
    joined = masked.select(F.col(key).alias("k"), F.col(text).alias("t")).join(named, "k", "left")
    body = F.aggregate("m", F.col("t"), lambda s, x: F.replace(s, x["token"], x["value"]))
    return joined.select(F.col("k").alias(key), F.coalesce(body, "t").alias("restored"))


def answer_issue(text: Column, quantitative: Column, vague: list[str] | None = None) -> Column:
    """FN-S10, INT-1: struct<issue, detail> of an answer, null if there is none: vague words (the first three, longest first,
    then by letter), else no figure where one is needed. Answers that say they don't know are no issue."""
    words = sorted(set(V.WEAK_WORDS + V.VAGUE_ANSWERS if vague is None else vague), key=lambda w: (-len(w), w))
    t = F.coalesce(text, F.lit(""))
    said = F.struct(F.lit("vague").alias("issue"), F.concat(F.lit("vague wording: "), F.array_join(F.slice(T.hits_of(t, words), 1, 3), ", ")).alias("detail"))
    number = F.struct(F.lit("incomplete").alias("issue"), F.lit("no figure where one is needed").alias("detail"))
    return F.when(t.rlike(V.NO_ANSWER), F.lit(None)).when(T.any_of(t, words), said).when(F.coalesce(quantitative, F.lit(False)) & ~t.rlike("[0-9]"), number)


def followups(issues: DataFrame, proposed: DataFrame, group: str, key: str, question: str, more: int = 2) -> DataFrame:
    """INT-1: group, key, question and place: the issues found by rule first, in order of key, each with the question proposed
    for it or null, then at most `more` that were only proposed."""
    own = issues.select(group, key).distinct().withColumn("_r", F.lit(0))
    asked = proposed.where(F.trim(question) != "").groupBy(group, key).agg(F.min(question).alias(question))
    met = own.join(asked, [group, key], "full").withColumn("_r", F.coalesce("_r", F.lit(1)))
    listed = met.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", key, question))).alias("q"))  # an interview's few answers
    kept = F.concat(F.filter("q", lambda x: x["_r"] == 0), F.slice(F.filter("q", lambda x: x["_r"] == 1), 1, more))
    return listed.select(group, F.posexplode(kept).alias("place", "x")).select(group, f"x.{key}", f"x.{question}", (F.col("place") + 1).alias("place"))


def attributed(answer: Column, facts: Column, least_words: int = 4, floor: float = 0.34) -> Column:
    """STA-10: id of the fact (array<struct<id, text>>, in order) whose words the answer holds the largest share of, the first on
    ties; null below the floor, and for answers of fewer than least_words words. Words leave out the stop words."""
    stop = F.array(*[F.lit(w) for w in V.ANSWER_STOPS])
    words = lambda t: F.array_except(T.tokens(t, "[a-z0-9]+"), stop)
    own = words(answer)
    rated = F.transform(facts, lambda f, i: F.struct((F.size(F.array_intersect(own, words(f["text"]))) / F.greatest(F.size(words(f["text"])), F.lit(1))).alias("share"), (-i).alias("place"), f["id"].alias("id")))
    best = F.array_max(rated)
    return F.when((F.size(own) >= least_words) & (best["share"] >= floor), best["id"])


def fact_view(facts: DataFrame, key: str, precise: str, vague: str, unlocked: DataFrame) -> DataFrame:
    """STA-10: key and text: the precise text of a fact that has no vague one or is unlocked, else the vague one."""
    open_ = unlocked.select(F.col(key)).distinct().withColumn("_open", F.lit(True))
    met = facts.select(key, precise, vague).join(open_, key, "left")
    return met.select(key, F.when(F.col(vague).isNull() | F.col("_open"), F.col(precise)).otherwise(F.col(vague)).alias("text"))


class Slots:
    """SEC-10, STA-1: named tables with rights by reader; a refused access is an error and leaves an event.

    Tables are immutable, so what one reader derives can't change what another one reads.
    """

    def __init__(self, rights: dict[str, tuple[set[str], set[str]]]) -> None:
        self._rights, self._tables, self._events = rights, {}, []

    def _ask(self, who: str, name: str, write: bool) -> None:
        if name not in self._rights.get(who, (set(), set()))[write]:
            self._events.append((who, "write" if write else "read", name))
            raise PermissionError(f"{who} may not {'write' if write else 'read'} {name}")

    def read(self, who: str, name: str) -> DataFrame | None:
        self._ask(who, name, False)
        return self._tables.get(name)

    def write(self, who: str, name: str, table: DataFrame) -> None:
        self._ask(who, name, True)
        self._tables[name] = table

    def append(self, who: str, name: str, rows: DataFrame) -> None:
        self._ask(who, name, True)
        old = self._tables.get(name)
        self._tables[name] = rows if old is None else old.unionByName(rows, allowMissingColumns=True)

    def denied(self, spark) -> DataFrame:
        """who, action and slot of every refused access."""
        return spark.createDataFrame(self._events, "who string, action string, slot string")
