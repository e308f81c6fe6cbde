"""Problem 1: cutting oversized items at natural boundaries, with overlap.

Method: agglomerative merging. Atomic segments (lines and sentences) are joined again, the weakest boundary first, by
way of a heap of adjacent pairs, as long as the joined size plus the overlap fits the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 120
#: Strength of a boundary by what stands in the gap or before it; the higher, the better a place to cut.
HEADING, PARAGRAPH, LINE, SENTENCE, WRAPPED, CLAUSE, WORD = 4.0, 3.0, 2.0, 1.0, 0.6, 0.3, 0.0
WORDS = re.compile(r"[^ \t\r\n]+")
TITLE = re.compile(r"(#+|§|\d+(\.\d+)+|\(?[a-z0-9]{1,3}\)|[A-Z][.:)]|Q:|A:|[-*•])")
TERM = re.compile(r"[^\W\d_]{4,}")


def _strength(text: str, before: tuple[int, int], after: tuple[int, int]) -> float:
    gap = text[before[1] : after[0]]
    lines = gap.count("\n") or gap.count("\r")
    end = text[before[0] : before[1]].rstrip("\"')]”’»")[-1:]
    ended = end in ".!?"
    if lines:
        opens = TITLE.match(text, after[0]) is not None
        if lines > 1:
            return HEADING if opens else PARAGRAPH
        if opens:
            return LINE + 0.5
        return LINE if ended or text[after[0]].isupper() else WRAPPED
    if ended and not text[after[0]].islower():
        return SENTENCE
    return CLAUSE if end in ",;:–—" else WORD


def _terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def split_text(text: str | None, heading: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (first word with overlap, first new word, word after the last), counted in words.

    A word is a run of characters other than space, tab, CR and LF. Null, empty and blank texts have no piece, texts
    within the limit one. Every piece has at most `limit` words, overlap included; new words of all pieces together
    are the text; each piece but the first starts `overlap` words before its first new word. Ties between equally
    strong boundaries are resolved from left to right. Segments longer than a quarter of the room are cut at clauses,
    else at words, so a text without any punctuation is handled too.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")
    spans = [m.span() for m in WORDS.finditer(text or "")]
    n = len(spans)
    if n == 0:
        return []
    if n <= limit:
        return [(0, 0, n)]
    longest = max(1, (limit - overlap) // 4)
    marks = [0.0] * (n + 1)
    cuts, last, clause = [0], 0, 0
    for i in range(1, n):
        marks[i] = s = _strength(text, spans[i - 1], spans[i])
        if s == CLAUSE:
            clause = i
        if i < overlap:  # the first piece must be able to give the overlap
            continue
        if s >= WRAPPED:
            cuts.append(i)
            last = i
        elif i - max(last, overlap) >= longest:
            last = clause if clause > max(last, overlap - 1) else i
            cuts.append(last)
    about = _terms(heading or "")
    terms = [_terms(text[spans[a][0] : spans[b - 1][1]]) for a, b in zip(cuts, cuts[1:] + [n])]
    right = {a: b for a, b in zip(cuts, cuts[1:] + [n])}
    left = {b: a for a, b in right.items()}
    heap = []
    for k in range(1, len(cuts)):
        a, b = terms[k - 1], terms[k]
        same = len(a & b) / (min(len(a), len(b)) or 1)
        topic = (len(about & b) - len(about & a)) / (len(about) or 1)
        heap.append((marks[cuts[k]] - 0.5 * same + 0.25 * topic, cuts[k]))
    heapq.heapify(heap)
    while heap:
        _, at = heapq.heappop(heap)
        start, end = left[at], right[at]
        if end - start + (overlap if start else 0) <= limit:  # else it never fits, as pieces only grow
            right[start] = end
            left[end] = start
            del right[at], left[at]
    pieces, at = [], 0
    while at < n:
        pieces.append((max(0, at - overlap), at, right[at]))
        at = right[at]
    return pieces


SCHEMA = "piece_no int, n_pieces int, start_word int, new_word int, n_words int, piece string"


def _run(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, heads, texts = (batch.column(i) for i in range(3))
        out: dict[str, list] = {x: [] for x in ("at", "piece_no", "n_pieces", "start_word", "new_word", "n_words", "piece")}
        for row in range(batch.num_rows):
            text = texts[row].as_py()
            pieces = split_text(text, heads[row].as_py(), limit, overlap)
            if len(pieces) < 2:
                continue
            spans = [m.span() for m in WORDS.finditer(text)]
            for k, (a, b, c) in enumerate(pieces, 1):
                for name, value in zip(out, (row, k, len(pieces), a, b, c - a, text[spans[a][0] : spans[c - 1][1]])):
                    out[name].append(value)
        at = pa.array(out.pop("at"), pa.int64())
        kinds = {"piece": pa.string()}
        yield pa.RecordBatch.from_arrays(
            [keys.take(at), heads.take(at), *(pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items())], names=["_key", "_heading", *out]
        )


def split_oversized(df: DataFrame, key: str, text: str, heading: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text of more than `limit` words: key, heading, piece_no, n_pieces, start_word (with
    overlap), new_word (first word that isn't overlap), n_words, piece.

    Sizes are counted in the text itself. Other columns of df, whatever their names, are left out. A row delivered
    several times counts once, by its key. Rows with a null text or a null key are left out. The pass is narrow but
    for the removal of repeats; texts too short in characters never reach Python.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(heading).cast("string").alias("_heading"), F.col(text).cast("string").alias("_text")).where(
        F.col("_key").isNotNull() & (F.length("_text") > 2 * limit)
    )
    kind = rows.schema["_key"].dataType.simpleString()
    pieces = rows.mapInArrow(lambda it: _run(it, limit, overlap), f"_key {kind}, _heading string, {SCHEMA}")
    return pieces.dropDuplicates(["_key", "piece_no"]).withColumnsRenamed({"_key": key, "_heading": heading})
