"""Problem 8: pages of repeated keywords, links or tags instead of sentences.

Method: every line (and every sentence of a long line) is reduced to a shape: grades of its number of words, of its
share of short words, of the words between its separators, its links, tags, figures and capitals, its end mark, and
whether it repeats phrases of the page. No word list takes part, only lengths and marks, so all languages are treated
alike. A shape alone says whether it may be a sentence; brief lines and rows of a table are told from others by how many
of them follow each other. Shapes are grouped by page, and a page is flagged when a few non-sentence shapes hold more
than half of its words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that may touch a word or join it to the next, each read as a space.
MARKS, FURTHER_MARKS = ".,;:!?()[]{}\"'|/<>*_#=-", "·•–—’“”«»„、，；。？！।؟،"
#: Ends of sentences and lines, each turned into a line feed; plain replacements are much faster than a pattern.
ENDS, FURTHER_ENDS = (tuple((e, e.rstrip() + "\n") for e in ends) for ends in ((". ", "? ", "! ", '." ', ".) ", "\r"), ("。", "？", "！", "।", "؟ ")))
STOPS = tuple(".!?。！？।؟…:")
LINK = re.compile(r"(?:https?://|www\.|href=|mailto:)|\]\(\S+\)", re.I)
TAG = re.compile(r"#\w")
SEPARATORS = re.compile(r"[,;|/·•>–—*\t、，；،]")
#: Eight letters in a row of scripts that put no space between words: Thai, Lao, Burmese, Khmer, Kana and Han.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]{8}")
FIGURES = re.compile("[0-9]+")
FIGURE = re.compile("(?:^|(?<=\\s))[0-9{}\\[\\]<>=\"'`$(]")
#: Letters of a short word. Prose of every spaced script holds many (articles, particles, pronouns), lists of keywords few.
SHORT = 3
#: Shares of short words from which a unit may be a sentence whatever its separators, and whatever its links.
PROSE, LINKED = 0.12, 0.2
#: A phrase of two long words is a keyword when it stands in a page so often, and a unit is keyed from this share of its words.
REPEATS, KEYED = 4, 0.4
#: Words of a brief line; brief lines and rows are lists when so many list-like lines follow each other.
BRIEF, RUN = 5, 6
#: A page is flagged when its FEW largest non-sentence shapes hold more than half of its words.
FEW = 8


class Shape(NamedTuple):
    """Grades of a unit: words, short words, words between separators, links, tags, figures, capitals, marks."""

    words: str
    short: str
    parts: str
    links: str
    tags: str
    figures: str
    capitals: str
    marks: str

    def __str__(self) -> str:
        return "-".join(self)


def _grade(value: float, steps: tuple[float, ...]) -> str:
    return "0123456"[bisect_right(steps, value)]


def _units(text: str) -> tuple[list[str], list[list[str]]]:
    """Units of a text, and their words in lower case without marks."""
    ends, marks = (ENDS, MARKS) if text.isascii() else (ENDS + FURTHER_ENDS, MARKS + FURTHER_MARKS)
    for end, to in ends:
        text = text.replace(end, to)
    low = text.lower()
    for mark in marks:
        low = low.replace(mark, " ")
    units, lows = text.split("\n"), low.split("\n")
    keep = [k for k, u in enumerate(units) if u and not u.isspace()]
    return [units[k] for k in keep], [lows[k].split() for k in keep]


def _phrases(units: list[str], words: list[list[str]], stops: list[bool]) -> Counter:
    """The recurring pairs of neighbouring words of a page. A sentence that recurs, but for its figures, counts once.

    A pair with a word of three letters counts only if a unit with separators holds it twice, as "red shoes online, red
    shoes cheap" does: otherwise it may be an article or a conjunction and what follows it.
    """
    said: set[str] = set()
    lines = []
    for unit, line, stop in zip(units, words, stops):
        if stop:
            bare = FIGURES.sub("", unit)
            if bare in said:
                continue
            said.add(bare)
        lines.append((unit, line))
    counts = Counter(chain.from_iterable(line for _, line in lines))
    often = {w for w, c in counts.items() if c >= REPEATS and len(w) >= SHORT and not w.isdigit()}
    pairs: Counter = Counter()
    twice: set[tuple[str, str]] = set()
    if len(often) > 1:
        for unit, line in lines:
            if sum(map(often.__contains__, line)) > 1:
                found = [p for p in zip(line, line[1:]) if p[0] in often and p[1] in often]
                pairs.update(found)
                if len(found) > 1 and (unit.rstrip().endswith(STOPS) or SEPARATORS.search(unit)):
                    twice.update(p for p, n in Counter(found).items() if n > 1)
    return Counter({p: n for p, n in pairs.items() if n >= REPEATS and (min(map(len, p)) > SHORT or p in twice)})


def _covered(words: list[str], pairs: Counter) -> tuple[float, Counter]:
    """Share of the words that stand in recurring pairs, and how often each such pair stands there."""
    found = [(k, pair) for k, pair in enumerate(zip(words, words[1:])) if pairs.get(pair, 0) >= REPEATS]
    if not found:
        return 0.0, Counter()
    hit, within = [0] * len(words), Counter(pair for _, pair in found)
    for k, _ in found:
        hit[k] = hit[k + 1] = 1
    return sum(hit) / (len(hit) or 1), within


def _shape(unit: str, words: list[str], stop: bool, pairs: Counter, brief_pairs: Counter) -> tuple[Shape, int]:
    """Shape of a unit, and its number of words (runs of characters other than white space)."""
    n = len(unit.split())
    digits = FIGURES.search(unit) is not None
    named = [w for w in words if not w.isdigit()] if digits else words
    sizes = list(map(len, named))
    short = sum(map(SHORT.__ge__, sizes)) / (len(sizes) or 1)
    links = len(LINK.findall(unit)) / n if "://" in unit or "www." in unit or "](" in unit or "href=" in unit else 0.0
    seps = len(SEPARATORS.findall(unit)) + unit.count(" - ")
    figures = len(FIGURE.findall(unit)) / n
    keyed = 0.0
    if pairs:
        keyed, within = _covered(words, pairs)
        # a sentence that names each phrase but once, among other words, is prose about it
        if n > BRIEF and short >= PROSE and keyed < 0.6 and within and max(within.values()) < 2 and sum(within.values()) < 4:
            keyed = 0.0
    shared = _covered(words, brief_pairs)[0] if brief_pairs and n <= BRIEF and not stop else 0.0
    marks = (
        ("a" if " > " in unit and unit.count(" > ") >= max(1, n // 8) else "")
        + ("e" if stop else "")
        + ("k" if keyed >= KEYED else "")
        + ("b" if shared >= KEYED else "")
        + ("t" if sizes and min(sizes) < SHORT else "")
        + ("r" if n > BRIEF and not stop and _repeated(named) >= 0.5 else "")
        + ("" if named else "n")
        + ("" if unit.isascii() or UNSPACED.search(unit) is None else "u")
    )
    per = n / (seps + 1)
    return Shape(
        _grade(n, (2, 4, BRIEF + 1, 8, 13, 41)),
        _grade(short, (1e-9, PROSE, LINKED)),
        str(seps) if seps < 2 else "2" if per <= 4 else "3" if per <= 5 else "4",
        _grade(links, (1e-9, 0.25)),
        _grade(_tags(unit) / n, (1e-9, 0.5)),
        _grade(figures, (1e-9, 0.3)),
        "A" if unit.isupper() else "T" if unit.istitle() else "a",
        marks,
    ), n


def _repeated(words: list[str]) -> float:
    """Share of the words that stand in a unit more than once."""
    counts = Counter(words)
    return sum(n for n in counts.values() if n > 1) / (len(words) or 1)


def _tags(unit: str) -> int:
    return len(TAG.findall(unit)) if "#" in unit else 0


def shape_kind(s: Shape) -> str:
    """What a unit of this shape is: links, tags, keywords, data or sentence; brief and row depend on the lines around it."""
    listed = s.parts in "23" and s.words >= "2"  # at least two separators, at most five words between them
    if s.links == "2" or (s.links == "1" and s.short < "3") or ("a" in s.marks and s.short < "2"):
        return "links"
    if s.tags == "2":
        return "tags"
    if "u" in s.marks:
        return "sentence"
    if "k" in s.marks and (s.words >= "2" or s.parts != "0"):
        return "keywords"
    if s.words <= "2" and "e" not in s.marks and "n" not in s.marks and s.figures < "2" and ("t" not in s.marks or "b" in s.marks):
        return "brief"
    if s.short >= "2" and not (listed and s.words >= "5" and s.short == "2" and "e" not in s.marks):
        return "row" if listed and s.parts == "2" and "e" not in s.marks and s.figures < "2" else "sentence"
    if "n" in s.marks or (s.figures == "2" and s.parts not in "12"):
        return "data"
    if listed:
        return "tags" if s.figures > "0" else "keywords"
    bare = "e" not in s.marks and (s.words >= "5" and "r" in s.marks or s.words == "6" and s.short == "0")
    return "keywords" if bare else "sentence"


#: What brief lines and rows are when RUN list-like lines follow each other.
IN_LIST = {"brief": "keywords", "row": "tags"}


def page_shapes(text: str | None) -> dict[tuple[str, str], list[int]]:
    """{(kind, shape): [units, words]} of a page; kind is sentence, data, keywords, links or tags.

    A word is a run of characters other than white space. Null, empty and blank texts have no shapes.
    """
    units, words = _units(text or "")
    stops = [u.rstrip().endswith(STOPS) for u in units]
    pairs = _phrases(units, words, stops)
    brief_pairs: Counter = Counter()
    brief = [w for w, stop in zip(words, stops) if len(w) <= BRIEF and not stop]
    if len(brief) >= RUN:
        for line in brief:
            brief_pairs.update(zip(line, line[1:]))
    known: dict[str, tuple[Shape, int, str]] = {}
    lines = []
    for unit, line, stop in zip(units, words, stops):
        if unit not in known:
            shape, n = _shape(unit, line, stop, pairs, brief_pairs)
            known[unit] = shape, n, shape_kind(shape)
        lines.append(known[unit])
    kinds, run = [kind for _, _, kind in lines], []
    for k, kind in enumerate([*kinds, "sentence"]):
        if kind != "sentence":
            run.append(k)
            continue
        for j in run:
            kinds[j] = IN_LIST.get(kinds[j], kinds[j]) if len(run) >= RUN else kinds[j]
        run = []
    found: dict[tuple[str, str], list[int]] = {}
    for kind, (shape, n, _) in zip(kinds, lines):
        entry = found.setdefault(("sentence" if kind in IN_LIST else kind, str(shape)), [0, 0])
        entry[0] += 1
        entry[1] += n
    return found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, kinds, shapes, units, words = [], [], [], [], []
        for row, text in enumerate(batch.column(1)):
            for (kind, shape), (a, b) in page_shapes(text.as_py()).items():
                at.append(row)
                kinds.append(kind)
                shapes.append(shape)
                units.append(a)
                words.append(b)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(shapes, pa.string()), pa.array(units, pa.int32()), pa.array(words, pa.int32())],
            names=["_key", "kind", "shape", "n_units", "n_words"],
        )


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            words: Counter = Counter()
            filler: list[int] = []
            for (kind, _), (_, n) in page_shapes(text.as_py()).items():
                words[kind] += n
                if kind not in ("sentence", "data"):
                    filler.append(n)
            filler.sort(reverse=True)
            rows.append((sum(words.values()), words["keywords"], words["links"], words["tags"], sum(filler[:FEW])))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in cols)], names=["_key", "n_words", "keyword_words", "link_words", "tag_words", "dominant_words"])


def _rows(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows, rows.schema["_key"].dataType.simpleString()


def line_shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, shape, n_units, n_words: the shapes of each page. Pages without a word give no row."""
    rows, kind = _rows(df, key, text)
    return rows.mapInArrow(_run, f"_key {kind}, kind string, shape string, n_units int, n_words int").withColumnRenamed("_key", key)


def page_fillers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, keyword_words, link_words, tag_words, dominant_words and stuffed of every row of df.

    dominant_words are those of the FEW largest non-sentence shapes; a page is stuffed when they are more than half of
    its words. Texts without words have zeros and aren't stuffed. A narrow pass: no shuffle; each row is handled by
    itself, so repeats and skewed sources don't matter.
    """
    rows, kind = _rows(df, key, text)
    pages = rows.mapInArrow(_by_page, f"_key {kind}, n_words int, keyword_words int, link_words int, tag_words int, dominant_words int")
    return pages.withColumn("stuffed", F.col("dominant_words") * 2 > F.col("n_words")).withColumnRenamed("_key", key)
