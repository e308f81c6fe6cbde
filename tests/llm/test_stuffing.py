import textwrap

import pytest
from pyspark.sql import functions as F

from docmill.llm.stuffing import line_shapes, page_fillers, page_shapes
from tests.llm.prose import PROSE as LANGUAGES

PROSE = "We still check the records by hand, and the nurse signs off the list at the end of each shift. If it is late, the clerk must tell the ward. " * 6
STUFFED = {
    "list": "red shoes, cheap boots, red shoes, cheap boots, " * 20, "spaces": "Pfleger Dosis Meldung Auftrag Hinweis Zugang Beleg Bericht " * 12,
    "lines": "\n".join(["red shoes", "cheap boots", "blue hats"] * 20), "stuffed": "Buy red shoes online, red shoes cheap, red shoes today. Best red shoes and red shoes offers. Looking for red shoes? " * 12,
    "tags": "#red #shoes #boots #hats " * 20, "links": "\n".join(f"http://x.example/{i} shop" for i in range(40)), "anchors": "\n".join(f'<a href="http://x.example/{i}">blue item</a>' for i in range(40)),
    "crumbs": "\n".join(["Home > Shop > Boots > Red"] * 30), "places": "red shoes in Aby, red shoes near Boston, red shoes at Cork, " * 15,
    "products": "\n".join(f"SKU {i} red boot L leather, winter, sale" for i in range(40)),
}


def share(text):
    words = {}
    for (kind, _), (_, n) in page_shapes(text).items():
        words[kind] = words.get(kind, 0) + n
    return 1 - (words.get("sentence", 0) + words.get("data", 0)) / sum(words.values())


@pytest.mark.parametrize("name", sorted(STUFFED))
def test_filler_and_its_mixtures(name):
    assert share(STUFFED[name]) > 0.9
    assert share(STUFFED[name] + "\n" + PROSE[:140]) > 0.5
    filler = STUFFED[name][:300]
    assert share(PROSE * 2 + "\n" + filler) < 0.5


@pytest.mark.parametrize(
    "text",
    [
        PROSE, PROSE.lower().replace(".", "").replace(",", ""), "\n".join(f"0{i % 10}:15 The import at Boston is late again." for i in range(30)), "The system shall log it.\n" * 20,
        "| a | 12 | 3.5 |\n" * 20 + PROSE, '{"id": 12, "state": "open", "n": 3}\n' * 10 + PROSE * 2, "Terms: A word is a run of letters that stands for a thing.\n" * 10,
        PROSE + "[1] https://a.example/x " * 6 + PROSE,
    ],
)
def test_writing_is_no_filler(text):
    assert share(text) < 0.5


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_prose_of_any_language_is_no_filler(language):
    text = LANGUAGES[language]
    bare = text.replace(". ", "\n").replace("。", "\n").replace("।", "\n").rstrip(".")
    for layout in (text, (text + " ") * 20, "\n".join(textwrap.wrap(text, 60)), "\n".join(textwrap.wrap(text, 35)), bare, text.upper()):
        assert share(layout) < 0.3
    assert share(text + "\n" + "красные ботинки, zapatos rojos, 红鞋, " * 60) > 0.5


def test_operator_defined_cases(spark):
    rows = [(1, STUFFED["tags"]), (1, STUFFED["tags"]), (2, PROSE), (3, None), (4, ""), (5, " \n "), (6, STUFFED["list"] * 500), (None, STUFFED["tags"])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("n_words", F.lit(1)).withColumn("_key", F.lit(1))
    out = page_fillers(df, "id", "text")
    assert sorted((r["id"] or 0, r["stuffed"]) for r in out.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, True)]
    assert page_fillers(df.limit(0), "id", "text").count() == 0
    assert {r["kind"] for r in line_shapes(df.where("id = 1"), "id", "text").collect()} == {"tags"}
