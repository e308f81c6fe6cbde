import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunking
from docmill.sources import files, markup
from docmill.streaming import events


def test_html():
    html = "<nav><p>no</p></nav><p>pre</p><h2>7.1 Name</h2><p>a&nbsp;b</p><script>x</script><ul><li>c <p>d</p></li></ul><h3>Notes!</h3><h4>Last</h4><td>e"
    assert markup.html_sections(html) == [(0, "0", "Preamble", "pre"), (1, "7.1", "Name", "a b\nc d\nd"), (3, "last", "Last", "e")]
    page = '<p>out</p><div id="tabs"><h2>2) A <i>b</i></h2><p>x<p>y<div class="nav big">n</div><ul><li>k<li>l</ul><div id="segment-footer"><p>f</p></div></div><p>below</p><footer><p>z</p></footer>'
    assert markup.html_sections(page) == [(1, "2-a-b", "2) A b", "x\ny\nk\nl")]
    assert markup.html_sections('<div id="tabs"><p>a</p></div><div id="segment-content"><p>b</p></div>') == [(0, "0", "Preamble", "b")]
    assert markup.html_sections("") == [] and markup.html_sections(None) == []


def test_xml(spark):
    xml = '<R><DIV8 N="1311.10"><HEAD>H <I>x</I></HEAD><P>a <E>b</E> c</P><FP>d</FP><P> </P></DIV8><DIV8 N="2"/></R>'
    assert markup.xml_sections(xml) == [(0, "1311.10", "H x", "a b c\nd")]
    assert markup.xml_sections("<broken") == []
    df = spark.createDataFrame([(1, xml), (2, None)], "id int, body string")
    assert markup.sections(df, "id", "body", "xml").count() == 1


def test_marked_sections(spark):
    df = spark.createDataFrame([(1, "### 1.1 | One\nbody\nmore\n### 2 | Two\n\n### 3 | Three\nx"), (2, None), (3, "plain")], "id int, t string")
    out = [(r["section"], r["heading"], r["body"]) for r in chunking.marked_sections(df, "id", "t").orderBy("section_no").collect()]
    assert out == [("1.1", "One", "body\nmore"), ("3", "Three", "x")]


def test_logs_manifest_and_guards(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "call", "latency_s": 1.5}\n{broken\n\n{"event": "end"}\n')
    rows, broken = files.read_log(spark, str(tmp_path / "log.jsonl"))
    assert rows.count() == 2 and [r["value"] for r in broken.collect()] == ["{broken"]
    df = spark.createDataFrame([(1, ["a", "b"], {"x": 1}, "hid")], "id int, l array<string>, m map<string,int>, fact_ids string")
    files.write_csv(df, str(tmp_path / "out"), ["id", "l", "m"])
    back = files.read_manifest(spark, str(tmp_path / "out"), ["id", "l", "m"]).first()
    assert tuple(back) == ("1", "a;b", '{"x":1}')
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(df, str(tmp_path / "out"), ["id"], protect=True)
    assert files.read_csv_if_there(spark, str(tmp_path / "none"), "a int").count() == 0


def test_hashes_steps_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    got = files.read_binary(spark, str(tmp_path / "in")).withColumn("doc_id", F.lit("a"))
    listed = got.select("doc_id", "sha256")
    assert files.verified(got, listed, "doc_id").first()["state"] == "ok"
    assert files.verified(got, listed.withColumn("sha256", F.lit("x")), "doc_id").first()["state"] == "changed"
    assert files.read_step(spark, str(tmp_path), "one") is None
    files.write_step(spark.range(3), str(tmp_path), "one")
    assert files.read_step(spark, str(tmp_path), "one").count() == 3
    chunks = spark.createDataFrame([("d", "c1", [1.0]), ("d", "c2", [0.5])], "doc_id string, chunk_id string, vector array<double>")
    files.write_index(chunks, str(tmp_path / "ix"))
    assert files.read_index(spark, str(tmp_path / "ix"), chunks).count() == 2
    with pytest.raises(ValueError):
        files.read_index(spark, str(tmp_path / "ix"), chunks.limit(1))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 4, "ab"[i % 2], float(i), None) for i in range(60)] + [(60, None, 1, "a", 1.0, None)]
    df = spark.createDataFrame(rows, events.EVENT)
    folder = str(tmp_path / "events")
    df.repartition(3).write.parquet(folder)
    query = events.windowed(events.tail(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("stream_out").start()
    try:
        query.processAllAvailable()
        got = sorted(map(str, spark.sql("select * from stream_out").collect()))
    finally:
        query.stop()
    assert got == sorted(map(str, events.windowed(df).collect()))
