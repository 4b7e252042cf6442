"""Formats, dates and objects within text on hand-made files."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from prosemill.functions import dates, parsing
from prosemill.sources import formats


def test_lines_come_back(spark, tmp_path):
    formats.register(spark)
    df = spark.createDataFrame([(1, "é a", [1, 2], 0.5), (2, None, None, None), (3, "x\ny", [], float(7))], "id long, t string, n array<int>, d double").repartition(3)
    path = f"{tmp_path}/out"
    df.write.format("prosemill-jsonl").option("compression", "gzip").mode("append").save(path)
    df.where("id = 1").write.format("prosemill-jsonl").mode("append").save(path)
    got = spark.read.format("prosemill-jsonl").schema(df.schema).load(path).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "é a", [1, 2], 0.5)] * 2 + [(2, None, None, None), (3, "x\ny", [], 7.0)]
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir())[-1] == ".jsonl" and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    df.where("id = 2").write.format("prosemill-jsonl").mode("overwrite").save(path)
    assert spark.read.format("prosemill-jsonl").schema("id long").load(path).collect()[0].id == 2


def test_bad_lines_caps_and_missing_files(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "7"}\nnot json\n\n[1]\n{"id": "z", "x": 2.5}\n{"id": 3}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("".join(f'{{"id": {i}}}\n' for i in range(10, 15)))
    (tmp_path / "_hidden.jsonl").write_text('{"id": 99}\n')
    read = lambda **o: spark.read.format("prosemill-jsonl").schema("id long, x string").options(**o)
    assert [tuple(r) for r in read().load(f"{tmp_path}/a.jsonl").collect()] == [(1, "7"), (None, "2.5"), (3, None)]
    assert read().load(str(tmp_path)).count() == 8 and read(rows=2).load(str(tmp_path)).count() == 4
    assert read(missing="skip").load(f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="(?i)none|not found|No such"):
        read().load(f"{tmp_path}/none").count()
    with pytest.raises(Exception, match="(?i)expecting value|json"):
        read(strict="true").load(f"{tmp_path}/a.jsonl").count()


def test_feeds_and_books(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><link>http://e/1</link><description>D</description><pubDate>Tue, 01 Jul 2003 10:52:37 +0200</pubDate></item></channel></rss>")
    (tmp_path / "b.atom").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>U</title><link href="http://e/2"/><published>2003-07-01T08:52:37Z</published></entry></feed>')
    (tmp_path / "c.xml").write_text("<rss><item>")
    (tmp_path / "d.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><rss/>')
    rows = spark.read.format("prosemill-feeds").load(str(tmp_path)).orderBy("file").collect()
    assert [(r.title, r.url, r.published, r.reason) for r in rows] == [("T", "http://e/1", 1057049557, None), ("U", "http://e/2", 1057049557, None), (None, None, None, "malformed"), (None, None, None, "entities")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("p1.xhtml", "<html><head><title>x</title></head><body><p>Hello <b>there</b></p></body></html>")
    (tmp_path / "a.epub").write_bytes(data.getvalue())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    assert [(r.text, r.reason) for r in spark.read.format("prosemill-books").load(str(tmp_path)).orderBy("file").collect()] == [("Hello there", None), (None, "BadZipFile")]


def test_dates():
    assert dates.rfc_unix("Tue, 01 Jul 2003 10:52:37 GMT") == 1057056757 == dates.iso_unix("2003-07-01T10:52:37") == dates.any_unix(" 2003-07-01 10:52:37+00:00 ")
    assert dates.rfc_unix("1 Jul 2003 10:52:37 EST") == 1057056757 + 5 * 3600 and dates.iso_unix("2003-07-01") == 1057017600
    assert [f(x) for f in (dates.rfc_unix, dates.iso_unix, dates.any_unix) for x in (None, "", "yesterday", "2003-13-01")] == [None] * 12


def test_objects_within_text(spark):
    f = parsing.json_object
    assert f('{"b": 1, "a": {"c": "}"}}') == '{"a":{"c":"}"},"b":1}' == f('Sure:\n```json\n{"b": 1, "a": {"c": "}"}}\n```') == f('So {this} is {"b": 1, "a": {"c": "}"}} it {"z": 1}')
    assert f('x {"s": "a \\" { b", "n": [1, {"k": 2}]} y') == '{"n":[1,{"k":2}],"s":"a \\" { b"}'
    assert [f(x) for x in (None, "", "none", "{", "[1, 2]", "{'a': 1}", "{a} {b")] == [None] * 7
    head = "Produced by X\n\nTitle: The Long\n   Winding Road\nAuthor: A. Writer\nLanguage: English\n\nTitle page"
    row = spark.createDataFrame([(head,), ("no fields",), (None,)], "t string").select(*[parsing.header_field(F.col("t"), n).alias(n) for n in ("Title", "Author", "Language")]).collect()
    assert [tuple(r) for r in row] == [("The Long Winding Road", "A. Writer", "English"), (None, None, None), (None, None, None)]
