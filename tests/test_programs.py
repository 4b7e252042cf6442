"""Functions, sources and streams against direct computations."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill import catalog
from prosemill.functions import text as T
from prosemill.operators import series
from prosemill.plans import programs
from prosemill.sources import corpus


@pytest.mark.parametrize("name", sorted(programs.QUERIES))
def test_every_program_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_corruptions_depend_on_the_seed_alone():
    text = "One. Two! Three?\n\nFour. Five.\n\nSix."
    for kind in T.KINDS:
        assert T.corrupt(text, kind, "1:2") == T.corrupt(text, kind, "1:2")
    assert sorted(T.corrupt(text, "shuffle_paragraphs", "a").split("\n\n")) == sorted(text.split("\n\n"))
    assert T.corrupt("a, b. c!", "drop_punctuation", "") == "a b c" and T.corrupt(text, "flatten_paragraphs", "") == text.replace("\n\n", " ")


def test_columns(spark):
    row = spark.createDataFrame([("table", "queue", -800.0, 90.0)], "a string, b string, x double, p double").select(T.vowel_groups(F.col("a")).alias("a"), T.vowel_groups(F.col("b")).alias("b"), T.stable_sigmoid(F.col("x")).alias("x"), T.plateau_score(F.col("p")).alias("p")).first()
    assert (row.a, row.b, row.p) == (2, 1, 1.08) and 0 <= row.x < 1e-9


def test_warping():
    a = np.array([1.0, 2, 3, 4])
    assert series.warp_distance(a, a) == 0 and series.warp_distance(a, np.zeros(0)) == float("inf") and series.warp_distance(a, a + 1) == pytest.approx(2 / 8)


def test_spectrum_finds_the_period(spark):
    rows = [(1, i, float(np.sin(2 * np.pi * i / 8))) for i in range(64)] + [(2, i, 1.0) for i in range(3)]
    got = series.spectrum(spark.createDataFrame(rows, "k long, i long, v double"), "k", ["i"], "v").collect()
    assert [(r.k, r.n, r.peak_period) for r in got] == [(1, 64, 8.0)]


def test_spectrum_of_long_series_is_that_of_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.normal() + np.sin(2 * np.pi * i / 50))) for k, n in ((1, 997), (2, 1024), (3, 90), (None, 1500)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(3)
    got, want = ({r.k: tuple(r)[1:] for r in series.spectrum(df, "k", ["i"], "v", most=most).collect()} for most in (100, 10_000))
    assert got.keys() == want.keys() == {1, 2, 3, None} and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in got) and got[1][0] == 997


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n[1]\n{"x": 2}\n')
    assert sorted(r.x for r in corpus.json_lines(spark, [str(tmp_path / "a.jsonl")], "x int").collect()) == [1, 2]
    (tmp_path / "jane_doe").mkdir()
    (tmp_path / "jane_doe" / "my_tale.txt").write_text("one\ntwo")
    assert [(r.author, r.title, r.text) for r in corpus.texts(spark, str(tmp_path)).collect()] == [("Jane Doe", "My Tale", "one\ntwo")]
    assert corpus.feed_entries("<rss><channel><item><title>T</title><link>u</link><description>d</description></item></channel></rss>") == [("T", "u", "d", "")]
    assert corpus.feed_entries("<broken") == [] and corpus.feed_entries("<a/>", most=2) == []
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("o/c.opf", '<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="t" href="toc.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="t"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        for n in ("a", "b", "toc"):
            z.writestr(f"o/{n}.xhtml", f"<html><head><title>x</title></head><body><p>text {n}</p></body></html>")
    (tmp_path / "book.epub").write_bytes(data.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in corpus.books(spark, str(tmp_path)).collect()) == [("bad.epub", None), ("book.epub", "text b\n\ntext a")]
    with pytest.raises(ValueError, match="no reader"):
        corpus.manifest(spark, "x.doc")


def test_words_of_long_texts_all_count(spark, tmp_path):
    spark.createDataFrame([(1, "left right " * 3500, "en", "a", 38500)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.n_words, r.n_distinct) for r in run("word_counts_per_doc")] == [(7000, 2)] and [r.n for r in run("repeat_rates")] == [7000]
    assert len(run("word_chunks")) == 14


def test_rubric_metrics_of_the_text_alone(spark):
    rows = spark.createDataFrame([(1, "novel", "One tree fell. A tree and one table stood there! Go"), (2, "poem", ""), (3, "poem", None)], "doc_id long, slice string, text string")
    got = {(r.doc_id, r.metric): r.value for r in programs.rubric_metrics(rows).collect()}
    cv = lambda x: pytest.approx(np.std(x) / np.mean(x))
    assert got[1, "word_hapax_ratio"] == pytest.approx(7 / 11) and got[1, "sent_words_cv"] == cv([3, 7, 1]) and got[1, "syllables_per_word_cv"] == cv([1] * 7 + [2] + [1] * 3)
    assert all(got[i, m] is None for i in (2, 3) for m in ("word_hapax_ratio", "sent_words_cv", "syllables_per_word_cv"))
