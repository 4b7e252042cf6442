"""Rubric, advice, reports and trained scorers against direct computations on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill import catalog
from prosemill.operators import evaluation, models

BASE = [("all", m, [float(x) for x in range(1, 101)]) for _, _, m, _, _ in evaluation.RUBRIC] + [("poem", "word_ttr", [0.0, 1000.0])]


@pytest.fixture(scope="module")
def rows(spark):
    baseline = spark.createDataFrame(BASE, "slice string, metric string, values array<double>")
    values = [
        (1, "prose", "word_ttr", 50.0), (1, "prose", "entropy_mean", 12.0), (1, None, "cohesion_delta", 95.0), (1, "prose", "spike_next_content_rate", 20.0), (1, "prose", "sent_burst_cv", 0.9),
        (2, "poetry", "word_ttr", 50.0), (2, "poem", "entropy_mean", 50.0), (3, "novel", "word_ttr", None), (3, "novel", "entropy_mean", float("nan")), (3, "novel", "unknown", 1.0), (4, " Novel ", "cohesion_delta", 0.0),
    ]
    return evaluation.rubric_rows(spark.createDataFrame(values, "doc_id long, slice string, metric string, value double"), baseline)


def test_slices_fall_back_and_values_without_meaning_do_not_count(rows):
    got = {(r.doc_id, r.metric): (r.slice, r.percentile) for r in rows.collect()}
    assert got[1, "word_ttr"] == ("all", 50.0) and got[1, "cohesion_delta"] == ("all", 95.0)
    assert got[2, "word_ttr"] == ("poem", 50.0) and (2, "entropy_mean") not in got  # the slice is there, the metric isn't
    assert not any(k[0] == 3 for k in got) and got[4, "cohesion_delta"] == ("all", 0.0)


def test_scores_gains_and_worst(rows):
    scores = {r.metric: r.score for r in rows.where("doc_id = 1").collect()}
    assert scores["word_ttr"] == 1 and scores["entropy_mean"] == pytest.approx(12 / 25) and scores["cohesion_delta"] == pytest.approx(0.05) and scores["spike_next_content_rate"] == pytest.approx(0.2)
    got = [(r.metric, r.direction, round(r.gain, 6)) for r in evaluation.improvements(rows).where("doc_id = 1").orderBy("rank").collect()]
    assert got == [("cohesion_delta", "too_high", round(0.2 * 0.7 * 0.95, 6)), ("spike_next_content_rate", "too_low", round(0.15 * 0.6 * 0.8, 6)), ("entropy_mean", "too_low", round(0.25 * 0.375 * 0.52, 6))]
    assert [r.metric for r in evaluation.worst(rows, 2).where("doc_id = 1").orderBy("rank").collect()] == ["sent_burst_cv", "cohesion_delta"]
    assert evaluation.improvements(rows).where("doc_id = 2").count() == 0


def test_advice(rows):
    got = {r.doc_id: (r.advice, r.evidence) for r in evaluation.critique(rows).collect()}
    assert got[1][0] == ["cadence", "alignment", "cohesion", "rhythm"] and "cohesion_delta: 95th (high)" in got[1][1]
    assert got[2] == (["detail"], []) and 3 not in got


def test_report_counts_ties_by_half(spark):
    df = spark.createDataFrame([(True, 1, 0.9), (True, 0, 0.9), (True, 0, 0.1), (True, 1, 0.4), (False, 1, 0.7)], "g boolean, y int, p double")
    got = {r.g: r for r in evaluation.report(df, "g", "y", "p").collect()}
    assert (got[True].n, got[True].accuracy, got[True].auc) == (4, 0.5, pytest.approx((0.5 + 1 + 0 + 1) / 4)) and got[False].auc is None
    assert evaluation.report(df.where("false"), "g", "y", "p").count() == 0


def test_leverage_names_the_feature_that_moves_most(spark):
    scorer = models.Scorer(["a", "b"], [2.0, -1.0], 0.0, [0.0, 0.0], [1.0, 1.0])
    df = spark.createDataFrame([(1.0, 3.0), (-2.0, 0.5), (None, None)], "a double, b double")
    got = [[(x.name, x.way) for x in r[0]][0] for r in df.select(scorer.leverage()).collect()]
    assert got[:2] == [("b", "lower"), ("a", "raise")]


def test_cadence_metrics_of_one_text(spark, tmp_path):
    text = "a b a b a c. a b"
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "", "en", "s", 0), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["cadence_metrics"](spark, str(tmp_path))
    (row,) = df.collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(zip(con.sql(catalog.ORACLES["cadence_metrics"]).columns, con.sql(catalog.ORACLES["cadence_metrics"]).fetchall()[0], strict=True))
    assert row.asDict() == pytest.approx(want, nan_ok=True)
    assert row.doc_id == 1 and row.content_fraction == 0


def test_preferences_are_scored_for_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") >= 200)
    scored = catalog.QUERIES["preference_training"](spark, sf)
    assert scored.where("score BETWEEN 0 AND 100 AND way IN ('raise', 'lower', 'on_track')").count() == scored.count() >= docs.count()
