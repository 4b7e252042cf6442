"""Queries that SQL can't express: UDFs, iterations and streams. Tests compare them with direct computations."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import evaluation, models, scoring, series
from ..streaming import ingest
from .dialect import SENTENCE
from . import analysis
from .shared import kept as _kept
from .shared import shared_dir as _shared
from .shared import table as _table


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of the corpus, poems line by line, with what was changed."""
    docs = analysis.corpus_para(spark, sf_dir)
    return docs.select("doc_id", T.normalised_with_meta()("text", "doc_type").alias("n")).select("doc_id", "n.*")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.html_texts("html").alias("text"))


def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.verdicts("url").alias("verdict"))


def redirect_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first link of each page leads, taken as a redirect of the page's address."""
    link = F.regexp_extract("html", r'<a\s[^>]*href="([^"]*)"', 1)
    return _table(spark, sf_dir, "pages").select("page_id", urls.redirects("url", link).alias("r")).select("page_id", "r.*")


def corrupted(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: analysis.corpus_para(spark, sf_dir).select("doc_id", T.corrupted(kind, 1337)("text", "doc_id").alias("text"))


def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("later"))
    return turns.join(later, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.similarity("text", "later"), 6).alias("ratio"))


def spectral_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.spectrum(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's series against the next user's."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("a"))
    other = rows.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return series.warped(rows.join(other, "user_id"), "a", "b").select("user_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def nearest_centroid_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.centroid_folds(_table(spark, sf_dir, "embeddings"), "vec_id", "label", F.col("vec_id") % 5, "embedding")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against the predictions of the nearest centroid of the other folds."""
    return nearest_centroid_loo(spark, sf_dir).groupBy("label", "predicted").agg(F.count("*").alias("n"))


def _variation(a: Column) -> Column:
    """Standard deviation over mean of an array of two counts or more, not all 0."""
    total = lambda f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    mean = total(lambda x: x) / F.size(a)
    squares = total(lambda x: x * x) / F.size(a)  # the mean within the function would be computed for each element
    return F.when((F.size(a) >= 2) & (mean > 0), F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)) / mean)


TEXT_METRICS = ["word_ttr", "word_hapax_ratio", "sent_words_cv", "syllables_per_word_cv", "trigram_repeat_rate", "punct_variety_per_1000_chars"]


def rubric_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, slice, metric, value of the six rubric metrics that need the text alone."""
    word = "[A-Za-z]+"
    words = docs.select("doc_id", "slice", F.length("text").alias("n"), F.transform(F.regexp_extract_all("text", F.lit(word), F.lit(0)), lambda w: F.lower(w)).alias("w"), F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}\s]"), F.lit(0)).alias("p"), F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_count(x, F.lit(word))).alias("s"))
    words = words.withColumns({"o": F.array_sort("w"), "y": F.transform("w", T.vowel_groups)})
    other = lambda x, i: F.coalesce(F.get("o", i) != x, F.lit(True))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    values = {
        "word_ttr": F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.greatest(F.lit(1), F.size("w"))),
        "word_hapax_ratio": F.when(F.size("w") > 0, F.size(F.filter("o", lambda x, i: other(x, i - 1) & other(x, i + 1))) / F.greatest(F.lit(1), F.size("w"))),
        "sent_words_cv": _variation(F.col("s")),
        "syllables_per_word_cv": _variation(F.col("y")),
        "trigram_repeat_rate": F.when(F.size("w") >= 3, 1 - F.size(F.array_distinct(grams)) / F.greatest(F.lit(1), F.size("w") - 2)),
        "punct_variety_per_1000_chars": F.when(F.col("n") >= 200, 1000.0 * F.size(F.array_distinct("p")) / F.greatest(F.lit(1), F.col("n"))),
    }
    return words.select("doc_id", "slice", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("x")).select("doc_id", "slice", "x.*")


#: Measures of the token scorer that the rubric knows.
MODEL_METRICS = [m for _, _, m, _, _ in evaluation.RUBRIC if m in scoring.MEASURES]


def _rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with each of the 17 rubric metrics' value, percentile and score; the baseline of each document type and of all is 201 quantiles of each metric."""
    docs = analysis.corpus_para(spark, sf_dir).select("doc_id", F.col("doc_type").alias("slice"), "text")
    scored = analysis.analysis(spark, sf_dir, wanted=("s", "h", "width")).unpivot("doc_id", MODEL_METRICS, "metric", "value")
    long = _kept(rubric_metrics(docs).unionByName(docs.select("doc_id", "slice").join(scored, "doc_id")))
    slices = F.explode(F.array_distinct(F.array(F.coalesce("slice", F.lit("all")), F.lit("all")))).alias("slice")
    baseline = long.where(F.col("value").isNotNull()).select(slices, "metric", "value").groupBy("slice", "metric").agg(F.percentile("value", [i / 200 for i in range(201)]).alias("values"))
    return evaluation.rubric_rows(long, baseline)


def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overall(evaluation.categories(_rubric(spark, sf_dir)))


def rubric_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst(_rubric(spark, sf_dir))


def rubric_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.improvements(_rubric(spark, sf_dir))


def rubric_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.critique(_rubric(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """doc_id and the scores of categories and metrics as columns c_ and m_; missing ones are 0.5."""
    rows = _kept(_rubric(spark, sf_dir))
    long = rows.select("doc_id", F.concat(F.lit("m_"), "metric").alias("name"), "score").unionByName(evaluation.categories(rows).select("doc_id", F.concat(F.lit("c_"), "category").alias("name"), "score"))
    names = [f"c_{c}" for c in evaluation.LIMITS] + [f"m_{m}" for _, _, m, _, _ in evaluation.RUBRIC if m in MODEL_METRICS or m in TEXT_METRICS]
    return _kept(long.groupBy("doc_id").pivot("name", names).agg(F.first("score")).fillna(0.5, names)), names


def calibrator_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, n, accuracy and auc of a calibrator that learns `quality` from rubric scores; a fifth of the labelled documents, by the crc32 of doc_id, is held out."""
    feats, names = _features(spark, sf_dir)
    rows = feats.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").where("y IS NOT NULL")
    rows = rows.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return evaluation.report(rows.withColumn("p", models.train_direct(rows.where("NOT held_out"), names, "y").score() / 100), "held_out", "y", "p")


def preference_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score of 0 to 100, the feature that moves it most and which way: a preference model over pairs of a good and a bad document each, dealt by hash."""
    feats, names = _features(spark, sf_dir)
    labelled = feats.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    parts = max(1, labelled.count() // 64)  # of about 64 documents each, however many there are
    dealt = labelled.withColumn("part", F.crc32(F.col("doc_id").cast("string")) % parts).withColumn("k", F.row_number().over(W.partitionBy("quality", "part").orderBy("doc_id")))
    side = lambda q, prefix: dealt.where(F.col("quality") == q).select("part", "k", *[F.col(n).alias(prefix + n) for n in names])
    model = models.train_pairs(side(1, "chosen_").join(side(0, "rejected_"), ["part", "k"]), names)
    return feats.select("doc_id", F.bround(model.score(), 0).cast("int").alias("score"), model.leverage()[0]["name"].alias("feature"), model.leverage()[0]["way"].alias("way"))


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of available files, compacted by user."""
    home = f"{_shared(spark)}/ingest-{os.urandom(8).hex()}"
    events = _table(spark, sf_dir, "events")
    events.repartition(3, "user_id").write.parquet(f"{home}/in")
    ingest.ingest(spark, f"{home}/in", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), f"{home}/out", f"{home}/state", 1)
    return ingest.compacted(spark.read.parquet(f"{home}/out").drop("batch", "batch_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_text": normalize_text, "html_to_text": html_to_text, "url_safety": url_safety, "redirect_safety": redirect_safety, **{f"corrupt_{k}": corrupted(k) for k in T.KINDS}, "similarity_ratio": similarity_ratio, "spectral_peak": spectral_peak, "dtw": dtw,
    "nearest_centroid_loo": nearest_centroid_loo, "rubric_score": rubric_score, "rubric_worst": rubric_worst, "rubric_improvements": rubric_improvements, "rubric_critique": rubric_critique,
    "calibrator_training": calibrator_training, "preference_training": preference_training, "incremental_ingest": incremental_ingest,
}
QUERIES["confusion"] = confusion
#: Those that SQL can express all the same.
ORACLES = {
    "html_to_text": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)</(?:p|div|section|article|h[1-6]|li|br|tr)>', chr(10), 'g'), '(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>', '', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""",
    "url_safety": r"""SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*@') THEN 'userinfo' WHEN h = '' OR regexp_matches(h, '(^|[.])(localhost|local|internal)$') THEN 'host'
 WHEN regexp_matches(h, '^(0|10|127|169[.]254|192[.]168|172[.](1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.][0-9.]+$') THEN 'address' ELSE 'ok' END AS verdict FROM (SELECT page_id, url, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS h FROM pages)""",
    "redirect_safety": r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(html, '<a\s[^>]*href="([^"]*)"', 1) AS target, 'ok' AS verdict FROM pages""",
    "incremental_ingest": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "nearest_centroid_loo": "WITH r AS (SELECT vec_id, label, vec_id % 5 AS fold, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT f.fold AS out, r.label AS predicted, r.i, avg(r.x) AS m FROM r JOIN (SELECT DISTINCT fold FROM r) f ON r.fold <> f.fold GROUP BY 1, 2, 3), d AS (SELECT r.vec_id, r.fold, r.label, c.predicted, 1 - sum(r.x * c.m) / (sqrt(sum(r.x * r.x)) * sqrt(sum(c.m * c.m)) + 1e-12) AS d FROM r JOIN c ON r.fold = c.out AND r.i = c.i GROUP BY 1, 2, 3, 4) SELECT vec_id, fold, label, predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), predicted) AS k FROM d) WHERE k = 1",
}
ORACLES["confusion"] = f"SELECT label, predicted, count(*) AS n FROM ({ORACLES['nearest_centroid_loo']}) p GROUP BY label, predicted"
