"""Nearest centroids by folds, and rubric scores against baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import plateau_score

#: Fixed values of the rubric: category, its weight, metric, its weight, mode (m: match the baseline, h: higher, l: lower is better).
RUBRIC = [
    ("focus", 0.25, "entropy_mean", 0.375, "m"), ("focus", 0.25, "nucleus_w_mean", 0.375, "m"), ("focus", 0.25, "word_ttr", 0.25, "m"),
    ("cadence", 0.25, "high_surprise_rate_per_100", 0.25, "m"), ("cadence", 0.25, "ipi_mean", 0.25, "m"), ("cadence", 0.25, "cooldown_entropy_drop_3", 0.20, "m"), ("cadence", 0.25, "sent_burst_cv", 0.10, "m"),
    ("cadence", 0.25, "para_burst_cv", 0.10, "m"), ("cadence", 0.25, "sent_words_cv", 0.07, "m"), ("cadence", 0.25, "syllables_per_word_cv", 0.03, "m"),
    ("cohesion", 0.20, "cohesion_delta", 0.70, "l"), ("cohesion", 0.20, "trigram_repeat_rate", 0.30, "l"),
    ("alignment", 0.15, "spike_next_content_rate", 0.6, "h"), ("alignment", 0.15, "spike_prev_punct_rate", 0.4, "l"),
    ("distinctiveness", 0.15, "content_fraction", 0.40, "m"), ("distinctiveness", 0.15, "word_hapax_ratio", 0.35, "m"), ("distinctiveness", 0.15, "punct_variety_per_1000_chars", 0.25, "m"),
]


#: Other names of slices.
SYNONYMS = {"story": "shortstory", "short_story": "shortstory", "short-story": "shortstory", "poetry": "poem"}


def sliced(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """The metrics with the slice of the baseline that each row is held against: its own, else the one that it is another name of, else 'all'. Null slices take 'all'. Slices are few."""
    name = F.lower(F.trim("slice"))
    other = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    known = baseline.select(F.col("slice").alias("_known")).distinct()
    rows = metrics.withColumn("_own", F.coalesce(name, F.lit(""))).withColumn("_own", F.coalesce(F.try_element_at(other, F.col("_own")), F.col("_own")))
    return rows.join(F.broadcast(known), F.col("_own") == F.col("_known"), "left").withColumn("slice", F.coalesce("_known", F.lit("all"))).drop("_own", "_known")


def rubric_rows(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """The metrics (slice, metric, value and a key) with category, cat_w, metric_w, mode, percentile of 0 to 100 and score of 0 to 1.08.

    Metrics that are null or not finite, unknown, or without a baseline are left out. A baseline holds at most a few hundred sorted values for each slice and metric."""
    table = metrics.sparkSession.createDataFrame(RUBRIC, "category string, cat_w double, metric string, metric_w double, mode string")
    rows = sliced(metrics, baseline).join(F.broadcast(table), "metric").join(F.broadcast(baseline), ["slice", "metric"])
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.size("values") > 0))
    p = 100 * F.size(F.filter("values", lambda v: v <= F.col("value"))) / F.size("values")
    score = F.when(F.col("mode") == "h", p / 100).when(F.col("mode") == "l", 1 - p / 100).otherwise(plateau_score(p))
    return rows.withColumn("percentile", p).withColumn("score", score).drop("values")


def rubric(metrics: DataFrame, baseline: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, category, score: metrics (key, slice, metric, value) against baseline (slice, metric, values sorted). Metrics without a value or baseline don't count, and their weight goes to the others."""
    return categories(rubric_rows(metrics, baseline), key)


def categories(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key, "category").agg((F.sum(F.col("metric_w") * F.col("score")) / F.sum("metric_w")).alias("score"), F.first("cat_w").alias("cat_w"))


def worst(rows: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The k metrics of least score of each key; ties go by metric."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.round("score", 9), "metric"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "metric", "score", "percentile")


def improvements(rows: DataFrame, k: int = 3, key: str = "doc_id", least: float = 0.005) -> DataFrame:
    """The k metrics of each key that would raise its overall score most, with the gain and the way that the metric is off; gains below `least` don't count."""
    gain = F.col("cat_w") * F.col("metric_w") * F.greatest(F.lit(0.0), 1 - F.col("score"))
    way = F.when(F.col("mode") == "h", "too_low").when(F.col("mode") == "l", "too_high").when(F.col("percentile") < 25, "too_low").when(F.col("percentile") > 75, "too_high").otherwise("flat")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.round("gain", 9).desc(), "metric"))
    return rows.withColumn("gain", gain).where(F.col("gain") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "category", "metric", "score", "gain", way.alias("direction"))


def percentile_hint(p: Column) -> Column:
    """12th (low), 50th, 93th (high); N/A for null. Low is below 20, high above 80."""
    number = F.format_string("%.0fth", F.bround(p, 0))
    return F.when(p.isNull(), "N/A").when(p < 20, F.concat(number, F.lit(" (low)"))).when(p > 80, F.concat(number, F.lit(" (high)"))).otherwise(number)


#: A category's advice is due below this score; that on rhythm above this variation of sentences.
LIMITS, BURST = {"focus": 0.55, "cadence": 0.55, "alignment": 0.60, "cohesion": 0.55, "distinctiveness": 0.55}, 0.7


def critique(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, advice (names of categories below their limits, then `rhythm` if sentences vary too much; `detail` if nothing else) and evidence (metric: hint, by metric, of the categories named)."""
    by_category = categories(rows, key).withColumn("low", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair]), F.col("category")) > F.col("score"), F.lit(False)))
    hints = rows.join(by_category.select(key, "category", "low"), [key, "category"]).groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("low"), F.col("category")))).alias("named"),
        F.max(F.when((F.col("metric") == "sent_burst_cv"), F.col("value"))).alias("burst"),
        F.array_sort(F.collect_list(F.when(F.col("low"), F.concat_ws(": ", "metric", percentile_hint(F.col("percentile")))))).alias("evidence"),
    )
    named = F.concat(F.filter(F.array(*[F.lit(c) for c in LIMITS]), lambda c: F.array_contains("named", c)), F.when(F.col("burst") > BURST, F.array(F.lit("rhythm"))).otherwise(F.array().cast("array<string>")))
    return hints.select(key, F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("detail"))).alias("advice"), "evidence")


def overall(categories: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the weighted overall score of 0 to about 108, and the same no higher than 100."""
    out = categories.groupBy(key).agg((100 * F.sum(F.col("cat_w") * F.col("score")) / F.sum("cat_w")).alias("overall"))
    return out.withColumn("overall_clamped", F.least(F.lit(100.0), "overall"))


def report(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """group, n, accuracy at 0.5 and auc (tied scores count half) of scores for 0/1 labels; auc is null where a label is missing. Counts are taken by distinct score first."""
    counts = df.groupBy(group, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), F.sum((F.col(label) == (F.col(score) >= 0.5).cast("int")).cast("int")).alias("right"))
    below = F.sum(F.col("n") - F.col("pos")).over(W.partitionBy(group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    wins = F.col("pos") * (F.coalesce(below, F.lit(0.0)) + (F.col("n") - F.col("pos")) / 2)
    out = counts.withColumn("wins", wins).groupBy(group).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), F.sum("wins").alias("w"), F.sum("pos").alias("p"))
    return out.select(group, "n", "accuracy", F.try_divide("w", F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def centroid_folds(df: DataFrame, key: str, label: str, fold: Column, vector: str) -> DataFrame:
    """key, fold, label and predicted: the label whose centroid over the other folds is nearest by cosine; ties go to the smaller label. Labels and folds are few, rows any number."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), fold.alias("fold"), F.col(vector).cast("array<double>").alias("v"))
    sums = rows.select("label", "fold", F.posexplode("v").alias("i", "x")).groupBy("label", "fold", "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    folds = sums.select("fold").distinct().withColumnRenamed("fold", "out")
    means = sums.join(F.broadcast(folds), F.col("fold") != F.col("out")).groupBy("out", "label", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    centres = means.groupBy("out", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c")).withColumnRenamed("label", "predicted")
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = rows.join(F.broadcast(centres), F.col("fold") == F.col("out")).withColumn("d", 1 - dot / (norm(F.col("v")) * norm(F.col("c")) + 1e-12))
    best = F.row_number().over(W.partitionBy("key").orderBy(F.round("d", 9), "predicted"))
    return near.withColumn("k", best).where("k = 1").select(F.col("key").alias(key), "fold", "label", "predicted")
