"""Names found in ranked steps, and rows kept in stages with accounts of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of distinct strings where s is part of l: s meets the strings with its rarest run of three characters, or with all of s if it is shorter; then it is compared whole."""
    runs = lambda n: long.select("l", F.explode(_grams(F.col("l"), n)).alias("g"))
    three = runs(3)
    counts = three.groupBy("g").count()
    anchors = short.where(F.length("s") >= 3).select("s", F.explode(_grams(F.col("s"))).alias("g")).join(counts, "g", "left")
    anchors = anchors.groupBy("s").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "g")).alias("a")).where("a.n > 0").select("s", F.col("a.g").alias("g"))
    met = anchors.join(three, "g").where(F.contains("l", "s")).select("s", "l")
    for n in (1, 2):
        met = met.unionByName(short.where(F.length("s") == n).join(runs(n), F.col("s") == F.col("g")).select("s", "l"))
    return met


def match_names(wants: DataFrame, names: DataFrame, want: str, name: str, order: str) -> DataFrame:
    """wants with `step` (1: the same but for case and outer blanks, 2: one is part of the other, 3: the last word of the want is a word of the name; null: none) and `found`, the name of least order in the first step that finds any.

    Distinct strings alone are compared, and no string meets all others. Null or blank names and wants find nothing; names of equal order go by the smaller name; repeated wants each get their answer."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    known = names.where(F.trim(name) != "").groupBy(plain(name).alias("l")).agg(F.min(F.struct(F.col(order).alias("order"), F.col(name).alias("name"))).alias("best"))
    asked = wants.where(F.trim(want) != "").select(plain(want).alias("s")).distinct()
    exact = asked.join(known, F.col("s") == F.col("l")).select("s", F.lit(1).alias("step"), "best")
    inner = _within(asked, known.select("l")).join(known, "l").select("s", F.lit(2).alias("step"), "best")
    outer = _within(known.select(F.col("l").alias("s")), asked.select(F.col("s").alias("l"))).select(F.col("s").alias("k"), F.col("l").alias("s"))
    outer = outer.join(known.withColumnRenamed("l", "k"), "k").select("s", F.lit(2).alias("step"), "best")
    words = known.select(F.explode(F.array_distinct(F.split("l", r"\s+"))).alias("w"), "best").groupBy("w").agg(F.min("best").alias("best"))
    last = asked.withColumn("w", F.element_at(F.split("s", r"\s+"), -1)).join(words, "w").select("s", F.lit(3).alias("step"), "best")
    best = exact.unionByName(inner).unionByName(outer).unionByName(last).groupBy("s").agg(F.min(F.struct("step", "best")).alias("m"))
    return wants.join(best, plain(want) == F.col("s"), "left").select(*[wants[c] for c in wants.columns], F.col("m.step").alias("step"), F.col("m.best.name").alias("found"))


def staged(df: DataFrame, order: str, stages: list[tuple[str, str, Column]]) -> DataFrame:
    """df with `skipped`: the name of the first stage that leaves a row out, null if it stays.

    Stages come in turn, over what those before kept: ('drop', condition) leaves out what meets it; ('first', key) keeps the row of least order of each key (null keys all stay), which equals a loop over rows in order with a set
    of keys seen for each stage. A key's least order is aggregated before anything is joined, so a key of a third of all rows is one row. order is unique."""
    names = [n for n, _, _ in stages]
    rows = df.withColumn("_skipped", F.lit(None).cast("string"))
    for name, kind, what in stages:
        stays = F.col("_skipped").isNull()
        if kind == "drop":
            rows = rows.withColumn("_skipped", F.when(stays & F.coalesce(what, F.lit(False)), name).otherwise(F.col("_skipped")))
            continue
        rows = rows.withColumn("_key", F.when(stays, what))
        first = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(order).alias("_first")).select(F.col("_first"), F.lit(True).alias("_is"))
        rows = rows.join(first, rows[order] == first["_first"], "left")
        rows = rows.withColumn("_skipped", F.when(F.col("_key").isNotNull() & F.col("_is").isNull(), name).otherwise(F.col("_skipped"))).drop("_key", "_first", "_is")
    assert len(set(names)) == len(names), "stages have names of their own"
    return rows.withColumnRenamed("_skipped", "skipped")


def accounts(rows: DataFrame, stages: list[str]) -> DataFrame:
    """stage, place, seen and skipped of rows that staged() gave, and what was kept as the last stage. Counts only: one row a stage."""
    counts = rows.groupBy(F.coalesce("skipped", F.lit("kept")).alias("stage")).count()
    table = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate([*stages, "kept"])], "stage string, place int")
    done = table.join(counts, "stage", "left").select("stage", "place", F.coalesce("count", F.lit(0)).alias("n"))
    later = done.alias("a").join(done.alias("b"), F.col("b.place") >= F.col("a.place")).groupBy("a.stage", "a.place", "a.n").agg(F.sum("b.n").alias("seen"))
    return later.select("stage", "place", "seen", F.when(F.col("stage") == "kept", 0).otherwise(F.col("n")).alias("skipped"))
