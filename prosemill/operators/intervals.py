"""Joins of places and intervals along an axis within keys: containment, overlap and the last one before.

The axis is cut into cells, and an interval belongs to the cells that it covers, so the join is by equality of (key, level, cell) and bounds are checked
on what meets there. Long intervals would cover many cells: each stands on the level whose cells are 8 times wider than the level before and cover it in
ten at most. Levels present are few (21 span all long numbers). A key that holds a third of all rows is dealt by its cells.

Intervals are half open: [start, end). Defined cases: null keys, places or bounds, and empty intervals, meet nothing; repeated rows meet by themselves; an
empty side gives no rows (with outer: each place with nulls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider the cells of the next level are.
WIDER = 8


def _width(level: Column, cell: int) -> Column:
    return (F.pow(F.lit(WIDER), level) * cell).cast("long")


def _levelled(spans: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    level = F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), (F.col(end) - F.col(start)) / F.lit(float(cell))))).cast("int")
    return spans.where(F.col(start) < F.col(end)).withColumn("_level", level)


def _levels(*tables: DataFrame) -> list[int]:
    """Levels present: 22 at most."""
    return sorted({r[0] for t in tables for r in t.select("_level").distinct().collect()})


def contained(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, how: str = "all", outer: bool = False, cell: int = 256) -> DataFrame:
    """Columns of points and, as a struct `span`, of the spans (all but the key) that hold each: start <= at < end. how: 'all', or 'first': the least (start, end), further columns decide ties."""
    held = _levelled(spans, start, end, cell)
    levels = _levels(held)
    columns = [start, end, *[c for c in spans.columns if c not in (key, start, end)]]
    w = _width(F.col("_level"), cell)
    cells = F.explode(F.sequence(F.floor(F.col(start) / w), F.floor((F.col(end) - 1) / w)))
    held = held.select(F.col(key).alias("_key"), "_level", cells.alias("_cell"), F.struct(*columns).alias("span"))
    rows = points.withColumn("_row", F.monotonically_increasing_id()) if how == "first" or outer else points
    near = rows.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_cell", F.floor(F.col(at) / w))
    same = (F.col(key) == F.col("_key")) & (near["_level"] == held["_level"]) & (near["_cell"] == held["_cell"])
    within = (F.col(f"span.{start}") <= F.col(at)) & (F.col(at) < F.col(f"span.{end}"))
    met = near.join(held, same & within).select(*rows.columns, "span")
    if how == "first":
        met = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in points.columns], F.min("span").alias("span"))
    if outer:
        alone = rows.join(met.select("_row").distinct(), "_row", "left_anti")
        met = met.select(*points.columns, "span").unionByName(alone.select(*points.columns), allowMissingColumns=True)
    return met.select(*points.columns, "span")


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, cell: int = 256) -> DataFrame:
    """key and the structs `left` and `right` (all other columns) of each pair of intervals of a key that share a place: left.start < right.end and right.start < left.end.

    Both sides go to the cells of their own level and of the coarser ones present; a pair meets once, on the coarser of its levels in the first cell that both cover."""
    sides = [_levelled(t, start, end, cell) for t in (left, right)]
    levels = F.array(*[F.lit(x) for x in _levels(*sides)]).cast("array<int>")

    def dealt(t: DataFrame, name: str) -> DataFrame:
        own = [c for c in t.columns if c not in (key, "_level")]
        rows = t.select(F.col(key).alias("_key"), F.col("_level").alias(f"_{name}"), F.struct(*own).alias(name), F.explode(F.filter(levels, lambda x: x >= F.col("_level"))).alias("_on"))
        w = _width(F.col("_on"), cell)
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{name}.{start}") / w), F.floor((F.col(f"{name}.{end}") - 1) / w))))

    met = dealt(sides[0], "left").join(dealt(sides[1], "right"), ["_key", "_on", "_cell"])
    first = F.floor(F.greatest(f"left.{start}", f"right.{start}") / _width(F.col("_on"), cell))
    share = (F.col(f"left.{start}") < F.col(f"right.{end}")) & (F.col(f"right.{start}") < F.col(f"left.{end}"))
    return met.where((F.col("_on") == F.greatest("_left", "_right")) & (F.col("_cell") == first) & share).select(F.col("_key").alias(key), "left", "right")


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, cell: int = 4096) -> DataFrame:
    """Columns of points and, as a struct `last`, of the mark (all but the key) of greatest place up to and with each point's; null if there is none. Among equal places further columns decide.

    Within a cell, points and marks are merged by one window; what earlier cells leave is carried over the cells alone."""
    columns = [mark, *[c for c in marks.columns if c not in (key, mark)]]
    facts = marks.where(F.col(mark).isNotNull()).select(F.col(key).alias("_key"), F.floor(F.col(mark) / cell).alias("_cell"), F.col(mark).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_mark"), F.lit(None).alias("_point"))
    asked = points.select(F.col(key).alias("_key"), F.floor(F.col(at) / cell).alias("_cell"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_mark"), F.struct(*points.columns).alias("_point"))
    rows = facts.unionByName(asked)
    inside = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_mark", ignorenulls=True).over(inside)).where("_kind = 1")
    cells = facts.select("_key", "_cell", "_mark").unionByName(asked.select("_key", "_cell", "_mark")).groupBy("_key", "_cell").agg(F.max("_mark").alias("_most"))
    carried = cells.withColumn("_carried", F.last("_most", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    met = rows.join(carried, (rows["_key"].eqNullSafe(carried["_key"])) & (rows["_cell"].eqNullSafe(carried["_cell"])), "left")
    return met.select("_point.*", F.when(rows["_key"].isNotNull() & F.col("_at").isNotNull(), F.coalesce("_in", "_carried")).alias("last"))
