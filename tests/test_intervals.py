"""Interval joins against loops."""

import random

import pytest
from pyspark.sql import functions as F

from prosemill.operators import intervals


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    spans = []
    for i in range(300):
        a = rng.randint(-50, 3000)
        spans.append((rng.choice("aab"), a, a + rng.choice([0, 1, 3, 20, 20, 300, 5000]), i))
    spans += [(None, 1, 5, 900), ("a", None, 5, 901), ("a", 7, 7, 902), ("a", 10, 12, 903), ("a", 10, 12, 903), ("a", 2**40, 2**41, 904)]
    points = [(rng.choice("abc"), rng.randint(-60, 4000), i) for i in range(200)] + [(None, 3, 900), ("a", None, 901), ("a", 11, 902), ("a", 11, 902), ("a", 2**40 + 5, 903)]
    return spark.createDataFrame(spans, "k string, s long, e long, i int"), spark.createDataFrame(points, "k string, p long, j int"), spans, points


def holds(p, s):
    return p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= p[1] < s[2]


@pytest.mark.parametrize("cell", [1, 16, 256])
def test_contained(tables, cell):
    spans, points, span_rows, point_rows = tables
    got = sorted((r.k, r.p, r.j, r.span.i) for r in intervals.contained(points, spans, "k", "p", "s", "e", cell=cell).collect())
    assert got == sorted((*p, s[3]) for p in point_rows for s in span_rows if holds(p, s))
    first = intervals.contained(points, spans, "k", "p", "s", "e", how="first", outer=True, cell=cell).collect()
    want = [(*p, min(((s[1], s[2], s[3]) for s in span_rows if holds(p, s)), default=None)) for p in point_rows]
    assert sorted(((r.k, r.p, r.j, None if r.span is None else tuple(r.span)) for r in first), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("cell", [1, 64])
def test_overlapping(tables, cell):
    spans, _, rows, _ = tables
    other = spans.where("i % 3 = 0")
    got = sorted((r.k, r.left.i, r.right.i) for r in intervals.overlapping(spans, other, "k", "s", "e", cell).collect())
    share = lambda a, b: a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]
    assert got == sorted((a[0], a[3], b[3]) for a in rows for b in rows if b[3] % 3 == 0 and share(a, b))


@pytest.mark.parametrize("cell", [3, 4096])
def test_last_before(tables, cell):
    spans, points, span_rows, point_rows = tables
    got = intervals.last_before(points, spans.select("k", "s", "i"), "k", "p", "s", cell).collect()
    want = [(*p, max(((s[1], s[3]) for s in span_rows if p[0] is not None and s[0] == p[0] and None not in (s[1], p[1]) and s[1] <= p[1]), default=None)) for p in point_rows]
    assert sorted(((r.k, r.p, r.j, None if r["last"] is None else tuple(r["last"])) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_sides(tables):
    spans, points, _, rows = tables
    assert intervals.contained(points, spans.limit(0), "k", "p", "s", "e").count() == 0 == intervals.overlapping(spans, spans.limit(0), "k", "s", "e").count()
    assert intervals.contained(points, spans.limit(0), "k", "p", "s", "e", outer=True).where(F.col("span").isNull()).count() == len(rows)
    assert intervals.last_before(points, spans.select("k", "s").limit(0), "k", "p", "s").where(F.col("last").isNull()).count() == len(rows)
