"""K-d tree partitioning into shards of near equal bytes.

Equal texts form one unit, with the bytes of all its rows; a unit larger than 1/100 of a shard is split into chunks that stay neighbours, so a hot group
spreads over as few shards as its bytes need. A node that must hold k shards is split where floor(k/2)/k of its bytes lie on one side, along its widest
dimension among length (logarithm), language and source, until each leaf holds one shard's bytes. Ties along a dimension are ordered by the hash of the text.

The weighted median of all nodes of a level is found by three aggregations with map-side sums: extents and quantiles per node, bytes between quantiles, and
bytes of 4096 cells of the stretch that holds the median (finer cells of
one cell, where that is still coarse). The driver gets a few thousand numbers a level, whatever the input. Built-in functions only.

Defined cases: a null text has no bytes (size is the overhead alone) and is a unit of its own kind; null languages and sources are one value; repeated
rows each get their slot; other columns are ignored; an empty table gives an empty result; fewer units than shards leave shards empty."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

DIMS = ["c_len", "c_lang", "c_source"]
QUANTILES, CELLS, ROUNDS, PARTS, SLOT_ROWS = 64, 4096, 5, 100, 50_000


def _constant(rows: list, kind: str) -> Column:
    """A literal of any type."""
    return F.from_json(F.lit(json.dumps(rows)), F.lit(kind))


def tree(units: DataFrame, shards: int) -> DataFrame:
    """units (bytes and the coordinates DIMS) with the column shard."""
    extent = units.agg(*[F.max(d).alias(f"hi_{d}") for d in DIMS], *[F.min(d).alias(f"lo_{d}") for d in DIMS]).first()
    whole = {d: max(1, (extent[f"hi_{d}"] or 0) - (extent[f"lo_{d}"] or 0)) for d in DIMS}
    nodes = [(0, shards)]  # first shard and number of shards of each node
    out = units.withColumn("node", F.lit(0))
    while any(k > 1 for _, k in nodes):
        probs = [i / QUANTILES for i in range(1, QUANTILES)]
        found = {r["node"]: r for r in out.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS], *[F.percentile_approx(d, probs, 1000).alias(f"q_{d}") for d in DIMS]).collect()}
        dims, edges, targets = [], [], []
        for i, (_, k) in enumerate(nodes):
            r = found.get(i)
            dim = max(range(len(DIMS)), key=lambda j: ((r[f"hi_{DIMS[j]}"] - r[f"lo_{DIMS[j]}"]) / whole[DIMS[j]], -j)) if r else 0
            dims.append(dim)
            edges.append([r[f"lo_{DIMS[dim]}"] - 1, *sorted(r[f"q_{DIMS[dim]}"]), r[f"hi_{DIMS[dim]}"]] if r else [0, 0])
            targets.append(r["bytes"] * (k // 2) / k if r else 0)
        out = out.withColumn("at", F.get(F.array(*DIMS), F.get(_constant(dims, "array<int>"), F.col("node"))))
        own = F.get(_constant(edges, "array<array<bigint>>"), F.col("node"))
        between = out.groupBy("node", F.size(F.filter(own, lambda e: e < F.col("at"))).alias("stretch")).agg(F.sum("bytes").alias("bytes")).collect()
        # the stretch (edges[s-1], edges[s]] that holds the target, and the bytes before it
        spans = []
        for i, es in enumerate(edges):
            held = dict.fromkeys(range(1, len(es)), 0) | {r["stretch"]: r["bytes"] for r in between if r["node"] == i}
            before = 0
            for s in range(1, len(es)):
                if before + held[s] >= targets[i] or s == len(es) - 1:
                    break
                before += held[s]
            spans.append({"lo": es[s - 1], "hi": es[s], "w": max(1, -(-(es[s] - es[s - 1]) // CELLS)), "before": before})
        best = [(abs(x["before"] - t), x["lo"]) for x, t in zip(spans, targets, strict=True)]
        for _ in range(ROUNDS):
            own = F.get(_constant(spans, "array<struct<lo:bigint,hi:bigint,w:bigint>>"), F.col("node"))
            inside = out.withColumn("span", own).where("at > span.lo and at <= span.hi").groupBy("node", F.expr("(at - span.lo - 1) div span.w").alias("cell")).agg(F.sum("bytes").alias("bytes")).collect()
            coarse = False
            for i, x in enumerate(spans):
                before, lo, nxt = x["before"], x["lo"], None
                for cell, held in sorted((r["cell"], r["bytes"]) for r in inside if r["node"] == i):
                    upto = min(x["hi"], lo + (cell + 1) * x["w"])
                    best[i] = min(best[i], (abs(before + held - targets[i]), upto))
                    if before < targets[i] <= before + held:
                        nxt = {"lo": lo + cell * x["w"], "hi": upto, "w": max(1, -(-x["w"] // CELLS)), "before": before}
                        coarse |= x["w"] > 1 and best[i][0] * 2000 > targets[i]
                    before += held
                spans[i] = nxt or {"lo": 0, "hi": 0, "w": 1, "before": 0}
            if not coarse:
                break
        cuts = [cut for _, cut in best]
        after, step = [], []
        for i, (first, k) in enumerate(nodes):
            step.append({"left": len(after), "cut": cuts[i] if k > 1 else 2**62})
            after += [(first, k // 2), (first + k // 2, k - k // 2)] if k > 1 else [(first, k)]
        own = F.get(_constant(step, "array<struct<left:int,cut:bigint>>"), F.col("node"))
        out = out.withColumn("step", own).withColumn("node", F.col("step.left") + (F.col("at") > F.col("step.cut")).cast("int")).drop("step", "at")
        out = materialise(out, "sharding-level")  # else the expressions of all levels meet in one
        nodes = after
    return out.withColumn("shard", F.get(_constant([first for first, _ in nodes], "array<int>"), F.col("node"))).drop("node")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", overhead: int = 16) -> DataFrame:
    """A row per row of df: key, size, text_crc32, shard and slot (0, 1, ... within the shard)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_k"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(F.col(text).isNull(), t).alias("g"),
        F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"), F.monotonically_increasing_id().alias("r"),
    )
    rows = materialise(rows, "sharding-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    part = max(1, total // (shards * PARTS))
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.min("l").alias("l"), F.min("s").alias("s"), F.max("size").alias("one"))
    large = groups.where(F.col("bytes") > part).select("g", F.ceil(F.col("bytes") / part).cast("int").alias("n"))  # shards * PARTS groups at most
    rows = rows.join(F.broadcast(large), "g", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("r"), F.col("n")), F.lit(0)).cast("int")).drop("n")
    first = groups.select("g", F.col("l").alias("gl"), F.col("s").alias("gs"))
    units = rows.groupBy("g", "chunk").agg(F.sum("size").alias("bytes"), F.max("size").alias("one")).join(first, "g")
    tie = F.shiftrightunsigned(F.col("g"), 44) * 4096 + F.least(F.col("chunk"), F.lit(4095))  # chunks of a unit stay neighbours
    wide = lambda v: (v.cast("long") * F.lit(2**32) + tie).cast("long")
    named = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(2**20))
    units = materialise(units.select("g", "chunk", "bytes", wide(F.floor(F.log2("one") * 4096)).alias("c_len"), wide(named("gl")).alias("c_lang"), wide(named("gs")).alias("c_source")), "sharding-units")
    placed = materialise(tree(units, shards).select("g", "chunk", "shard"), "sharding-leaves")
    buckets = max(64, -(-n // (shards * SLOT_ROWS)))
    rows = rows.join(placed, ["g", "chunk"]).withColumn("b", F.pmod(F.xxhash64("r"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "b").agg(F.count("*").alias("n")).withColumn("begin", F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).drop("n")  # a row per SLOT_ROWS rows
    slot = F.row_number().over(W.partitionBy("shard", "b").orderBy("_k", "crc", "size", "r")) - 1 + F.col("begin")
    return rows.join(F.broadcast(counts), ["shard", "b"]).select(F.col("_k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("long").alias("slot"))
