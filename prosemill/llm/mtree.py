"""Exact top-k by inner product with M-trees.

Rows are dealt into blocks; each block becomes one M-tree, built once and written to the shared folder. A tree has pages of entries: a routing object (one of
the vectors), its covering radius, and its distance to the page's own routing object; leaves hold vectors and their distances to the leaf's. Each block of
queries meets each tree once. Search is best-first for each query, in step for the queries of a block: q.x <= q.c + |q| radius for all x below c, and the stored distances to the parent bound q.c and q.x by the
triangle inequality before anything is computed: q.x <= (|q|^2 + |x|^2 - (d(q,p) - d(x,p))^2) / 2. Nodes and vectors whose bound lies under the k-th score so far
are skipped; bounds that reach it are not, so ties are found. The best k of each tree are merged for the result.

Scores are exact whatever the components: where they might pass 2^53 products are computed in 64-bit integers, and where they might pass 2^63 in integers of any size
(a score beyond 64 bits counts as the last within).

Defined cases: vectors that are null or hold a null or non-finite component and rows with a null id take no part; a shorter vector counts as one with zeros behind it; a component
beyond 64 bits once scaled counts as the last within; a row isn't its own candidate, but another row with its id is; each query row asks for itself, also of several
with one id; fewer candidates than k give fewer rows; identical vectors share pages; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

PAGE, FANOUT = 512, 16
#: Slack of bounds, which are computed in floating point, absolute and as a share of the largest product; scores are integers.
SLACK, SHARE = 1e-3, 1e-11
#: Bytes of the vectors of a tree at most.
TREE_BYTES = 32_000_000


def build(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> dict:
    """The tree as arrays by node (root first): routing vector, covering radius, distance to the parent's, first and end of children or of vectors."""
    v = vectors.astype(np.float64)
    order, centres, radii, parents, spans, leaves = [], [], [], [], [], []
    queue = [(np.arange(len(ids)), None)]
    at = 0
    while at < len(queue):  # breadth first: children of a node are neighbours
        held, up = queue[at]
        at += 1
        mean = v[held].mean(0)
        centre = v[held[((v[held] - mean) ** 2).sum(1).argmin()]]
        d = np.sqrt(((v[held] - centre) ** 2).sum(1))
        centres.append(centre)
        radii.append(d.max())
        parents.append(0.0 if up is None else math.sqrt(((centre - up) ** 2).sum()))
        if len(held) <= page:
            spans.append((sum(map(len, order)), len(held)))
            order.append(held)
            leaves.append(True)
            continue
        m = min(fanout, -(-len(held) // page))
        pivots = [int(d.argmax())]  # farthest first
        near = ((v[held] - v[held[pivots[0]]]) ** 2).sum(1)
        own = np.zeros(len(held), np.int64)
        while len(pivots) < m and near.max() > 0:
            pivots.append(int(near.argmax()))
            far = ((v[held] - v[held[pivots[-1]]]) ** 2).sum(1)
            closer = far < near
            own[closer], near = len(pivots) - 1, np.minimum(near, far)
        groups = [held[own == i] for i in range(len(pivots))] if len(pivots) > 1 else [held[i : i + page] for i in range(0, len(held), page)]
        groups = [g for g in groups if len(g)]
        spans.append((len(queue), len(groups)))
        leaves.append(False)
        queue += [(g, centre) for g in groups]
    perm = np.concatenate(order)
    to_leaf = np.empty(len(perm))
    for i, leaf in enumerate(leaves):
        if leaf:
            a, n = spans[i]
            to_leaf[a : a + n] = np.sqrt(((v[perm[a : a + n]] - centres[i]) ** 2).sum(1))
    c, x = np.array(centres), v[perm]
    return {"rows": rows[perm], "ids": ids[perm], "v": vectors[perm], "x": x, "xx": (x * x).sum(1), "dx": to_leaf, "c": c, "cc": (c * c).sum(1), "r": np.array(radii), "dp": np.array(parents), "span": np.array(spans), "leaf": np.array(leaves)}


def _products(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """x @ y.T of integers, exact, cut to the range of 64 bits; most: a bound of its magnitude."""
    if most < 2**53:
        return x.astype(np.float64) @ y.astype(np.float64).T
    if most < 2**63:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return np.clip(x.astype(object) @ y.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(t: dict, asks: np.ndarray, own: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], int]:
    """Scores, ids and rows of the best k for each of asks, ties to smaller ids and then rows, and the number of vectors whose products were computed. own: the queries' rows.

    Each query goes best-first by a heap of its own; in each round, queries that are at the same page compute with it together."""
    whole = asks
    top = lambda a: max((abs(int(x)) for x in (a.min(), a.max())), default=0) if a.size else 0
    most = top(asks) * top(t["v"]) * asks.shape[1]
    slack = SLACK + SHARE * most
    asks = asks.astype(np.float64)
    qq = (asks * asks).sum(1)
    norm = np.sqrt(qq)
    dots = asks @ t["c"][0]
    heaps = [[(-b, 0, d)] for b, d in zip((dots + norm * t["r"][0]).tolist(), np.sqrt(np.maximum(0, qq + t["cc"][0] - 2 * dots)).tolist(), strict=True)]
    least, computed = np.full(len(asks), -math.inf), 0
    scores, ids, found_rows = [np.zeros(0, np.float64 if most < 2**53 else np.int64)] * len(asks), [np.zeros(0, np.int64)] * len(asks), [np.zeros(0, np.int64)] * len(asks)
    active = list(range(len(asks)))
    while active:
        at: dict[int, list[tuple[int, float]]] = {}
        going, floor = [], least.tolist()
        for i in active:
            if heaps[i] and slack - heaps[i][0][0] >= floor[i]:
                _, node, d = heapq.heappop(heaps[i])
                at.setdefault(node, []).append((i, d))
                going.append(i)
        active = going
        for node, group in at.items():
            who, d = np.array([i for i, _ in group]), np.array([d for _, d in group])
            a, n = t["span"][node]
            low = least[who] - slack
            if t["leaf"][node]:
                # by the triangle inequality, from distances to the page's routing object alone
                may = (qq[who] + t["xx"][a : a + n, None] - (d - t["dx"][a : a + n, None]) ** 2) / 2 >= low
                rows = a + np.flatnonzero(may.any(1))
                if not len(rows):
                    continue
                computed += len(rows) * len(who)
                s = _products(t["x"][rows] if most < 2**53 else t["v"][rows], asks[who] if most < 2**53 else whole[who], most)
                hit = (s.astype(np.float64) >= low) & (t["rows"][rows][:, None] != own[who])
                for j in np.flatnonzero(hit.any(0)).tolist():
                    i, found = who[j], rows[hit[:, j]]
                    sc, ix, rx = np.concatenate([scores[i], s[hit[:, j], j]]), np.concatenate([ids[i], t["ids"][found]]), np.concatenate([found_rows[i], t["rows"][found]])
                    best = np.lexsort((rx, ix, ~sc if sc.dtype == np.int64 else -sc))[:k]
                    scores[i], ids[i], found_rows[i] = sc[best], ix[best], rx[best]
                    if len(best) == k:
                        least[i] = float(sc[best[-1]])
            else:
                kids = np.arange(a, a + n)
                bound = (qq[who] + t["cc"][kids, None] - (d - t["dp"][kids, None]) ** 2) / 2 + norm[who] * t["r"][kids, None]
                kids = kids[(bound >= low).any(1)]
                dots = t["c"][kids] @ asks[who].T
                bound = dots + norm[who] * t["r"][kids, None]
                away = np.sqrt(np.maximum(0, qq[who] + t["cc"][kids, None] - 2 * dots))
                for j, i in enumerate(who.tolist()):
                    for kid, b, x, ok in zip(kids.tolist(), bound[:, j].tolist(), away[:, j].tolist(), (bound[:, j] >= low[j]).tolist(), strict=True):
                        if ok:
                            heapq.heappush(heaps[i], (-b, kid, x))
    return scores, ids, found_rows, computed


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    """The vectors as rows of d numbers, with zeros behind short ones, in the smallest integers that hold them."""
    out = np.zeros((len(column), d), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out.astype(np.int32) if out.size and int(out.min()) > -(2**31) and int(out.max()) < 2**31 else out


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", tree_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's best k. is_query: a condition on the columns of df."""
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & fine)
    rows = rows.select("id", "query", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "mtree-vectors")
    d, n, q = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.count_if("query")).first()
    most = max(64, min(tree_rows, TREE_BYTES // (8 * max(1, d))))
    trees, blocks = max(1, -(-n // most)), max(1, -(-q // max(64, min(query_rows, TREE_BYTES // (8 * max(1, d))))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["row"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), _matrix(pdf["v"], d))
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "data": [pickle.dumps(tree)]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "asks": [pickle.dumps((pdf["row"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), _matrix(pdf["v"], d)))]})

    dealt = lambda c, parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(c)
    grown = materialise(rows.select("*", dealt("tree", trees)).groupBy("tree").applyInPandas(grow, "tree int, data binary"), "mtree-trees")
    asked = materialise(rows.where("query").select("*", dealt("block", blocks)).groupBy("block").applyInPandas(gather, "block int, asks binary"), "mtree-queries")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []})
        tree, (own, ids, vectors) = pickle.loads(left["data"].iloc[0]), pickle.loads(right["asks"].iloc[0])
        scores, found, held, _ = search(tree, vectors, own, k)
        lens = [len(f) for f in found]
        return pd.DataFrame({"query_row": np.repeat(own, lens), "query_id": np.repeat(ids, lens), "row": np.concatenate(held), "vec_id": np.concatenate(found), "score": np.concatenate(scores).astype(np.int64)})

    # each block of queries meets each tree, one pair a group
    left = grown.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    found = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(run, "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
