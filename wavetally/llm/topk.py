"""Exact top-k inner-product search with cover trees over queries and data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

#: Rows of the bounded sample that pivots and first bounds are taken from, pivots, and rows of one tree.
SAMPLE, PIVOTS, BLOCK = 4096, 64, 4096
#: No score.
LEAST = np.iinfo(np.int64).min
#: Queries that one group of a cell's queries has at most: each block of data is sent once to every group that it may meet.
ASKED = 16384
#: Points of a tree's leaf: they are scored in one matrix product.
LEAF = 192


def farthest_first(x: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Centres picked farthest first until all points are ``within`` a centre, and each point's centre."""
    centres, near = [0], np.zeros(len(x), np.int64)
    dist = np.linalg.norm(x - x[0], axis=1)
    while len(centres) < most and dist.max() > within:
        c = int(dist.argmax())
        new = np.linalg.norm(x - x[c], axis=1)
        near[new < dist] = len(centres)
        dist = np.minimum(dist, new)
        centres.append(c)
    return np.array(centres), near


def cover_tree(x: np.ndarray, leaf: int = LEAF, fan: int = 8) -> tuple[np.ndarray, list[tuple]]:
    """A cover tree: an order of the points, and nodes ``(centre, radius, start, stop, children)``.

    The points of a node are a run of the order, all within its covering radius; its
    children's centres lie over half that radius apart, as far as ``fan`` allows, and cover them.
    """
    order, nodes = np.arange(len(x)), []

    def build(start: int, stop: int) -> int:
        own = x[order[start:stop]]
        centre = own.mean(axis=0)
        radius = float(np.linalg.norm(own - centre, axis=1).max()) * (1 + 1e-9) + 1e-9
        me = len(nodes)
        nodes.append([centre, radius, start, stop, ()])
        if stop - start > leaf and radius > 1e-6:
            _, near = farthest_first(own, fan, radius / 2)
            by = np.argsort(near, kind="stable")
            order[start:stop] = order[start:stop][by]
            cuts = np.flatnonzero(np.diff(near[by])) + 1
            bounds = [start, *(start + cuts).tolist(), stop]
            if len(bounds) > 2:
                nodes[me][4] = tuple(build(a, b) for a, b in zip(bounds, bounds[1:]))
        return me

    if len(x):
        build(0, len(x))
    return order, [tuple(n) for n in nodes]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else by integers; what a long cannot hold is its nearest bound."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` best of ``x`` by score and then id, itself left out: query places, ids and scores.

    Node pairs are visited best bound first; a pair is pruned if its bound, from
    the centres' product and the covering radii, is below the worst k-th score of the query
    node's queries. ``floor`` is a score that each query's k-th is known to reach.
    """
    q_order, q_nodes = cover_tree(q.astype(np.float64))
    x_order, x_nodes = cover_tree(x.astype(np.float64))
    n, worst = len(q), floor.astype(np.float64).copy()
    scores, ids = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)

    def bound(a: tuple, b: tuple) -> float:
        norm_a, norm_b = float(np.linalg.norm(a[0])) + a[1], float(np.linalg.norm(b[0])) + b[1]
        return float(a[0] @ b[0]) + (norm_a - a[1]) * b[1] + (norm_b - b[1]) * a[1] + a[1] * b[1] + 1e-6 + 1e-12 * norm_a * norm_b

    def visit(qa: int, xb: int) -> None:
        a, b = q_nodes[qa], x_nodes[xb]
        rows = q_order[a[2] : a[3]]
        if bound(a, b) < worst[rows].min():
            return
        if a[4] and (not b[4] or a[1] >= b[1]):
            for child in a[4]:
                visit(child, xb)
        elif b[4]:
            for _, child in sorted(((bound(a, x_nodes[c]), c) for c in b[4]), reverse=True):
                visit(qa, child)
        else:
            cols = x_order[b[2] : b[3]]
            s = _dot(q[rows], x[cols])
            i = np.broadcast_to(x_ids[cols], s.shape)
            same = i == q_ids[rows][:, None]
            both_s = np.concatenate([scores[rows], np.where(same, LEAST, s)], axis=1)
            both_i = np.concatenate([ids[rows], np.where(same, np.iinfo(np.int64).max, i)], axis=1)
            best = np.lexsort((both_i, ~both_s), axis=1)[:, :k]  # ~ turns the order round without overflow
            scores[rows] = np.take_along_axis(both_s, best, axis=1)
            ids[rows] = np.take_along_axis(both_i, best, axis=1)
            worst[rows] = np.maximum(worst[rows], scores[rows, k - 1])

    if n and len(x):
        visit(0, 0)
    at, j = np.nonzero(ids != np.iinfo(np.int64).max)
    return at, ids[at, j], scores[at, j]


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(id, v)`` with each component x as floor(64 * x); rows with a null or non-finite component, or none at all, are left out."""
    x = F.col("x")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    got = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x")).where(x.isNotNull() & F.col("id").isNotNull())
    return got.where(sound).select("id", F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), width)


def top_k(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, its ``k`` best among all others.

    Pivots from a bounded sample deal every vector to a cell; a cell is worked
    in blocks, so that a crowded one spreads over tasks. The sample also gives each query a
    score that its k-th best reaches at least; per group of queries the worst of them, with
    the blocks' covering radii, decides which blocks the group meets. There, a tree over the group's
    queries and one over the block are searched together.

    Of equal vectors only the ``k + 1`` smallest ids can be in a result, and only
    these are searched; all of them are queries. Null ids and unsound vectors take no part; only
    vectors of the query's length are its candidates; repeated rows of an id count as one; ties go to the smaller id. Products are
    exact; a score beyond a long's range is the nearest long. An empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = written(integer_vectors(rows, vec_id, embedding).dropDuplicates(["id", "v"]), "vectors")
    first = vectors.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    first = written(first, "first")
    queries = vectors.where(F.pmod("id", F.lit(every)) == 0)
    widths = sorted(r[0] for r in first.select(F.size("v")).distinct().collect())
    out = None
    for width in widths:
        part = _search(spark, first.where(F.size("v") == width), queries.where(F.size("v") == width), width, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(spark, data: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """Best rows by query and block, ``(query_id, vec_id, score)``, among vectors of one width."""
    sample = [(r["id"], r["v"]) for r in data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]  # a bounded sample: pivots and first bounds
    s_ids, s_vecs = np.array([i for i, _ in sample], np.int64), np.array([v for _, v in sample], np.int64).reshape(len(sample), width)
    picked, _ = farthest_first(s_vecs.astype(np.float64), PIVOTS)
    sent = spark.sparkContext.broadcast((s_ids, s_vecs, s_vecs[picked].astype(np.float64)))

    def cells(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sent.value[2]
        d = np.maximum((m.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * m.astype(np.float64) @ p.T + (p**2).sum(axis=1), 0)
        near = d.argmin(axis=1)
        return near, np.linalg.norm(m - p[near], axis=1)

    def place(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                near, dist = cells(_matrix(pdf["v"], width))
                yield pdf.assign(cell=near.astype(np.int32), dist=dist)

    def place_queries(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vecs, _ = sent.value
        for pdf in pdfs:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                m = _matrix(part["v"], width)
                s = np.where(part["id"].to_numpy()[:, None] == ids[None, :], LEAST, _dot(m, vecs))
                sure = np.sort(s, axis=1)[:, -k].astype(np.float64) if len(ids) > k else np.full(len(part), -np.inf)
                near, dist = cells(m)
                yield part.assign(cell=near.astype(np.int32), dist=dist, sure=sure)

    placed = written(data.mapInPandas(place, "id long, v array<long>, cell int, dist double"), "placed")
    asked = written(queries.mapInPandas(place_queries, "id long, v array<long>, cell int, dist double, sure double"), "asked")
    groups = asked.groupBy("cell").agg(F.max("dist").alias("radius"), F.min("sure").alias("worst"), F.count("*").alias("n")).collect()  # a row per pivot at most
    blocks = placed.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()  # a row per pivot at most
    pivots = s_vecs[picked].astype(np.float64)
    norms = np.linalg.norm(pivots, axis=1) if len(pivots) else np.zeros(0)
    meets: dict[int, list[int]] = {}
    for b in blocks:
        for g in groups:
            most = pivots[g["cell"]] @ pivots[b["cell"]] + norms[g["cell"]] * b["radius"] + norms[b["cell"]] * g["radius"] + g["radius"] * b["radius"] + 1e-6 + 1e-12 * (norms[g["cell"]] + g["radius"]) * (norms[b["cell"]] + b["radius"])
            if most >= g["worst"]:
                meets.setdefault(b["cell"], []).append(g["cell"])
    return _pairs(spark, placed, asked, groups, blocks, meets, width, k)


def _dealt(cells: list, size: int) -> dict[int, tuple[int, int]]:
    """For each cell, its group and the number of blocks: neighbouring small cells share a group of one, a crowded cell has its own of several."""
    group, filled, out = 0, 0, {}
    for r in sorted(cells, key=lambda r: r["cell"]):
        if filled and filled + r["n"] > size:
            group, filled = group + 1, 0
        out[r["cell"]] = (group, -(-r["n"] // size))
        filled += r["n"]
    return out


def _pairs(spark, placed: DataFrame, asked: DataFrame, groups, blocks, meets: dict[int, list[int]], width: int, k: int) -> DataFrame:
    """Deal queries and data to pairs of blocks that may meet, and search each pair.

    What the driver knows is about cells, at most PIVOTS squared pairs of them; the blocks of
    crowded cells are numbered where the rows are.
    """
    x_deal, q_deal = _dealt(blocks, BLOCK), _dealt(groups, ASKED)
    pairs = {(x_deal[c], q_deal[g]) for c, gs in meets.items() for g in gs}
    if not pairs:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")

    def against(deal: dict[int, tuple[int, int]], mine: int) -> DataFrame:
        rows = [(cell, *own, [p[1 - mine] for p in sorted(pairs) if p[mine] == own]) for cell, own in deal.items()]
        return F.broadcast(spark.createDataFrame(rows, "cell int, own int, n int, met array<struct<other:int,m:int>>"))  # a row per pivot

    def copies(rows: DataFrame, deal: dict[int, tuple[int, int]], mine: int, names: list[str]) -> DataFrame:
        rows = rows.join(against(deal, mine), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("met", F.explode("met"))
        rows = rows.withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("met")["m"] - 1)))
        return rows.select(*(F.col(c).alias(n) for c, n in zip(("own", "block", "met.other", "block2"), names)), "id", "v", "sure")

    x = copies(placed.withColumn("sure", F.lit(None).cast("double")), x_deal, 0, ["xg", "xb", "qg", "qb"])
    q = copies(asked, q_deal, 1, ["qg", "qb", "xg", "xb"])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        q_ids = left["id"].to_numpy(np.int64)
        at, ids, scores = dual_search(_matrix(left["v"], width), q_ids, _matrix(right["v"], width), right["id"].to_numpy(np.int64), k, left["sure"].fillna(-np.inf).to_numpy())
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": scores})

    on = ["qg", "qb", "xg", "xb"]
    return q.groupBy(*on).cogroup(x.groupBy(*on)).applyInPandas(search, "query_id long, vec_id long, score long")
