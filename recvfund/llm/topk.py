"""Exact top-k search by inner product with a KD-tree per shard.

Vectors become integers (a fixed scale, rounded down). They are dealt to shards by a hash of their id; each shard's tree
splits the widest dimension at its median down to small leaves, and every node has a tight bounding box. For a query, a
box's bound is the largest inner product any point in the box could have. The traversal is best-first: the node with the
highest bound is opened next, and it ends when no bound reaches the kth score found so far. A query first searches the
shard that it is dealt to; its kth score from there is carried to all other shards as the starting limit. Queries travel
in blocks, one block and one shard's tree at a time in memory; no query meets a vector outside a tree. Blocks and trees meet
by a shuffle, whatever Spark takes their size for: it would broadcast the blocks by what they hold before each is repeated for
every shard, through the driver.

Edge cases: a vector that is null, empty or holds a null or non-finite component takes no part, as query or as
candidate; so does a null id. Only vectors of one length are compared. Of several rows with one id, the one with the
least vector (first component first) is the query, for each length; only that row is no candidate for it, all other
rows, repeats of it included, are candidates each. If an id has vectors of several lengths, their candidates share one
ranking. Ties go to the smaller id. Fewer candidates than k give all of
them; a score beyond a long's range is given as the nearest long; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, n_shards

SCALE = 256
K = 5
QUERY_EVERY = 50
SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF_ROWS = 256
LONG = (1 << 63) - 1
MOST = float(1 << 54)  # a larger component has no long after scaling; its vector takes no part
EXACT = float(1 << 52)  # float64 adds and multiplies integers exactly below


def scaled(vector: Column) -> Column:
    """Integer components, null if the vector takes no part."""
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Rows in leaf order; per node its box, its rows from ``start`` to ``end``, and its first child (0: a leaf)."""
    order = np.arange(len(x))
    start, end, kids, low, high = [0], [len(x)], [0], [x.min(0)], [x.max(0)]
    i = 0
    while i < len(start):
        a, b = start[i], end[i]
        spread = high[i] - low[i]
        if b - a > leaf_rows and spread.any():
            part, d, mid = order[a:b], int(spread.argmax()), (b - a) // 2
            order[a:b] = part[np.argpartition(x[part, d], mid)]
            kids[i] = len(start)
            for c, e in ((a, a + mid), (a + mid, b)):
                rows = x[order[c:e]]
                start.append(c), end.append(e), kids.append(0), low.append(rows.min(0)), high.append(rows.max(0))
        i += 1
    return {"ids": ids[order], "x": x[order], "start": np.array(start), "end": np.array(end), "kids": np.array(kids), "low": np.array(low), "high": np.array(high)}


def search(tree: dict[str, np.ndarray], own: int, q: np.ndarray, k: int, limit: int | None) -> list[tuple[int, int]]:
    """Up to k (score, -id) of the rows that score ``limit`` or more, best first.

    One row with the query's id and vector is left out: itself. Its equals are all in its home shard, so in any other tree there is none.
    """
    same = np.flatnonzero(tree["ids"] == own)
    itself = next((int(j) for j in same if (tree["x"][j] == q).all()), -1)
    number = float if float(np.abs(q, dtype=float) @ np.maximum(np.abs(tree["low"][0], dtype=float), np.abs(tree["high"][0], dtype=float))) < EXACT else object
    q = q.astype(number)
    bounds = np.maximum(q * tree["low"].astype(number), q * tree["high"].astype(number)).sum(1) if number is object else np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T
    best: list[tuple[int, int]] = []  # a heap, the worst first
    todo = [(-bounds[0], 0)]
    while todo:
        bound, i = heapq.heappop(todo)
        if limit is not None and -bound < limit:
            break
        if kid := int(tree["kids"][i]):
            heapq.heappush(todo, (-bounds[kid], kid))
            heapq.heappush(todo, (-bounds[kid + 1], kid + 1))
            continue
        rows = slice(int(tree["start"][i]), int(tree["end"][i]))
        scores, ids = tree["x"][rows].astype(number, copy=False) @ q, tree["ids"][rows]
        other = np.arange(rows.start, rows.stop) != itself
        take = np.flatnonzero(other & (scores >= limit)) if limit is not None else np.flatnonzero(other)
        if len(take) > 4 * k:  # the kth highest among them is a limit too
            take = take[scores[take] >= np.partition(scores[take], len(take) - k)[len(take) - k]]
        for j in take:
            item = (int(scores[j]), -int(ids[j]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            limit = best[0][0] if limit is None else max(limit, best[0][0])
    return sorted(best, reverse=True)


def _trees(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x = np.array(rows["v"].tolist(), np.int64)
    tree = build_tree(rows["vec_id"].to_numpy(np.int64), x)
    if np.abs(x, dtype=float).max() < EXACT:
        tree |= {n: tree[n].astype(float) for n in ("x", "low", "high")}
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [_pack(**tree)]})


def _blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    limit = rows["kth"].to_numpy(float) if "kth" in rows else np.full(len(rows), np.nan)
    known = ~np.isnan(limit)
    exact = np.array([int(v) if ok else 0 for v, ok in zip(rows.get("kth", limit), known, strict=True)], np.int64)
    blob = _pack(ids=rows["vec_id"].to_numpy(np.int64), x=np.array(rows["v"].tolist(), np.int64), known=known, limit=exact)
    return pd.DataFrame({"dim": [key[0]], "home": [key[1]], "queries": [blob]})


def _searched(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, queries in zip(pdf["tree"], pdf["queries"], strict=True):
                t, q = _unpack(tree), _unpack(queries)
                out = [
                    (int(i), -minus, max(-LONG, min(LONG, score)))
                    for i, v, known, limit in zip(q["ids"], q["x"], q["known"], q["limit"], strict=True)
                    for score, minus in search(t, int(i), v, k, int(limit) if known else None)
                ]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, embedding``) whose id is divisible by ``query_every``."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    shards = n_shards(x, shard_rows)
    x = x.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    trees = kept(x.groupBy("dim", "shard").applyInPandas(_trees, "dim int, shard int, tree binary"))
    # the least vector of an id and length; equal vectors of one id are dealt to one shard
    asked = x.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "shard")).alias("q")).select("vec_id", "q.v", "dim", "q.shard")
    parts = max(1, n_shards(asked, block_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, parts // shards))).cast("int").alias("block")
    asked = kept(asked.select("*", block))
    found = "query_id long, vec_id long, score long"
    blocks = asked.groupBy("dim", "shard", "block").applyInPandas(_blocks, "dim int, home int, queries binary")
    trees = trees.hint("merge")
    at_home = blocks.join(trees, (blocks["dim"] == trees["dim"]) & (blocks["home"] == trees["shard"])).select("tree", "queries").mapInPandas(_searched(k), found)
    at_home = kept(at_home)
    limits = at_home.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))
    # a query's block goes to every shard but its own
    carried = asked.join(limits, F.col("vec_id") == F.col("of"), "left").drop("of")
    blocks = carried.groupBy("dim", "shard", "block").applyInPandas(_blocks, "dim int, home int, queries binary")
    away = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("to != home")
    away = away.repartition(2 * shards, "dim", "to")  # else Spark puts trees together by the bytes that meet them, not by the work
    away = away.join(trees, (away["dim"] == trees["dim"]) & (away["to"] == trees["shard"])).select("tree", "queries").mapInPandas(_searched(k), found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return at_home.unionByName(away).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
