"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances by one added component: with a = sqrt(M^2 - |v|^2), where M is the greatest norm, the
distance of (q, 0) and (v, a) is sqrt(|q|^2 + M^2 - 2 <q, v>). Vectors are dealt to the nearest of a bounded number of
pivots (the root page), and each pivot's vectors to subtrees of about SUBTREE vectors, by a hash, so that a pivot with
many vectors is shared by many tasks. A subtree is built in its task from paged nodes: routing vectors with covering
radii, and in every entry the stored distance to the parent's routing vector, which rules out entries by the triangle
inequality before their distance is computed. Nodes also hold their smallest id, so that pages which could only tie
are opened only if a tie would be won.

Queries first search one subtree of their nearest pivot. The score found there bounds the second round, in which they
visit the remaining subtrees whose covering balls can hold a better vector, in blocks of queries. Scores are exact
integers; distances only order and exclude, with a margin for rounding.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled with 0.
Ties go to the smaller id. Rows with a null id take no part. Rows of one id are no candidates of each other; as candidates
of other queries each is a row of its own, and each of their distinct vectors is a query of its own. An empty table
gives an empty result; other columns are not read. Inner products of 2^53 and more are not exact in floating point, so
vectors that long raise an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.llm._staging import Staging

#: Most pivots of the root page, which is broadcast; vectors of a subtree, entries of a page, queries in a block, about.
PIVOTS, SUBTREE, PAGE, FANOUT, BLOCK = 1024, 8000, 768, 12, 256
_MARGIN = 1e-6


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    whole = vector.cast("array<double>")
    sound = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & sound & (F.size(vector) > 0), F.transform(whole, lambda x: F.floor(x * scale)))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Tree:
    """One subtree: pages of a bulk-loaded M-tree over integer vectors (held as exact floats)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        self.ids, self.v = ids, vectors
        self.extra = np.sqrt(np.maximum(0.0, most * most - (vectors * vectors).sum(1)))
        self.pages: list[tuple] = []
        order = np.argsort(ids, kind="stable")
        self.root, self.top = self._build(order, int(order[0])), vectors[order[:1]]
        self.ids = self.v = self.extra = None  # the pages hold what a search reads

    def distance(self, one: int, many: np.ndarray) -> np.ndarray:
        d = self.v[many] - self.v[one]
        return np.sqrt((d * d).sum(1) + (self.extra[many] - self.extra[one]) ** 2)

    def _build(self, rows: np.ndarray, centre: int) -> int:
        """The page of these rows under the routing vector `centre`: (leaf, children, distances to it, radii, vectors of
        the entries, their ids or the least ids below them)."""
        if len(rows) <= PAGE:
            self.pages.append((True, None, self.distance(centre, rows), 0.0, self.v[rows], self.ids[rows]))
            return len(self.pages) - 1
        heads = rows[:: max(1, len(rows) // FANOUT)][:FANOUT]
        near = np.argmin(np.stack([self.distance(h, rows) for h in heads]), axis=0)
        parts = [rows[near == i] for i in range(len(heads))]
        if max(map(len, parts)) == len(rows):  # copies: cut by id
            parts = [rows[i : i + max(PAGE, len(rows) // FANOUT + 1)] for i in range(0, len(rows), max(PAGE, len(rows) // FANOUT + 1))]
            heads = [p[0] for p in parts]
        kept = [(int(h), p) for h, p in zip(heads, parts, strict=True) if len(p)]
        children = np.array([self._build(p, h) for h, p in kept])
        centres = np.array([h for h, _ in kept])
        radii = np.array([self.distance(h, p).max() for h, p in kept])
        self.pages.append((False, children, self.distance(centre, centres), radii, self.v[centres], np.array([self.ids[p].min() for _, p in kept])))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, skip: int, floor: tuple[float, int] | None, most: float) -> list[tuple[int, int]]:
        """The k best (score, id) but for the id `skip`, among those that beat the floor (score, id of the k-th so far)."""
        norm = float(query @ query) + most * most
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
        worst = (floor[0], -floor[1]) if floor else (-np.inf, 0)

        def to(vectors: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, norm - 2 * (vectors @ query)))

        def bound(near: np.ndarray) -> np.ndarray:
            """The greatest score at a distance of `near` or more."""
            return (norm - np.maximum(0.0, near - _MARGIN) ** 2) / 2 + _MARGIN * (1 + most)

        queue = [(-np.inf, self.root, float(to(self.top)[0]))]
        while queue:
            value, page, above = heapq.heappop(queue)
            if -value < worst[0]:
                break
            leaf, children, parent, radii, vectors, ids = self.pages[page]
            hope = bound(np.abs(above - parent) - radii)  # without computing a distance
            at = np.flatnonzero((hope > worst[0]) | (hope >= worst[0]) & (-ids > worst[1]))
            if not len(at):
                continue
            if len(at) < len(ids):
                vectors, ids = vectors[at], ids[at]
            if leaf:
                score = vectors @ query
                good = np.flatnonzero((score >= worst[0]) & (ids != skip))
                if len(good) > 4 * k:  # only the best of the page can matter
                    good = good[np.lexsort((ids[good], -score[good]))[:k]]
                for s, i in zip(score[good].tolist(), ids[good].tolist(), strict=True):
                    if (s, -i) >= worst:
                        heapq.heappush(best, (s, -i))
                        if len(best) > k:
                            heapq.heappop(best)
                        if len(best) == k:
                            worst = max(worst, best[0])
            else:
                d = to(vectors)
                for j, x, y in zip(at.tolist(), d.tolist(), bound(d - radii[at]).tolist(), strict=True):
                    if y >= worst[0]:
                        heapq.heappush(queue, (-y, int(children[j]), x))
        return [(int(s), -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` selects, the k greatest inner products with other rows."""
    spark = vectors.sparkSession
    stage = Staging(spark, "mtree")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantise(F.col(vector), scale).alias("v"), queries.alias("ask"))
    rows = stage.put(rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()), "rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, most, width = rows.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most * most >= 1 << 53:
        raise ValueError("inner products of these vectors pass 2^53: take a smaller scale")
    sc, most = spark.sparkContext, float(most) * (1 + 1e-12)
    wanted = max(1, min(PIVOTS, n // (SUBTREE // 2)))
    pivots = _matrix([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()], width)
    root = sc.broadcast(pivots)
    lift = lambda m: np.sqrt(np.maximum(0.0, most * most - (m * m).sum(1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = root.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1).to_pylist(), width)
                a = lift(m)[:, None] - lift(p)
                d = np.sqrt(np.maximum(0.0, (m * m).sum(1)[:, None] + (p * p).sum(1) - 2 * (m @ p.T)) + a * a)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m.astype("<i8")]), pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at]), batch.column(2)], names=["vec_id", "v", "pivot", "d", "ask"])

    dealt = stage.put(rows.mapInArrow(assign, "vec_id long, v binary, pivot int, d double, ask boolean"), "dealt")
    sizes = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.min("vec_id").alias("least")).withColumn("salts", F.ceil(F.col("n") / SUBTREE).cast("int"))
    page = {r["pivot"]: (r["salts"], r["radius"], r["least"]) for r in sizes.collect()}  # the root page, PIVOTS entries at most
    salts = np.array([page.get(i, (0, 0.0, 0))[0] for i in range(wanted)])
    radii = np.array([page.get(i, (0, 0.0, 0))[1] for i in range(wanted)])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.frombuffer(x, "<i8") for x in frame["v"]]).astype(float)
        tree = Tree(frame["vec_id"].to_numpy(), m, most)
        return pd.DataFrame({"pivot": [int(frame["pivot"].iloc[0])], "salt": [int(frame["salt"].iloc[0])], "tree": [pickle.dumps(tree)]})

    shares = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in salts]), F.col("pivot") + 1)
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), shares).cast("int"))
    trees = stage.put(salted.select("vec_id", "v", "pivot", "salt").groupBy("pivot", "salt").applyInPandas(build, "pivot int, salt int, tree binary"), "trees")

    asked = dealt.filter("ask").select(F.struct(F.col("vec_id").alias("id"), F.sha2("v", 256).alias("v")).alias("query_id"), F.col("v").alias("q"), "pivot").dropDuplicates(["query_id"])
    key_type = pa.struct([pa.field("id", pa.int64()), pa.field("v", pa.string())])
    blocks = max(1, -(-asked.count() // BLOCK))
    asked_as = "query_id struct<id: long, v: string>"
    found = f"{asked_as}, vec_id long, score long"

    def search(pairs: DataFrame) -> DataFrame:
        """pairs: pivot, salt, query_id, q, and the floor (score, id), null without one."""
        held = pairs.groupBy("pivot", "salt", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        held = held.agg(F.collect_list("query_id").alias("ids"), F.collect_list("q").alias("qs"), F.collect_list(F.coalesce("floor", F.lit(-(1 << 62)))).alias("floors"), F.collect_list(F.coalesce("floor_id", F.lit(-1))).alias("floor_ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    tree = pickle.loads(batch.column(4)[i].as_py())
                    out = []
                    for key, q, floor, at in zip(*(batch.column(c)[i].as_py() for c in range(4)), strict=True):
                        got = tree.search(np.frombuffer(q, "<i8").astype(float), k, key["id"], (floor, at) if floor > -(1 << 62) else None, most)
                        out += [(key, v, s) for s, v in got]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((key_type, pa.int64(), pa.int64()))], names=["query_id", "vec_id", "score"])

        return held.join(trees, ["pivot", "salt"]).select("ids", "qs", "floors", "floor_ids", "tree").mapInArrow(run, found)

    nothing = F.lit(None).cast("long")
    first = stage.put(search(asked.select("pivot", F.lit(0).alias("salt"), "query_id", "q", nothing.alias("floor"), nothing.alias("floor_id"))), "first")
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by(F.struct("score", "vec_id"), F.struct(-F.col("score"), "vec_id")).alias("w"))
    floors = worst.filter(F.col("n") >= k).select("query_id", F.col("w.score").alias("floor"), F.col("w.vec_id").alias("floor_id"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = root.value
        for batch in batches:
            for key, q, home, floor, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(q, "<i8").astype(float)
                norm = float(v @ v) + most * most
                near = np.maximum(0.0, np.sqrt(np.maximum(0.0, norm - 2 * (p @ v))) - radii - _MARGIN)
                hope = (norm - near * near) / 2 + _MARGIN * (1 + most)
                goes = [(i, s) for i in np.flatnonzero((hope >= (-np.inf if floor is None else floor)) & (salts > 0)).tolist() for s in range(salts[i]) if (i, s) != (home, 0)]
                m = len(goes)
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in goes], pa.int32()), pa.array([g[1] for g in goes], pa.int32()), pa.array([key] * m, key_type), pa.array([q] * m, pa.binary()), pa.array([floor] * m, pa.int64()), pa.array([at] * m, pa.int64())], names=["pivot", "salt", "query_id", "q", "floor", "floor_id"])

    bounded = asked.join(floors, "query_id", "left").select("query_id", "q", "pivot", "floor", "floor_id")
    second = search(bounded.mapInArrow(route, f"pivot int, salt int, {asked_as}, q binary, floor long, floor_id long"))
    # each search gives at most k rows, so a query's rows are few
    ranked = first.unionByName(second).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("rank", "b")).select(F.col("query_id.id").alias("query_id"), (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
