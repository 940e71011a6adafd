"""Exact top-k inner product search: a ball tree for each shard, branch and bound with the current kth score."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, stored

#: Rows of a shard and queries of a block on average. One task holds one tree and one block.
SHARD_ROWS, QUERY_BLOCK = 32_768, 32_768
#: Pivots at most: what the driver and each task hold of them does not grow with the table.
MAX_PIVOTS = 1024
#: Shares of the pivots that a query has met after each wave but the first, which is its own shard.
WAVES = (0.15, 1.0)
LEAF_ROWS = 64
#: Integer products are exact in doubles below this.
EXACT = float(2**52)
#: Components beyond it count as it: floor() gives a long.
LONGEST = 9.2e18


class BallTree:
    """Balls around halves of the points, down to leaves. Points are rows of doubles that hold integers."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.center, self.radius, self.span, self.child = [], [], [], []
        self._build(0, len(points), leaf_rows)
        self.center, self.radius = np.array(self.center), np.array(self.radius)

    def _build(self, low: int, high: int, leaf_rows: int) -> int:
        node, own = len(self.radius), self.points[self.order[low:high]]
        center = own.mean(axis=0)
        apart = np.sqrt(((own - center) ** 2).sum(axis=1))
        self.center.append(center)
        self.radius.append(float(apart.max()))
        self.span.append((low, high))
        self.child.append(None)
        if high - low > leaf_rows:
            a = own[apart.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(own @ (b - a), middle)]
            self.child[node] = (self._build(low, low + middle, leaf_rows), self._build(low + middle, high, leaf_rows))
        return node

    def search(self, queries: np.ndarray, own_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best points of each query, other than the point with the query's own id.

        floor: a score that the kth best of all shards has at least. A node is left out for a query if its upper bound, center
        times query plus radius times the query's length, is below the floor or the kth score so far; ties are visited, as the
        smaller id wins. Missing ones have the score -inf.
        """
        n = len(queries)
        scores, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        length = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-9 * (1 + length * (np.sqrt((self.center**2).sum(axis=1)).max() + self.radius.max()))

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            return queries[who] @ self.center[node] + self.radius[node] * length[who] + slack[who]

        stack = [(0, np.arange(n))]
        while stack:
            node, who = stack.pop()
            who = who[bound(node, who) >= np.maximum(scores[who, -1], floor[who])]
            if not len(who):
                continue
            if self.child[node] is not None:
                # The likelier child is searched first, so that the kth scores rise early.
                stack += [(c, who) for c in sorted(self.child[node], key=lambda c: bound(c, who).mean())]
                continue
            rows = self.order[slice(*self.span[node])]
            new = queries[who] @ self.points[rows].T
            new[own_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            both = np.concatenate([scores[who], new], axis=1)
            names = np.concatenate([found[who], np.broadcast_to(ids[rows], new.shape)], axis=1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[who], found[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        return scores, found


class Pivots:
    """Some of the vectors, by length: each vector belongs to the nearest one of its length. Vectors of a length that none has belong
    to the group behind the last. Once the groups' radii are known they bound the scores of a query in each group."""

    def __init__(self, vectors: list[list[float]]) -> None:
        self.n, self.radius = len(vectors), np.full(len(vectors) + 1, np.inf)
        lengths = np.array([len(v) for v in vectors], int)
        self.of = {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}
        self.center = {d: np.array([vectors[i] for i in own], float).reshape(len(own), d) for d, own in self.of.items()}

    def nearest(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows with their group and how far apart from its pivot they lie."""
        for frame in frames:
            group, apart = np.full(len(frame), self.n), np.zeros(len(frame))
            for dim, own in frame.groupby("dim").indices.items():
                if dim not in self.center:
                    continue
                center, points = self.center[dim], np.array(frame["vec"].iloc[own].tolist(), float).reshape(len(own), dim)
                best = ((center**2).sum(axis=1) - 2 * points @ center.T).argmin(axis=1)
                group[own], apart[own] = self.of[dim][best], np.sqrt(((points - center[best]) ** 2).sum(axis=1))
            yield frame.assign(near=group.astype(np.int32), apart=apart)

    def worth(self, low: float, high: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """For each query those of its groups, from a share low to a share high of them by their bounds, in which its floor can be met.

        A group has one place in a query's order in all waves: pivots are whole numbers, so that products are exact below EXACT.
        Beyond it the groups' numbers are their order.
        """

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                near: list[np.ndarray] = [np.array([self.n] if high == 1.0 else [], np.int32)] * len(frame)
                for dim, own in frame.groupby("dim").indices.items():
                    if dim not in self.center:
                        continue
                    groups, center = self.of[dim], self.center[dim]
                    q, floor = np.array(frame["vec"].iloc[own].tolist(), float).reshape(len(own), dim), frame["floor"].to_numpy(float)[own]
                    length, reach = np.sqrt((q**2).sum(axis=1))[:, None], self.radius[groups]
                    bound = q @ center.T + length * reach
                    slack = 1e-9 * (1 + length * (np.sqrt((center**2).sum(axis=1)) + reach))
                    # A score that no long can say counts as the smallest one.
                    open_ = (np.maximum(bound + slack, -(2.0**63)) >= floor[:, None]) & (reach >= 0)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    large = dim * np.maximum(np.abs(q).max(axis=1, initial=0), np.abs(center).max(initial=0)) ** 2 >= EXACT
                    order[large] = np.arange(len(groups))
                    a, b = (round(x * len(groups)) for x in (low, high))
                    for i, at in enumerate(own):
                        mine = order[i, a:b]
                        near[at] = groups[mine[open_[i, mine]]].astype(np.int32)
                yield frame.assign(near=near)

        return run


def _plant(points: pd.DataFrame) -> pd.DataFrame:
    """shard, dim and the tree of each dimension's points of a shard, with their ids."""
    out = []
    for (shard, dim), own in points.groupby(["shard", "dim"]):
        tree = BallTree(np.array(own["vec"].tolist(), float).reshape(len(own), dim))
        out.append((shard, dim, pickle.dumps((tree, own["vec_id"].to_numpy(np.int64)), 5)))
    return pd.DataFrame(out, columns=["t_shard", "t_dim", "tree"])


def _exact(q: np.ndarray, p: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> list[pd.DataFrame]:
    """Beyond what doubles hold exactly: whole numbers of any size, held to what a long can say."""
    scores = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1) for y in p] for x in q]
    best = [sorted((-s, int(i)) for s, i in zip(row, ids, strict=True) if i != me)[:k] for row, me in zip(scores, q_ids, strict=True)]
    return [pd.DataFrame({"query_id": me, "vec_id": [i for _, i in row], "score": [-s for s, _ in row]}) for me, row in zip(q_ids, best, strict=True) if row]


def _top(queries: pd.DataFrame, trees: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of the shard for each query that can still be among the best of all."""
    out = []
    planted = dict(zip(trees["t_dim"], trees["tree"], strict=True))
    for dim, group in queries.groupby("dim"):
        if dim not in planted:
            continue
        tree, ids = pickle.loads(planted[dim])
        q, q_ids = np.array(group["vec"].tolist(), float).reshape(len(group), dim), group["vec_id"].to_numpy(np.int64)
        if dim * max(np.abs(q).max(initial=0), np.abs(tree.points).max(initial=0)) ** 2 >= EXACT:
            out += _exact(q, tree.points, q_ids, ids, k)
            continue
        floor = group["floor"].to_numpy(float)
        scores, found = tree.search(q, q_ids, ids, k, floor)
        who, at = np.nonzero((scores > -np.inf) & (scores >= floor[:, None]))
        out.append(pd.DataFrame({"query_id": q_ids[who], "vec_id": found[who, at], "score": scores[who, at].astype(np.int64)}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank from 1, vec_id and score: the k vectors with the highest inner product for each query, ties to smaller ids.

    Components are floor(1024 * x); scores beyond the range of a long are held to it. Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors
    of other lengths than the query's are no candidates. Of rows with one id and one vector the first counts once. Fewer than k
    candidates are all returned; an empty table gives no rows. Other columns are not read.

    Each vector belongs to the nearest of some pivots, drawn by a hash of their ids; which ones they are changes no result. Groups
    of more than shard_rows, so also those of many copies, are dealt to several shards by their ids. Each shard's ball tree is built
    once and stored. Queries meet the shards in waves: first the one that they lie in, then those of the groups with the highest
    bounds, then the rest. The kth score so far of all shards is the floor that the next wave's searches start from, and a query goes
    only to groups whose bound, from pivot and radius, reaches it. The queries that a shard gets in a wave are dealt to blocks of some
    query_block; its tree is sent once to each block, and nowhere without queries.
    """
    kept = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("raw"), is_query.alias("asks"))
        .where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull())
        .where(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
        .select("vec_id", "asks", F.transform("raw", lambda x: F.floor(F.least(F.greatest(x * 1024, F.lit(-LONGEST)), F.lit(LONGEST))).cast("double")).alias("vec"))
        .withColumn("dim", F.size("vec"))
        .dropDuplicates(["vec_id", "vec"])
    )
    spark, plain = kept.sparkSession, stored(kept)
    n_pivots = min(MAX_PIVOTS, max(1, -(-plain.count() // shard_rows)))
    pivots = Pivots([r["vec"] for r in plain.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "vec").limit(n_pivots).select("vec").collect()])
    near = stored(plain.mapInPandas(pivots.nearest, "vec_id long, asks boolean, vec array<double>, dim int, near int, apart double"))
    discard(plain)
    # One row for each pivot: its shards, and how far its vectors reach. A pivot without vectors reaches nothing.
    rows, first = [], 0
    pivots.radius[: pivots.n] = -1.0
    for r in near.groupBy("near").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).orderBy("near").collect():
        parts = -(-r["n"] // shard_rows)
        rows.append((r["near"], first, parts))
        pivots.radius[r["near"]] = r["apart"] if r["near"] < pivots.n else np.inf
        first += parts
    places = F.broadcast(spark.createDataFrame(rows, "near int, first long, parts long"))
    kept = near.join(places, "near").withColumn("home", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    trees = stored(kept.select("vec_id", "vec", "dim", F.col("home").alias("shard")).groupBy("shard").applyInPandas(_plant, "t_shard long, t_dim int, tree binary"))
    queries = stored(kept.where("asks").select("vec_id", "vec", "dim", "home"))

    def search(asking: DataFrame) -> DataFrame:
        """Each shard's tree goes to as many tasks as its own queries fill blocks, and to none without queries."""
        blocks = stored(asking.groupBy("shard").count().select("shard", F.ceil(F.col("count") / query_block).alias("blocks")))
        sent = asking.join(blocks, "shard").select("vec_id", "vec", "dim", "floor", "shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").alias("block"))
        met = trees.join(blocks, F.col("t_shard") == F.col("shard")).select("t_shard", "t_dim", "tree", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("t_block"))
        return sent.groupBy("shard", "block").cogroup(met.groupBy("t_shard", "t_block")).applyInPandas(lambda q, t: _top(q, t, k), "query_id long, vec_id long, score long")

    low, met = F.lit(float("-inf")), 0.0
    found = search(queries.withColumns({"floor": low, "shard": F.col("home")}))
    if first <= 1:
        return _best(found, k)  # one shard: no query has another to meet
    found = stored(found)
    for share in WAVES:
        if share < 1.0 and all(round(met * len(g)) == round(share * len(g)) for g in pivots.of.values()):
            continue  # so few groups that none is in this wave
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", F.col("kth").cast("double").alias("floor"))
        known = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").withColumn("floor", F.coalesce("floor", low)).drop("query_id")
        reached = stored(known.mapInPandas(pivots.worth(met, share), "vec_id long, vec array<double>, dim int, home long, floor double, near array<int>"))
        sent = reached.withColumn("near", F.explode("near")).join(places, "near").withColumn("shard", F.explode(F.expr("sequence(first, first + parts - 1)"))).where("shard <> home")
        best = _best(found.unionByName(search(sent)).dropDuplicates(), k)
        if share == 1.0:
            break
        found, met = stored(best.drop("rank")), share
    return best
