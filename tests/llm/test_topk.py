import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm import topk
from corpusmill.llm.queries import op3_topk
from corpusmill.llm.sql import ORACLE_SQL
from corpusmill.llm.topk import BallTree, Pivots, top_k
from tests.helpers import spark_rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute_force(rows, k):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ints if i % 100 == 0):
        held = lambda x: min(max(x, -(2**63)), 2**63 - 1)  # noqa: E731  what a long can say
        best = sorted((-held(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(op3_topk(spark, sf_dir)) == sql_rows(ORACLE_SQL["op3_topk"], sf_dir)


def test_ties_nulls_and_other_lengths(spark):
    same = [(i, [1.0, -0.5]) for i in range(0, 300)]
    odd = [(400, None), (401, [None, 1.0]), (402, [float("nan"), 1.0]), (403, [float("inf"), 1.0]), (500, [1.0, 2.0, 3.0]), (600, []), (601, [])]
    assert run(spark, same + odd, k=10) == brute_force(same + odd, 10)


def test_shards_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(0, 900, 3)]
    want = brute_force(rows, 10)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=10, query_block=1) == want
    assert run(spark, rows[:4], k=10) == brute_force(rows[:4], 10)


def test_large_components(spark):
    rows = [(0, [1e8, 2.0]), (1, [3e8, -1.0]), (2, [-1e8, 5.0]), (100, [2e8, 1.0])]
    assert run(spark, rows) == brute_force(rows, 10)


def test_tree_leaves_nodes_out():
    rng = np.random.default_rng(2)
    points = np.floor(np.concatenate([rng.normal(c, 3, (400, 8)) for c in rng.normal(0, 300, (12, 8))]))
    queries, ids = points[::97].copy(), np.arange(len(points))
    scores, found = BallTree(points).search(queries, ids[::97], ids, 5, np.full(len(queries), -np.inf))
    full = queries @ points.T
    full[np.arange(len(queries)), ids[::97]] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :5]
    assert (found == best).all()
    assert (scores == np.take_along_axis(full, best, 1)).all()


def test_empty(spark):
    assert run(spark, [(1, [1.0])]) == []
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df, F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(0, 450, 3)]
    assert run(spark, rows + rows[::2] + rows[:5] + [(None, rows[0][1])] * 3) == brute_force(rows, 10)


def test_waves_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(0, 600, 4)]
    want = brute_force(rows, 10)
    for waves in ((1.0,), (0.5, 1.0), (0.1, 0.4, 1.0)):
        monkeypatch.setattr(topk, "WAVES", waves)
        assert run(spark, rows, shard_rows=8) == want


def test_queries_go_only_where_their_floor_can_be_met():
    rng = np.random.default_rng(7)
    centers = np.floor(rng.normal(0, 300, (8, 6)))
    points = pd.DataFrame({"vec": [list(np.floor(c + x)) for c in centers for x in rng.normal(0, 2, (50, 6))], "dim": 6})
    pivots = Pivots([list(c) for c in centers] + [[1.0, 2.0]])
    placed = next(pivots.nearest(iter([points])))
    pivots.radius[:] = -1.0
    for near, own in placed.groupby("near"):
        pivots.radius[near] = own["apart"].max()
    flat = np.array(points["vec"].tolist())
    kth = np.sort(flat @ flat.T, axis=1)[:, -10]
    asked = points.assign(floor=kth.astype(float))
    met = [a + b for a, b in zip(*(list(map(list, next(pivots.worth(low, high)(iter([asked])))["near"])) for low, high in ((0.0, 0.15), (0.15, 1.0))), strict=True)]
    for i, groups in enumerate(met):
        assert set(placed["near"][flat @ flat[i] >= kth[i]]) <= set(groups)
    assert np.mean([len(g) for g in met]) < 2
    everywhere = asked.assign(floor=-np.inf)
    both = [a + b for a, b in zip(*(list(map(list, next(pivots.worth(low, high)(iter([everywhere])))["near"])) for low, high in ((0.0, 0.15), (0.15, 1.0))), strict=True)]
    assert all(sorted(g) == sorted(set(placed["near"])) for g in both)


def test_copies_are_dealt_to_several_shards(spark):
    rows = [(i, [2.0, -1.0]) for i in range(0, 300)] + [(i, [float(i), 1.0, 0.0]) for i in range(300, 330)] + [(i, [1.0, float(i % 7)]) for i in range(400, 560)]
    assert run(spark, rows, shard_rows=20, query_block=2) == brute_force(rows, 10)


def test_queries_of_one_shard_fill_several_blocks(spark):
    """A third of all rows ask, and all that ask lie together."""
    rng = np.random.default_rng(8)
    near = [(100 * i, [float(np.float32(x)) for x in rng.normal(40, 0.1, 4)]) for i in range(60)]
    far = [(100 * i + 1, [float(np.float32(x)) for x in rng.normal(-40 * (i % 5), 5, 4)]) for i in range(120)]
    assert run(spark, near + far, shard_rows=25, query_block=7) == brute_force(near + far, 10)


def test_one_shard_needs_no_waves(spark, monkeypatch):
    rows = [(i, [float(i % 13), 1.0]) for i in range(300)]
    monkeypatch.setattr(topk, "WAVES", None)
    assert run(spark, rows) == brute_force(rows, 10)
