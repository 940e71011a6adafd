"""Connected components of a graph of ids: union-find in each partition, then stars contracted over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import batch_column, discard, stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as edges from each vertex to the smallest of its component there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch_column(batch, "src").to_pylist(), batch_column(batch, "dst").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(v, find(v)) for v in list(parent)]
        pairs = [(v, root) for v, root in pairs if v != root]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["src", "dst"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("of"), F.least("src", "low").alias("low"))
    joined = both.join(least, both["src"] == least["of"]).where(F.col("dst") > F.col("src"))
    return joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "of")
    joined = edges.join(least, edges["src"] == least["of"])
    hung = joined.where(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return hung.unionByName(least.select(F.col("of").alias("src"), F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id and root of each vertex that is not the smallest of its component; edges: src and dst, in any direction.

    Large and small stars alternate until each vertex hangs on its root; the number of rounds grows with the logarithm of a
    component's size. Each round is written to the shared folder. Edges with a null end and loops are left out.
    """
    kept = edges.where("src <> dst").select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst"))
    stars = stored(kept.mapInArrow(_forest, "src long, dst long").distinct())
    while True:
        sources = stars.agg(F.count("*").alias("n"), F.countDistinct("src").alias("vertices")).first()
        roots = stars.select(F.col("dst").alias("src")).distinct()
        if sources["n"] == sources["vertices"] and stars.join(roots, "src", "left_semi").isEmpty():
            return stars.select(F.col("src").alias("id"), F.col("dst").alias("root"))
        last, stars = stars, stored(_small_star(_large_star(stars)))
        discard(last)
