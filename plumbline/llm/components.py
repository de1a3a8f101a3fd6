"""Connected components of an edge table: each task first contracts the edges that it holds (a forest at a time), then large-star and small-star rounds join what tasks hold, until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import drop_written, shared_path, written


#: Edges that one task contracts at a time.
HELD = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same connections as edges from each node to the smallest that a task's edges join it with."""
    root: dict = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pd.DataFrame:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        return pd.DataFrame({"a": [x for x, _ in pairs], "b": [r for _, r in pairs]}, dtype=object)

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 2 * HELD:
            yield stars()
            root.clear()
    yield stars()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    near = _both(edges)
    low = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges: a, b of one type that can be ordered. Returns node, component (the smallest node that it reaches) of every
    node with an edge to another. Nulls and loops are left out. Each round is a table in the shared folder; a hot node's
    rows are summed up before they are shuffled, and joined by a join that Spark can split. Once at most HELD edges are left,
    one task ends it."""
    spark = edges.sparkSession
    last, mark = shared_path(spark, "stars"), None
    edges.where("a <> b").select("a", "b").mapInPandas(_contract, edges.select("a", "b").schema).distinct().write.parquet(last)
    now = spark.read.schema(edges.select("a", "b").schema).parquet(last)
    for _ in range(rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found[0] <= HELD:  # one task holds what is left
            now = now.coalesce(1).mapInPandas(_contract, now.schema)
            break
        if found == mark:
            break
        mark = found
        path = shared_path(spark, "stars")
        now = _small_star(_large_star(now.mapInPandas(_contract, now.schema).distinct()).where("a <> b").distinct()).where("a <> b").distinct()
        now.write.parquet(path)
        now = spark.read.schema(edges.select("a", "b").schema).parquet(path)
        drop_written(spark, last)
        last = path
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
