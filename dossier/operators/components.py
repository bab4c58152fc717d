"""Merge forests and components of links between rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize, release

#: Links whose forest a task finds at once.
LINKS = 1 << 18


def resolve_roots(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root) of a forest of (id, parent), by pointer jumping: each round doubles the hops.

    A null parent marks a root, as does a parent that is no row. Rows of a cycle raise ValueError.
    """
    at = materialize(edges.select("id", F.coalesce("parent", "id").alias("root")).dropDuplicates(["id"]), "roots")
    for _ in range(rounds):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("above"))
        step = materialize(at.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
        release(at)
        at = step
        if at.where("moved").isEmpty():
            return at.select("id", "root")
    raise ValueError("the links hold a cycle")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of up to LINKS links at a time, one for each node to the smallest that it reaches by them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def done() -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root.setdefault(low, low)
            root[high] = low
        if len(root) >= LINKS:
            yield done()
            root.clear()
    if root:
        yield done()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id of the links (a, b: long); root is the smallest id reachable.

    Distributed union-find: first each partition's links become a forest, then large-star and small-star passes
    alternate. A pass is a minimum per node, combined before its shuffle, and an equi-join whose hot keys the
    adaptive planner splits, so a hub's neighbours never meet in one task. A round is one table in the shared
    folder; the driver sees one checksum of it. Up to LINKS / 2 links of the partitions' forests are one task's
    forest instead, which needs no rounds: they have LINKS nodes at most. No links, no rows.
    """
    own = links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = materialize(own.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    seen, few = None, edges.count() <= LINKS // 2
    if few:
        whole = materialize(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "edges")
        release(edges)
        edges = whole
    while not few:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        # large-star: what lies above a node is tied to the least of its neighbourhood
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = edges.select(F.col("b").alias("u"), "a").join(least, "u").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: what lies below a node is tied to the least below it
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct(), "edges")
        release(edges)
        edges = new
    one = lambda frame, id_: frame.select(F.col(id_).cast("long").alias("id"), F.col("b").cast("long").alias("root"))
    return one(edges, "a").unionByName(one(edges, "b")).unionByName(one(links.where("a = b"), "a")).groupBy("id").agg(F.min("root").alias("root"))
