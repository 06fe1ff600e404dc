"""Connected components of a table of links, by alternating large-star and small-star steps; up to SMALL links, whose number is counted
first, by one task's union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_merge, discard, staged

MAX_ROUNDS = 60
SMALL = 250_000  # links that one task may hold: some 30 MB


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours are linked to the smallest of them and itself. Large star: neighbours greater than the node, seen from both
    ends of a link; small star: neighbours smaller than it. Only minima are grouped; the rest is a join, which splits hot keys."""
    seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(by_merge(least), "a")
    if both_ways:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    rest = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is its smallest reachable node. Null ends and self-links are left out.

    Every round is written to the shared folder, so lost executors cost one round, and links never meet on the driver."""
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    links = staged(links, "links")
    if links.count() <= SMALL:
        return links.coalesce(1).mapInArrow(_union_find, "node long, component long")
    before = _state(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        last, links = links, staged(_star(_star(links, True), False), "links")
        discard(last)
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _union_find(batches):
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "component"])


def _state(links: DataFrame) -> tuple:
    """Two numbers that the same links always give, whatever their order."""
    got = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return got[0], got[1]
