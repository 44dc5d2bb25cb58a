"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task holds: no more than these are joined in one task (some 60 MB), and a round over more has a task for each so many.
EDGES_A_TASK = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all a task's edges with their components: the larger of two roots hangs below the smaller."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    kind = pa.int64()
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    nodes = list(above)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array(map(root, part), kind)], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` edges -> ``(node, component)``, component being the smallest node reachable.

    Up to :data:`EDGES_A_TASK` different edges, as counted, are joined in one task. Of more, alternating large-star and small-star rounds (each a group-by and a join) contract every
    component to a star around its smallest node in about log(n) rounds; each round is
    written to the shared folder. The number of tasks follows that of the edges, and nothing is broadcast. Rows with a null end and self-loops are ignored;
    an empty edge list gives an empty result. Nodes without an edge do not appear.
    """

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = written(e, "edges")
    seen = mark(e)
    if seen[0] <= EDGES_A_TASK:
        kind = e.schema["u"].dataType.simpleString()
        return written(e.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), "components")
    for _ in range(max_rounds):
        e = e.coalesce(seen[0] // EDGES_A_TASK + 1)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low.hint("merge"), "u")
        e = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        e = written(e, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
