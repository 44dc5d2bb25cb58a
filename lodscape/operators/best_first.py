"""Best-first search over a quadtree under a budget of samples, without a queue.

A search takes nodes in non-increasing order of the least benefit on their path from the root. The deepest node of a
path with that least benefit is its bottleneck: once the search takes a bottleneck, it takes what hangs below it with
greater benefits before any other. So nodes sort by bottleneck, running sums of their costs tell at which bottleneck
the budget may run out, and only what hangs below that one has to be searched further, the same way or, if it is a
few nodes, with a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import cell_meets
from ..functions.viewport import Viewport
from ..sources.scratch import settled

#: The budget of a query that names none, and how many nodes may be searched with a heap.
DEFAULT_BUDGET, HEAP_NODES = 100_000, 10_000
#: Levels whose nodes meet their ancestors in one join, so a cell has at most 5461 rows of it.
_BLOCK, _LEVELS = 7, 28
_NODE = "level int, ci long, cj long"


def with_bottleneck(nodes: DataFrame) -> DataFrame:
    """``nodes`` ``(level, ci, cj, benefit, ...)`` and ``pathmin``, the least benefit of a node and its ancestors among them, and
    ``at, bi, bj``, the deepest of these that has it. Blocks of seven levels, from above."""
    out, above = None, None
    for top in range(0, _LEVELS, _BLOCK):
        block = nodes.where(F.col("level").between(top, top + _BLOCK - 1))
        ups = block.select(
            *[F.col(c).alias(a) for c, a in (("level", "l"), ("ci", "i"), ("cj", "j"))],
            F.explode(F.expr(f"transform(sequence({top}, level), u -> named_struct('level', u, 'ci', shiftright(ci, level - u), 'cj', shiftright(cj, level - u)))")).alias("up"),
        ).select("l", "i", "j", "up.*")
        least = ups.join(block.select("level", "ci", "cj", "benefit"), ["level", "ci", "cj"]).groupBy("l", "i", "j").agg(F.min(F.struct("benefit", -F.col("level"))).alias("least"))
        found = block.join(least.select(F.col("l").alias("level"), F.col("i").alias("ci"), F.col("j").alias("cj"), "least"), ["level", "ci", "cj"])
        if above is not None:
            over = above.select(F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("least").alias("over"))
            to_top = lambda c: F.expr(f"shiftright({c}, level - {top - 1})")
            found = found.join(over, (to_top("ci") == F.col("i")) & (to_top("cj") == F.col("j")), "left").drop("i", "j")
            found = found.withColumn("least", F.least("least", F.coalesce("over", "least"))).drop("over")
        found = settled(found, f"bottlenecks-{top}")
        above = found.where(F.col("level") == top + _BLOCK - 1)
        out = found if out is None else out.unionByName(found)
    at = -F.col("least.col2")
    return out.select("*", F.col("least.benefit").alias("pathmin"), at.alias("at"), F.expr("shiftright(ci, level + least.col2)").alias("bi"), F.expr("shiftright(cj, level + least.col2)").alias("bj")).drop("least")


def running_sums(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` and ``before``: the sum of a column over all rows earlier in an order that has no ties. Rows are dealt by ranges of
    the order; a range's own sum and those of the ranges before it make the whole."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settled(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = laid.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return laid.join(offsets, "_range").withColumn("before", F.col("_offset") + F.coalesce(own, F.lit(0))).drop("_range", "_offset")


def best_first(nodes: DataFrame, benefit: Column, v: Viewport, budget: int = 0) -> DataFrame:
    """``(level, ci, cj, x, y)``: the samples a best-first search answers with.

    ``nodes``: ``(level, ci, cj, x, y, ...)`` from the root down. The search takes the node with the
    greatest benefit (ties: upper level, then ci, cj) and replaces its sample by its children's that
    meet the viewport, until the budget is used up or no benefit is left. The driver sees one row for each search and
    at most ``HEAP_NODES`` nodes, whatever the budget.
    """
    budget = budget if budget > 0 else DEFAULT_BUDGET
    spark = nodes.sparkSession
    seen = settled(nodes.where(cell_meets(F.col("level"), F.col("ci"), F.col("cj"), v)).select("level", "ci", "cj", "x", "y", benefit.alias("benefit")), "seen")
    up = [(F.col("level") - 1).alias("level"), F.shiftright("ci", 1).alias("ci"), F.shiftright("cj", 1).alias("cj")]
    kids = seen.where("level > 0").groupBy(*up).agg(F.count("*").alias("kids"))
    costly = seen.drop("x", "y").join(kids, ["level", "ci", "cj"], "left").withColumn("cost", F.coalesce("kids", F.lit(0)) - 1).drop("kids")
    taken: list[DataFrame] = [spark.createDataFrame([], _NODE)]
    _take(with_bottleneck(costly).where("pathmin > 0"), budget - 1, taken)
    expanded = taken[0]
    for more in taken[1:]:
        expanded = expanded.union(more)
    expanded = settled(expanded, "expanded")
    below = expanded.select((F.col("level") + 1).alias("level"), F.col("ci").alias("pi"), F.col("cj").alias("pj"))
    children = seen.withColumns({"pi": F.shiftright("ci", 1), "pj": F.shiftright("cj", 1)}).join(below, ["level", "pi", "pj"], "left_semi")
    ends = children.select("level", "ci", "cj", "x", "y").union(seen.where("level = 0").select("level", "ci", "cj", "x", "y"))
    return ends.join(expanded, ["level", "ci", "cj"], "left_anti").select("level", "ci", "cj", "x", "y")


def _take(part: DataFrame, free: int, taken: list[DataFrame]) -> int:
    """Adds the nodes that a search of ``part`` expands to ``taken``; what is left of the budget, 0 or less if it ran out."""
    order = [F.col("pathmin").desc(), F.col("at"), F.col("bi"), F.col("bj")]
    groups = part.groupBy("pathmin", "at", "bi", "bj").agg(F.sum("cost").alias("cost"), F.sum(F.greatest("cost", F.lit(0))).alias("most"), F.count("*").alias("n"))
    groups, spent, last = running_sums(groups, order, "cost"), 0, None
    while free - spent > 0:
        # the first bottleneck, after the last one searched, at which the budget may run out
        later = groups if last is None else groups.where(_before(last, strictly=False))
        first = later.where(F.col("before") + F.col("most") >= free).agg(F.min(F.struct((-F.col("pathmin")).alias("less"), "at", "bi", "bj", "before", "n", "cost")).alias("g")).first()["g"]
        rest = part if last is None else part.where(_before(last, strictly=False))
        if first is None:
            taken.append(rest.select("level", "ci", "cj"))
            return free - groups.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("c")).first()["c"]
        taken.append(rest.where(~_before(first, strictly=True)).select("level", "ci", "cj"))
        own = part.where((F.col("pathmin") == -first["less"]) & (F.col("at") == first["at"]) & (F.col("bi") == first["bi"]) & (F.col("bj") == first["bj"]))
        left = free - first["before"]
        if first["n"] <= HEAP_NODES:
            found, left = _search(own.select("level", "ci", "cj", "benefit", "cost").collect(), left)
            taken.append(part.sparkSession.createDataFrame(found, _NODE))
        else:
            head = (F.col("level") == first["at"]) & (F.col("ci") == first["bi"]) & (F.col("cj") == first["bj"])
            taken.append(own.where(head).select("level", "ci", "cj"))
            left -= own.where(head).first()["cost"]
            if left > 0:
                left = _take(with_bottleneck(own.where(~head).drop("pathmin", "at", "bi", "bj")), left, taken)
        if left <= 0:
            return left
        last, spent = first, first["before"] + first["cost"]
    return free - spent


def _before(g, *, strictly: bool) -> Column:
    """Rows whose bottleneck comes after that of ``g``; without ``strictly`` not ``g``'s own, with it ``g``'s own too."""
    same, less = F.col("pathmin") == -g["less"], F.col("pathmin") < -g["less"]
    place = F.struct(*[F.col(c).cast("long").alias(c) for c in ("at", "bi", "bj")])
    own = F.struct(*[F.lit(g[c]).cast("long").alias(c) for c in ("at", "bi", "bj")])
    return less | (same & ((place >= own) if strictly else (place > own)))


def _search(rows: list, free: int) -> tuple[list[tuple], int]:
    """The nodes of a group below one bottleneck that are taken, and what is left of the budget."""
    known = {(r["level"], r["ci"], r["cj"]): r for r in rows}
    heap = [(-r["benefit"], *k) for k, r in known.items() if (k[0] - 1, k[1] >> 1, k[2] >> 1) not in known]
    heapq.heapify(heap)
    out = []
    while heap and free > 0:
        _, level, ci, cj = heapq.heappop(heap)
        out.append((level, ci, cj))
        free -= known[level, ci, cj]["cost"]
        for child in ((level + 1, 2 * ci + a, 2 * cj + b) for a in (0, 1) for b in (0, 1)):
            if child in known:
                heapq.heappush(heap, (-known[child]["benefit"], *child))
    return out, free
