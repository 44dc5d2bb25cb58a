"""A quadtree as lines in pre-order: each node before its children, these in the order NW, NE, SW, SE.

A node's number is its place in a sort by the Z-order position of its first deepest cell, upper levels first. Lines carry
a level and a quadrant but no cell; which nodes are above a line are the last lines of each higher level before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .best_first import running_sums
from .pyramid import DEEP, morton

#: Lines whose ancestors are looked for together; what stands before them comes from a table of these parts.
PART = 1 << 16


def first_deepest(depth: int = DEEP) -> Column:
    """The Z-order position of the first deepest cell in a node ``(level, ci, cj)``."""
    down = lambda c: F.expr(f"shiftleft({c}, {depth} - level)")
    return morton(down("ci"), down("cj"), depth)


def preorder(nodes: DataFrame, depth: int = DEEP) -> DataFrame:
    """``nodes`` ``(level, ci, cj, ...)`` with ``n``, their number from 0 on, and ``quadrant``, 0 to 3 in their parent.

    Nodes are dealt by ranges of the order and numbered in each; a range's first number is the size of those before it.
    """
    keyed = nodes.withColumns({"_z": first_deepest(depth), "_one": F.lit(1).cast("long")})
    quadrant = (F.col("ci").bitwiseAND(F.lit(1)) + 2 * F.col("cj").bitwiseAND(F.lit(1))).cast("int")
    return running_sums(keyed, [F.col("_z"), F.col("level")], "_one").withColumnRenamed("before", "n").withColumn("quadrant", quadrant).drop("_z", "_one")


def write_lines(nodes: DataFrame, path: str, depth: int = DEEP) -> None:
    """A tree as text: ``n,level,quadrant`` and what else the nodes have, in files that follow each other."""
    lines = preorder(nodes, depth).drop("ci", "cj")
    rest = [c for c in lines.columns if c not in ("n", "level", "quadrant")]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.select("n", "level", "quadrant", *rest).repartitionByRange(tasks, "n").sortWithinPartitions("n").write.mode("overwrite").csv(path)


def read_lines(spark: SparkSession, path: str, rest: str = "cnt long") -> DataFrame:
    """The tree of a text of :func:`write_lines`, with its cells; ``rest``: the further columns and their types."""
    return cells_of(spark.read.schema(f"n long, level int, quadrant int, {rest}").csv(path))


def cells_of(lines: DataFrame, depth: int = DEEP) -> DataFrame:
    """``lines`` ``(n, level, quadrant, ...)`` with their cells ``ci, cj``, from the order of levels alone.

    A line's path is the quadrant of the last line so far at each level. In a part of ``PART`` lines these are windows over the
    part; what they start with is the same over the parts' last lines, of which there is one for each level.
    """
    parted = lines.withColumn("_part", F.floor(F.col("n") / PART).cast("long"))
    levels = F.sequence(F.lit(1), F.lit(depth))
    last = parted.where("level > 0").groupBy("_part", "level").agg(F.max_by("quadrant", "n").alias("_q"))
    grid = parted.select("_part").distinct().select("_part", F.explode(levels).alias("level")).join(last, ["_part", "level"], "left")
    earlier = Window.partitionBy("level").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.withColumn("_q", F.last("_q", ignorenulls=True).over(earlier)).groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("level", "_q"))).alias("_before"))
    so_far = Window.partitionBy("_part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.array(*[F.last(F.when(F.col("level") == k, F.col("quadrant")), ignorenulls=True).over(so_far) for k in range(1, depth + 1)])
    wide = parted.withColumn("_own", own).join(before, "_part")
    path = F.slice(F.zip_with("_own", "_before", lambda q, b: F.coalesce(q, b["_q"])), F.lit(1), F.col("level"))
    index = lambda bit: F.aggregate("_path", F.lit(0).cast("long"), lambda a, q: a * 2 + F.shiftright(q, bit).bitwiseAND(F.lit(1)))
    return wide.withColumn("_path", path).withColumns({"ci": index(0), "cj": index(1)}).drop("_part", "_own", "_before", "_path")
