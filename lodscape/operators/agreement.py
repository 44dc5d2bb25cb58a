"""How far two labellings of the same rows agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    """Pairs among n rows, exact for any count."""
    d = n.cast("decimal(19,0)")
    return (d * (d - 1) / 2).cast("decimal(38,0)")


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, pairs, together, apart, rand, adjusted)``: of all pairs of rows, those that two labels both put together or both put
    apart, their share, and that share over what chance gives.

    No pair is listed: rows are counted by both labels, and a count of n is n (n - 1) / 2 pairs. Rows that lack a label
    are left out; of fewer than two rows, and of labellings that chance can't tell apart, the shares are 1.
    """
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    both = cells.agg(F.sum(_pairs(F.col("c"))).alias("both"), F.sum("c").alias("n"))
    one = lambda c: cells.groupBy(c).agg(F.sum("c").alias("c")).agg(F.sum(_pairs(F.col("c"))).alias(f"same_{c}"))
    # three tables of one row each
    whole = both.crossJoin(one("a")).crossJoin(one("b"))
    zero = F.lit(0).cast("decimal(38,0)")
    whole = whole.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, zero).alias(c) for c in ("both", "same_a", "same_b")])
    whole = whole.withColumn("pairs", F.coalesce(_pairs(F.col("n")), zero))
    apart = (F.col("pairs") + F.col("both") - F.col("same_a") - F.col("same_b")).cast("decimal(38,0)")
    d = lambda c: F.col(c).cast("double")
    expected = F.try_divide(d("same_a") * d("same_b"), d("pairs"))
    share, above = F.try_divide(d("both") + d("apart"), d("pairs")), F.try_divide(d("both") - expected, (d("same_a") + d("same_b")) / 2 - expected)
    longs = [F.col(c).cast("long").alias(name) for c, name in (("pairs", "pairs"), ("both", "together"), ("apart", "apart"))]
    return whole.withColumn("apart", apart).select("n", *longs, F.coalesce(share, F.lit(1.0)).alias("rand"), F.coalesce(above, F.lit(1.0)).alias("adjusted"))
