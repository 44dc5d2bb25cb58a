"""URL filters: rules on hosts and path prefixes, applied by a sort-merge range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, shuffle_width


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.greatest(F.length(rest), F.lit(1))), r"^[^?#]*", 0)
    return lower_ascii(host), path


def reversed_key(host: Column) -> Column:
    """``www.example.org`` -> ``org.example.www.``: a host and its subdomains are one interval of keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def apply_url_rules(
    pages: DataFrame, rules: Sequence[tuple[str, str]], *, url: str = "url", default: str = "allow", salts_per_partition: int = 16
) -> DataFrame:
    """All columns of ``pages`` plus ``host, path, rule, verdict``.

    ``rules``: (verdict, ``host/path-prefix``) pairs. A rule fits its host and all subdomains if
    the path starts with the rule's path; the longest fitting rule wins, no rule gives ``default``.

    The keys of rule hosts and page hosts are sorted together. Reversed hosts turn "this host and
    its subdomains" into an interval that opens at the rule's key; intervals nest or are disjoint,
    so one running "last opened at depth d" per nesting depth is the stack of active rules, and an
    entry is active while the page's key still has it as a prefix. Pages are dealt evenly over salts
    (a host with a third of the pages is split), the few rule rows go to every salt.

    Null and odd urls have an empty host and path and get the default; urls of any length are judged
    whole; repeated pages are judged one by one; of two rules with the same string the one with the
    greater verdict wins (block over allow); columns of ``pages`` named like the results are replaced,
    all others kept; an empty table stays empty.
    """
    spark = pages.sparkSession
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))
    keys = {h: ".".join(reversed(h.split("."))) + "." for h in by_host}
    depth = {h: sum(keys[h].startswith(keys[o]) for o in by_host) - 1 for h in by_host}
    levels = max(depth.values(), default=-1) + 1
    salts = salts_per_partition * shuffle_width(spark)

    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(pages[url])
    left = pages.select(F.struct(*[pages[c] for c in names]).alias("_page"), host.alias("_host"), path.alias("_path"))
    left = left.select("_page", "_host", "_path", reversed_key(F.col("_host")).alias("_key"))
    left = left.withColumn("_salt", F.pmod(F.xxhash64("_page"), F.lit(salts)).cast("int"))
    if not levels:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
        return left.select("_page.*", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))

    opened = spark.createDataFrame(
        [(keys[h], depth[h], [(p, r, v) for p, r, v in by_host[h]]) for h in by_host],
        "_key string, _depth int, _set array<struct<path:string,rule:string,verdict:string>>",
    )
    opened = opened.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = left.withColumn("_row", F.lit(1)).unionByName(opened.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("_salt").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [
        F.last(F.when((F.col("_row") == 0) & (F.col("_depth") == d), F.struct("_key", "_set")), ignorenulls=True).over(sweep).alias(f"_open{d}")
        for d in range(levels)
    ]
    swept = rows.select("_row", "_page", "_host", "_path", "_key", *stack).where("_row = 1")
    active = F.flatten(
        F.array(*[F.when(F.startswith("_key", F.col(f"_open{d}._key")), F.col(f"_open{d}._set")).otherwise(F.expr("filter(array(), x -> false)").cast("array<struct<path:string,rule:string,verdict:string>>")) for d in range(levels)])
    )
    fits = F.filter(active, lambda r: F.startswith(F.col("_path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("_best", best).select(
        "_page.*",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
