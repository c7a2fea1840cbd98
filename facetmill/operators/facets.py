"""Facet counts, distributions and fill rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import SearchConfig
from .predicates import all_of, clauses, nonblank


def _values(columns: Mapping[str, str]) -> Column:
    """An array of (dim, value) of a row's dimensions that aren't blank."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).cast("string").alias("value")) for d, c in columns.items()])
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of each dimension, ties by value."""
    order = Window.partitionBy("dim").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def exclude_self(df: DataFrame, config: SearchConfig, filters: Mapping[str, Sequence[str]], limit: int = 300) -> DataFrame:
    """dim, value, n, rank: counts of each dimension under all filters but its own.

    One pass: a row that fails no filter counts in all dimensions, one that fails a single filter
    counts in that dimension alone. The counts combine on the map side before the only shuffle.
    """
    active = clauses(config, filters)
    failed = F.filter(F.array(*[F.when(~c, F.lit(d)) for d, c in active.items()]), lambda d: d.isNotNull()) if active else F.array().cast("array<string>")
    rows = df.withColumn("_failed", failed).filter(F.size("_failed") <= 1)
    own = F.filter(_values(config.dimensions), lambda p: (F.size("_failed") == 0) | (F.get("_failed", F.lit(0)) == p["dim"]))
    counts = rows.select(F.inline(own)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_values(counts, limit)


def distributions(df: DataFrame, columns: Mapping[str, str], limit: int = 100) -> DataFrame:
    """dim, value, n, rank without filters."""
    return top_values(counted(df, columns), limit)


def counted(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """dim, value, n of all dimensions, in one pass."""
    return df.select(F.inline(_values(columns))).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def marked(facets: DataFrame, filters: Mapping[str, Sequence[str]]) -> DataFrame:
    """Facet values with whether a filter selects them."""
    chosen = [F.concat(F.lit(d + "\x00"), F.lit(str(v))) for d, vs in filters.items() for v in vs]
    key = F.concat("dim", F.lit("\x00"), "value")
    return facets.withColumn("selected", key.isin(*chosen) if chosen else F.lit(False))


def fill_rates(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Share of rows in which each column is filled; 0.0 for an empty table. 0 counts as empty."""

    def full(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.when(nonblank(c) & (c.cast("string") != "0"), 1.0).otherwise(0.0)

    return df.agg(*[F.coalesce(F.avg(full(c)), F.lit(0.0)).alias(name) for name, c in columns.items()])


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(F.when(nonblank(F.col(c)), F.col(c))).alias(c) for c in columns])


def column_report(df: DataFrame, columns: Sequence[str], samples: int = 8) -> DataFrame:
    """column, filled, empty and its most frequent values, from one unpivoted pass.

    The first ranks of a column are kept on each side of the shuffle, so no task sorts all values of a column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    full = nonblank(F.col("value"))
    totals = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    best = counts.filter(full).withColumn("rank", rank).filter(F.col("rank") <= samples)
    text = F.struct("rank", F.concat_ws("=", "value", F.col("n").cast("string")).alias("text"))
    shown = best.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda s: s["text"]), "; ").alias("samples"))
    return totals.join(shown, "column", "left").select("column", "filled", "empty", F.coalesce("samples", F.lit("")).alias("samples"))


def core_score(columns: Mapping[str, Column], name: str, bonus: float = 0.15) -> tuple[Column, Column]:
    """How many core fields are filled, and the confidence from that."""
    count = sum((F.when(nonblank(c), 1).otherwise(0) for c in columns.values()), F.lit(0))
    share = count / F.lit(float(len(columns)))
    return count, F.when(nonblank(columns[name]), F.least(F.lit(1.0), share + bonus)).otherwise(share)


def status_rollup(df: DataFrame, status: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: the total and how many rows have one of each group's statuses."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status).isin(list(v))).alias(k) for k, v in groups.items()])


def suggestions(df: DataFrame, columns: Sequence[str], needle: str, limit: int = 12) -> DataFrame:
    """Distinct values that contain a string, in the order of their columns, then by value."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    values = df.select(F.inline(pairs)).filter(nonblank(F.col("value")) & F.contains(F.lower("value"), F.lit(needle.lower()))).distinct()
    return values.orderBy("position", "value").limit(limit).select("dim", "value")


def narrowed(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.filter(all_of(conditions))
