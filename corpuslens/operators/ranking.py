"""Ranks and top-n per key that survive a key holding a large share of the rows.

``row_number() <= n`` lets Spark keep only n rows per key and map task before the shuffle
(WindowGroupLimit), so a hot key sends at most n rows per task to its reducer. Spark does that for
n up to ``spark.sql.optimizer.windowGroupLimitThreshold``. Beyond it, rows are dealt over ``SHARES`` shares of a key, cut to n in each,
and only what is left is ranked per key. A full rank spreads a hot key over many tasks, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.session import written


#: Shares of a key for a top-n that Spark does not cut by itself; so many times n rows of a key at most meet in one task.
SHARES = 128


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _top(df: DataFrame, keys: list[str], order: list[Column], n: int, column: str) -> DataFrame:
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(column) <= n)


def top_n_per_key(df: DataFrame, keys, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of every key in a total order; with ``rank`` the 1-based rank is kept."""
    column, keys = rank or "_rank", _names(keys)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        # Equal rows share a hash, which is as good for each: a share keeps n of its own. Maps can't be hashed.
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
        shares = df.withColumn("_share", F.pmod(hashed, F.lit(SHARES)))
        df = _top(shares, [*keys, "_share"], order, n, column).drop("_share", column)
    ranked = _top(df, keys, order, n, column)
    return ranked if rank else ranked.drop(column)


def first_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return top_n_per_key(df, keys, order, 1)


def row_number_per_key(df: DataFrame, keys, order: list[Column], rank: str) -> DataFrame:
    """Exact row_number per key in the given order, whatever the values: sparse, equal and null positions cost nothing more.

    Rows are range-partitioned and sorted by key and order, so a key that holds a large share of them spreads over many tasks, and
    written once with their place (partition and number in it). Only one row per key and partition is then counted: a key's first
    place there, and how many of its rows lie in earlier partitions. That table is joined back (Spark broadcasts it while it is
    small). Rows that the order leaves equal are numbered in any order, but each number is given once.
    """
    keys = _names(keys)
    sort = [*map(F.col, keys), *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "places").withColumn("_part", F.shiftright("_place", 33))
    run_keys = [f"_r_{key}" for key in keys]
    before = Window.partitionBy(*run_keys).orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*[F.col(key).alias(name) for key, name in zip(keys, run_keys)], F.col("_part").alias("_r_part"))
        .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .drop("_first", "_n")
    )
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in zip(keys, run_keys)]
    ranked = placed.join(runs, [*same, F.col("_part") == F.col("_r_part")])
    return ranked.withColumn(rank, F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift", "_r_part", *run_keys)


def ordered_distinct(df: DataFrame, keys, value: str, position: str) -> DataFrame:
    """Every value of a key once, with the position of its first occurrence."""
    return df.groupBy(*_names(keys), value).agg(F.min(position).alias("first_position"))


def last_match(df: DataFrame, keys, value: str, position: str) -> DataFrame:
    """The value at the last position of every key."""
    return df.groupBy(*_names(keys)).agg(F.max_by(value, position).alias(value))
