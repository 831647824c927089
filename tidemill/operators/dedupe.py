"""Best row of a key and duplicate groups. One shuffle by the key each; a hot key's rows are reduced map-side where the result allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order. ``row_number() = 1`` becomes a group limit on both sides of the shuffle, so each task sends one row for a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__tm_rn", F.row_number().over(w)).where("__tm_rn = 1").drop("__tm_rn")


def duplicate_groups(df: DataFrame, key: str, order: Sequence[Column], place: str, most: int, count: str | None = None) -> DataFrame:
    """The best row of each group with ``duplicate_count`` and up to ``most`` distinct ``alternates`` of ``place``.

    ``count`` sums the rows' own counts (at least 1 each), else the group's rows are counted. The alternates are the
    smallest in order; they come from the distinct places of a group, so copies of a place are reduced map-side.
    """
    size = F.sum(F.greatest(F.lit(1), F.coalesce(F.col(count), F.lit(1)))) if count else F.count("*")
    totals = df.groupBy(key).agg(size.cast("bigint").alias("duplicate_count"))
    places = df.where(F.col(place).isNotNull()).select(key, place).distinct()
    ranked = places.withColumn("__tm_rn", F.row_number().over(W.partitionBy(key).orderBy(place))).where(F.col("__tm_rn") <= most)
    lists = ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(place)), "; ").alias("alternates"))
    return best_of(df, [key], order).drop("duplicate_count", "alternates").join(totals, key).join(lists, key, "left")
