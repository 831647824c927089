"""Counts over an outcomes table: funnels, rates, leading groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def funnel(df: DataFrame, group: str, reason: str, top: int) -> DataFrame:
    """Rows, accepted and rejected by group, with the group's ``top`` reasons (most frequent first, ties by name)."""
    counts = df.groupBy(group, reason).agg(F.count("*").alias("n"))
    ranked = counts.where(F.col(reason).isNotNull()).withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), reason)))
    tops = ranked.where(F.col("rn") <= top).groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws("=", F.col(reason), F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), ",").alias("reasons")
    )
    totals = counts.groupBy(group).agg(F.sum("n").alias("evaluated"), F.sum(F.when(F.col(reason).isNull(), F.col("n")).otherwise(0)).alias("accepted"))
    tops = tops.withColumnRenamed(group, "__tm_g")
    return totals.withColumn("rejected", F.col("evaluated") - F.col("accepted")).join(tops, F.col(group).eqNullSafe(F.col("__tm_g")), "left").drop("__tm_g")


def share(part: str, whole: str) -> object:
    """A percentage with one digit, 0 for an empty whole."""
    return F.when(F.col(whole) > 0, F.bround(F.col(part) * 100.0 / F.col(whole), 1)).otherwise(0.0)


def leading(df: DataFrame, group: str, top: int) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(top)
