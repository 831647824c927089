"""Decayed statistics of sources and the order in which to try them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def decayed_fold(runs: Column, rate: float, digits: int = 4, start: Column | None = None) -> Column:
    """Folds one source's ordered values: each step decays, rounds and adds."""
    return F.aggregate(runs, F.lit(0.0) if start is None else start, lambda acc, x: F.bround(acc * rate, digits) + x)


def ordered_values(df: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """One row for each key with its values in order of ``at``, of which there is one for each run: bounded by the number of runs."""
    per_run = df.groupBy(key, at).agg(value.alias("v"))
    return per_run.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("v").cast("double").alias("v")))), lambda x: x["v"]).alias("runs"))


def two_to_one(df: DataFrame, score: str, key: str) -> DataFrame:
    """A cycle of two rows to exploit, one to explore: the better two thirds by score are interleaved with the rest; ``slot`` counts from 1.

    The rows are sources or profiles, a small table; the window over all of them is ranked in one task.
    """
    ranked = df.withColumn("rk", F.row_number().over(W.orderBy(F.desc(score), key)) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    preferred = F.ceil(F.col("n") * 2 / 3)
    r = F.when(F.col("rk") < preferred, F.col("rk")).otherwise(F.col("rk") - preferred)
    at = F.when(F.col("rk") < preferred, F.floor(r / 2) * 3 + r % 2).otherwise(r * 3 + 2)
    return ranked.withColumn("at", at).withColumn("slot", F.row_number().over(W.orderBy("at"))).drop("rk", "n", "at")


def rotated(pos: Column, cursor: int, n: Column) -> Column:
    """Positions after the cursor has moved on."""
    return F.pmod(pos - cursor, n)


def precision_score(prior: Column, seen: Column, final: Column, accepted: Column, rejected: Column) -> Column:
    """A prior plus rates weighted by how much has been seen."""
    weight = F.lit(0.35) + F.lit(0.65) * F.least(F.lit(1.0), seen / 20.0)
    rate = lambda x: F.when(seen > 0, x / seen).otherwise(0.0)
    return F.bround(prior + weight * (rate(final) * 500.0 + rate(accepted) * 180.0 - rate(rejected) * 120.0), 4)


def _diverse(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    left, out = list(pdf.sort_values(["score", "key"], ascending=[False, True]).itertuples(index=False)), []
    while left:
        recent = {r.family for r in out[-window:]} if window else set()
        k = next((i for i, r in enumerate(left) if r.family not in recent), 0)
        out.append(left.pop(k))
    return pd.DataFrame({"key": [r.key for r in out], "slot": range(1, len(out) + 1)})


def family_diverse(df: DataFrame, key: str, family: str, score: str, window: int = 2) -> DataFrame:
    """An order by score in which no family repeats within ``window`` places as long as another is left. Inherently sequential; the rows are profiles, a small table."""
    small = df.select(F.col(key).cast("string").alias("key"), F.col(family).cast("string").alias("family"), F.col(score).cast("double").alias("score"))
    return small.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: _diverse(pdf, window), "key string, slot bigint")


def batches_of(df: DataFrame, at: str) -> Iterator[DataFrame]:
    """The runs of a small history, in order."""
    for r in df.select(at).distinct().orderBy(at).toLocalIterator():
        yield df.where(F.col(at) == r[0])
