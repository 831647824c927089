"""Titles held against titles: a blend of sequence and token similarity, then a one-to-one assignment."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.text import word_key


def similarity(a: str | None, b: str | None) -> float:
    """0.72 parts sequence ratio and 0.28 parts token overlap; at least 0.9 when one contains the other and has 8 characters."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    score = 0.72 * SequenceMatcher(None, a, b).ratio() + 0.28 * len(x & y) / max(1, len(x | y))
    return max(score, 0.9) if min(len(a), len(b)) >= 8 and (a in b or b in a) else score


def similarity_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y)], dtype="float64"), "double")(a, b)


def best_matches(seeds: DataFrame, rows: DataFrame, seed_key: str, row_key: str, title: str, least: float = 0.78) -> DataFrame:
    """For each row its most similar seed of the same company, one-to-one: mutual best matches (ties by key).

    Candidates meet by company and the longest word of the title (the blocking), never all by all. A seed and a row are matched when each is the other's best.
    """
    longest = lambda c: F.array_max(F.transform(F.split(c, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    a = seeds.select(F.col(seed_key).alias("s"), F.col("company").alias("c"), word_key(F.col(title)).alias("x")).where("c IS NOT NULL")
    b = rows.select(F.col(row_key).alias("r"), F.col("company").alias("c"), word_key(F.col(title)).alias("y")).where("c IS NOT NULL")
    a, b = a.withColumn("w", longest(F.col("x"))), b.withColumn("w", longest(F.col("y")))
    scored = a.join(b, ["c", "w"]).withColumn("score", similarity_column(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    ranked = scored.withColumn("of_row", F.row_number().over(W.partitionBy("r").orderBy(F.desc("score"), "s"))).withColumn("of_seed", F.row_number().over(W.partitionBy("s").orderBy(F.desc("score"), "r")))
    return ranked.where("of_row = 1 AND of_seed = 1").select(F.col("r").alias(row_key), F.col("s").alias(seed_key), F.bround("score", 4).alias("score"))
