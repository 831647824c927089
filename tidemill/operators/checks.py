"""Invariants of a published table as a table of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``key`` and ``violation`` for each rule (name, condition that must hold) that a row breaks; an unknown condition counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return df.select(F.col(key), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("violation"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
