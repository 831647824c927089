"""Snapshots merged with the one before: carry-over, upsert, actions, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators.dedupe import best_of


def carried(previous: DataFrame, current: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows of the previous snapshot of which none of the keys is in the current one: an anti-join for each key, since one join on a disjunction couldn't hash. Null keys never match. Keys are compared among rows of the same ``within``."""
    for k in keys:
        previous = previous.join(current.where(F.col(k).isNotNull()).select(*within, k).distinct(), [*within, k], "left_anti")
    return previous


def decayed(x: Column, days: Column, start: int, per_day: int, floor: int) -> Column:
    """A carried row's confidence: no more than it had, falling by the day to a floor."""
    return F.least(x, F.greatest(F.lit(floor), F.lit(start) - per_day * days))


def with_previous(df: DataFrame, number: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbers of all deliveries after the first; their rows; and the rows of the delivery before, under the number of the one that follows. Gaps in the numbers are no deliveries."""
    steps = df.where(F.col(number).isNotNull()).select(number).distinct()
    steps = steps.withColumn("__tm_before", F.lag(number).over(W.orderBy(number))).where("__tm_before IS NOT NULL")
    old = df.withColumnRenamed(number, "__tm_before").join(F.broadcast(steps), "__tm_before").select(*df.columns)
    return steps.select(number), df.join(F.broadcast(steps.select(number)), number, "left_semi").select(*df.columns), old


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All rows of both; the new one wins."""
    both = old.withColumn("__tm_p", F.lit(1)).unionByName(new.withColumn("__tm_p", F.lit(0)))
    return best_of(both, list(key), [F.col("__tm_p")]).drop("__tm_p")


def seen_again(fresh: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Fresh rows with the first sight and the number of sights carried over from the previous snapshot."""
    before = previous.select(key, F.col("first_seen").alias("__tm_first"), F.col("seen_count").alias("__tm_seen"))
    return fresh.join(before, key, "left").withColumns({
        "first_seen": F.coalesce("__tm_first", "first_seen"), "seen_count": F.coalesce("__tm_seen", F.lit(0)) + 1, "is_new": F.col("__tm_seen").isNull(),
    }).drop("__tm_first", "__tm_seen")


def merged_seeds(old: DataFrame, new: DataFrame, key: str, strong: str, values: Sequence[str]) -> DataFrame:
    """Full outer merge by key; a strong old row isn't replaced by a weak new one."""
    a, b = old.alias("a"), new.alias("b")
    keep_old = F.col(f"b.{key}").isNull() | (F.coalesce(F.col(f"a.{strong}"), F.lit(False)) & ~F.coalesce(F.col(f"b.{strong}"), F.lit(False)))
    pick = lambda c: F.when(keep_old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), pick(strong), *[pick(v) for v in values])
