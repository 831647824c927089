"""Rule sets as data, turned into one expression each: weighted phrases, scrubbing, gates with reasons, classifiers.

A rule set is a short ordered list, so it becomes a constant of the plan (no join, no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import clamp


def _phrases(phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(_phrases(phrases), lambda p: F.contains(text, p)) if phrases else F.lit(False)


def scrub(text: Column, phrases: Sequence[str]) -> Column:
    """Each phrase to a blank, one after the other in the given order (they may overlap)."""
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(" "))
    return text


def weighted_hits(text: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """The sum of the weights of the phrases contained; each counts once.

    A loop over a constant array: a term for each phrase would make methods too long for the JVM to compile.
    """
    if not weights:
        return F.lit(0)
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in weights])
    return F.aggregate(rules, F.lit(0), lambda total, r: total + F.when(F.contains(text, r["p"]), r["w"]).otherwise(0))


def hit_count(text: Column, phrases: Sequence[str]) -> Column:
    return weighted_hits(text, [(p, 1) for p in phrases])


def hit_list(text: Column, phrases: Sequence[str], most: int) -> Column:
    """The phrases contained, in rule order, at most ``most``."""
    return F.slice(F.filter(_phrases(phrases), lambda p: F.contains(text, p)), 1, most)


def first_reason(cases: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds; null when none does. Written order is evaluation order."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(cases):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    return F.coalesce(first_reason([(text.rlike(p), label) for p, label in rules]), F.lit(default))


def where_not(df: DataFrame, column: str, value: str) -> DataFrame:
    """``column != value`` as a filter that stays above the projections that compute the column.

    Pushed down, such a filter would hold every expression the column is made of, written out once for each use. Tied
    to the row's running number, which is never negative, the column is non-deterministic for the optimizer, and it pushes
    no filter below that.
    """
    return df.withColumn(column, F.when(F.monotonically_increasing_id() >= 0, F.col(column))).where(F.col(column) != value)


@dataclass(frozen=True)
class ScoreRules:
    """Weighted dictionaries of one scorer."""

    strong: Sequence[tuple[str, int]]
    medium: Sequence[tuple[str, int]]
    soft_risk: Sequence[tuple[str, int]]
    hard_risk: Sequence[str]
    negated: Sequence[str] = ()
    base: int = 12
    coefficients: tuple[float, float, float] = (0.6, 0.3, 0.42)
    hard_cap: int = 54
    tiers: Sequence[tuple[str, int, int]] = field(default=(("high", 60, 20), ("review", 35, 45)))


def scored(df: DataFrame, text: str, fresh: str, rules: ScoreRules) -> DataFrame:
    """Adds ``strength``, ``risk``, ``overall``, ``tier`` and ``reasons`` by a lower-case text and a freshness.

    One projection for each step: what several later expressions use is computed once, not written into each of them.
    """
    a, f, k = rules.coefficients
    weighted = [(p, w, 1) for p, w in rules.strong] + [(p, w, 0) for p, w in rules.medium]
    bonus = F.when(F.col("__tm_hits") >= 2, 12).when(F.col("__tm_hits") == 0, -18).otherwise(0)
    # each phrase is looked for once; sums, counts and reasons come from the list of those found
    found = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(s).alias("s")) for p, w, s in weighted]), lambda r: F.contains(F.col(text), r["p"]))
    total = lambda name: F.aggregate("__tm_found", F.lit(0), lambda acc, r: acc + r[name])
    df = df.withColumns({"__tm_found": found, "__tm_z": scrub(F.col(text), rules.negated)})
    df = df.withColumns({"__tm_hits": total("s"), "__tm_sum": total("w"), "__tm_hard": contains_any(F.col("__tm_z"), rules.hard_risk), "__tm_soft": weighted_hits(F.col("__tm_z"), rules.soft_risk), "reasons": F.array_join(F.slice(F.transform("__tm_found", lambda r: r["p"]), 1, 6), ",")})
    df = df.withColumns({"strength": clamp(F.lit(rules.base) + F.col("__tm_sum") + bonus), "risk": clamp(F.col("__tm_soft") + F.when(F.col("__tm_hard"), 70).otherwise(0))})
    df = df.withColumn("overall", clamp(F.col("strength") * F.lit(a) + F.col(fresh) * F.lit(f) + F.lit(10.0) - F.col("risk") * F.lit(k)))
    df = df.withColumn("overall", F.when(F.col("__tm_hard"), F.least("overall", F.lit(rules.hard_cap))).otherwise(F.col("overall")))
    tiers = [((F.col("overall") >= low) & (F.col("risk") <= top) & ~F.col("__tm_hard"), name) for name, low, top in rules.tiers]
    return df.withColumn("tier", F.coalesce(first_reason(tiers), F.lit("hidden"))).drop("__tm_found", "__tm_z", "__tm_hits", "__tm_sum", "__tm_hard", "__tm_soft")
