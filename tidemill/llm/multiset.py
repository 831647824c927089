"""Duplicates hidden by formatting: one record for each set of equal cards, with its number of copies.

Each normalized field-name and value pair is hashed; the hashes are added up (a commutative multiset hash, so the
order of fields doesn't matter), cards meet by that fingerprint in a hash aggregation, and the normalized fields beside
it in the aggregation key are compared as a whole, so equal fingerprints of unequal fields stay apart. Nothing is sorted
and copies are counted before the shuffle, so a card with a third of all copies costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1


def bare(value: Column) -> Column:
    """Without case, white space and punctuation (separators and brackets included)."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\p{P}\p{Z}\p{C}\s|｜¦]+", "")
    # letters whose upper case is written with others: ß and SS, ſ and S, ς and Σ meet
    return F.replace(F.translate(F.lower(kept), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def fields_of(payload: Column, form: Column, names: list[str]) -> list[Column]:
    """The named fields of a payload written as a JSON object or as ``key = value`` lines; empty where it can't be read."""
    schema = ", ".join(f"`{n}` string" for n in names) + ", __bad string"
    js = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    line = lambda n: F.regexp_extract(payload, rf"(?im)^[\s\u3000]*{n}[\s\u3000]*[=:](.*)$", 1)
    return [F.coalesce(F.when(form == "lines", line(n)).when(js["__bad"].isNull(), js[n]), F.lit("")).alias(n) for n in names]


def multiset_hash(pairs: dict[str, Column]) -> list[Column]:
    """Four 32-bit lanes: sums of the hashes of (name, value) pairs, in any order."""
    lanes = []
    for seed in (11, 23):
        h = [F.xxhash64(F.lit(seed), F.lit(n), v) for n, v in pairs.items()]
        for part in (lambda x: x.bitwiseAND(F.lit(_MASK)), lambda x: F.shiftrightunsigned(x, 32)):
            total = part(h[0])
            for x in h[1:]:
                total = total + part(x)
            lanes.append(total.bitwiseAND(F.lit(_MASK)))
    a, b, c, d = lanes
    return [F.shiftleft(a, 32).bitwiseXOR(b).alias("f1"), F.shiftleft(c, 32).bitwiseXOR(d).alias("f2")]


def collapse(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each distinct record: the smallest ``key`` as ``first``, ``copies`` and the normalized fields.

    Rows with a null key or with a field that is null or has nothing left once bare (blank, punctuation only) take no
    part. Rows repeated with the same key count as copies. An empty table gives no rows; long values are compared whole;
    other columns take no part.
    """
    # tied to the row's running number, so that the filters below aren't pushed down and each field is parsed once
    once = F.monotonically_increasing_id() >= 0
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[F.when(once, bare(F.col(f))).alias(f"v{i}") for i, f in enumerate(fields)])
    values = [f"v{i}" for i in range(len(fields))]
    for v in values:
        rows = rows.where(F.length(v) > 0)
    rows = rows.select("k", *values, *multiset_hash({f: F.col(v) for f, v in zip(fields, values)}))
    groups = rows.groupBy("f1", "f2", *values).agg(F.min("k").alias("first"), F.count("*").alias("copies"))
    return groups.select("first", "copies", *[F.col(v).alias(f) for f, v in zip(fields, values)])
