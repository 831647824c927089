"""What changed between full snapshots of a table.

An index of the last snapshot is kept: one row for each key, with a 128-bit hash of its compared columns, in a bucketed
table. A new delivery is reduced to the same form and probed against the index, bucket by bucket and without a shuffle
of either; old values are fetched for the changed keys only. Then a pointer moves to the new index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import discard, fresh_path, publish, published

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def _cells(columns: Sequence[str]) -> list[Column]:
    """Each column and whether it is null: a null is equal to a null only."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def index_of(delivery: DataFrame, key: str, columns: Sequence[str], buckets: int = 16) -> DataFrame:
    """The index of one delivery: ``k``, ``h1`` and ``h2``, one row for each non-null key, hash-partitioned by key.

    Repeated rows count once. A key delivered with several different rows has the combination of all its distinct
    rows as its value, whatever their order, so it counts as changed exactly when that set changes. Repeats are dropped
    before the first shuffle, so a key that holds most rows costs each task one row.
    """
    h1, h2 = F.xxhash64(F.lit(1), *_cells(columns)), F.xxhash64(F.lit(2), *_cells(columns))
    rows = delivery.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), h1.alias("h1"), h2.alias("h2")).distinct()
    return rows.repartition(buckets, "k").groupBy("k").agg(F.bit_xor("h1").alias("h1"), F.xxhash64(F.bit_xor("h2"), F.count("*")).alias("h2"))


def probe(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """``k`` and ``change`` of the keys that differ between two indexes; where both are bucketed by key, nothing is shuffled."""
    old, new = index.select("k", F.col("h1").alias("o1"), F.col("h2").alias("o2")), fresh.select("k", F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    both = old.join(new, "k", "full_outer")
    change = (
        F.when(F.col("o1").isNull(), ADDED)
        .when(F.col("n1").isNull(), REMOVED)
        .when((F.col("o1") != F.col("n1")) | (F.col("o2") != F.col("n2")), CHANGED)
    )
    return both.select("k", change.alias("change")).where("change IS NOT NULL")


def deliveries(df: DataFrame, number: str) -> list[int]:
    """The delivery numbers in order. Their count is that of deliveries, not of rows."""
    return [r[0] for r in df.where(F.col(number).isNotNull()).select(number).distinct().orderBy(number).collect()]


def diff_all(df: DataFrame, number: str, key: str, columns: Sequence[str], buckets: int = 16) -> DataFrame:
    """``number``, ``key`` and ``change`` for each delivery after the first, against the delivery before it.

    The deliveries of the table are applied one after the other to a :class:`SnapshotIndex`. Gaps in the numbers are no
    deliveries. Null keys and repeated rows count for nothing; an empty table or a single delivery gives no rows; other
    columns, whatever their names, take no part.
    """
    kind = df.schema[number].dataType
    index, out = SnapshotIndex(df.sparkSession, fresh_path(df.sparkSession, "snapshots"), key, columns, buckets), []
    for n in deliveries(df, number):
        found = index.apply(df.where(F.col(number) == n))
        out.append(found.select(F.lit(n).cast(kind).alias(number), F.col("k").alias(key), "change"))
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], f"`{number}` {kind.simpleString()}, `{key}` string, change string")


def changed_values(old: DataFrame, new: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Old and new values of the changed keys only, one row for each changed column: key, column_name, old_value, new_value.

    ``changes`` has ``k`` and ``change``. Values are given as text. Where a delivery has several rows for a key, the
    smallest value of each column stands for it.
    """
    keys = changes.where(F.col("change") == CHANGED).select("k")
    side = lambda df: (
        df.join(keys, df[key] == keys["k"], "left_semi").groupBy(F.col(key).alias("k")).agg(*[F.min(F.col(c).cast("string")).alias(c) for c in columns])
    )
    a, b = side(old).alias("a"), side(new).alias("b")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a.{c}").alias("old_value"), F.col(f"b.{c}").alias("new_value")) for c in columns])
    return (
        a.join(b, "k")
        .select("k", F.explode(F.filter(cells, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))).alias("x"))
        .select(F.col("k").alias(key), "x.*")
    )


class SnapshotIndex:
    """The index kept between runs: bucketed tables of the last two deliveries below ``path`` and a pointer to the current version."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path.rstrip("/"), key, list(columns), buckets
        self.tables: dict[str, str] = {}

    def current(self) -> dict | None:
        """The current version (``version``, ``before``, ``schema`` of its values), or None before the first delivery."""
        text = published(self.spark, f"{self.path}/CURRENT")
        return json.loads(text) if text else None

    def _write(self, df: DataFrame, version: str, what: str) -> None:
        name = self.tables[f"{version}/{what}"] = f"tidemill_{version}_{what}"
        df.write.format("parquet").bucketBy(self.buckets, "k").option("path", f"{self.path}/{version}/{what}").saveAsTable(name)

    def _read(self, version: str, what: str, schema: str) -> DataFrame:
        """A kept table, hash-partitioned by key; one that an earlier session wrote is declared to this one first."""
        at = f"{version}/{what}"
        if at not in self.tables:
            self.tables[at] = f"tidemill_{version}_{what}_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[at]} ({schema}) USING parquet CLUSTERED BY (k) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{at}'")
        return self.spark.table(self.tables[at])

    def _index(self, state: dict, version: str) -> DataFrame:
        return self._read(version, "index", f"k {state['key']}, h1 bigint, h2 bigint")

    def _values(self, state: dict, version: str) -> DataFrame:
        return self._read(version, "rows", state["schema"])

    def apply(self, delivery: DataFrame) -> DataFrame:
        """Changes of ``delivery`` against the index (``k``, ``change``); then the index is swapped.

        The first delivery gives no changes. The new version is written completely before the pointer moves to it in one
        step, so a run that breaks off anywhere leaves the old version in place and the delivery can be applied again.
        """
        version, old = uuid.uuid4().hex, self.current()
        if old and old["buckets"] != self.buckets:
            raise ValueError(f"the index at {self.path} has {old['buckets']} buckets")
        values = delivery.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("k"), *[F.col(c).alias(f"v_{c}") for c in self.columns])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
        state = {"version": version, "before": (old or {}).get("version"), "schema": schema, "key": values.schema["k"].dataType.simpleString(), "buckets": self.buckets}
        self._write(values.distinct().repartition(self.buckets, "k"), version, "rows")
        self._write(index_of(self._values(state, version), "k", [f"v_{c}" for c in self.columns], self.buckets), version, "index")
        fresh = self._index(state, version)
        found = probe(self._index(old, old["version"]), fresh) if old else fresh.select("k", F.lit("").alias("change")).limit(0)
        found.write.parquet(f"{self.path}/{version}/changes")
        publish(self.spark, f"{self.path}/CURRENT", json.dumps(state))
        if old and old["before"]:  # of what lies further back, only the changes are kept
            for what in ("index", "rows"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(f'{old["before"]}/{what}', 'tidemill_none')}")
                discard(self.spark, f"{self.path}/{old['before']}/{what}")
        return self.spark.read.schema(found.schema).parquet(f"{self.path}/{version}/changes")

    def fetch(self) -> DataFrame:
        """Old and new values of the keys the last delivery changed, and of no others: key, column_name, old_value, new_value."""
        now = self.current()
        if not (now and now["before"]):
            return self.spark.createDataFrame([], f"`{self.key}` string, column_name string, old_value string, new_value string")
        changes = self.spark.read.parquet(f"{self.path}/{now['version']}/changes")
        named = [F.col("k").alias(self.key), *[F.col(f"v_{c}").alias(c) for c in self.columns]]
        return changed_values(self._values(now, now["before"]).select(*named), self._values(now, now["version"]).select(*named), changes, self.key, self.columns)
