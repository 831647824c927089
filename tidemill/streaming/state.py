"""State carried from run to run, as streams: rows that expire, statistics that decay once for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.learning import decayed_fold
from tidemill.session import fresh_path


def last_seen_stream(stream: DataFrame, key: str, at: str, late: str = "2 days") -> DataFrame:
    """The latest sight of each key, with a watermark for late rows."""
    return stream.withWatermark(at, late).groupBy(key).agg(F.max(at).alias("last_seen"), F.count("*").alias("n_seen"))


def run_to_table(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; each micro-batch replaces the table, so repeating one changes nothing."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, label)
    schema = stream.schema

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", fresh_path(spark, f"{label}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def unexpired(state: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows seen within the time to live; one seen exactly so long ago is kept."""
    return state.where(F.col(at) >= F.expr(f"timestamp'{as_of}' - INTERVAL {days} DAYS"))


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def decayed_stream(stream: DataFrame, key: str, run: str, rate: float, label: str = "decay") -> DataFrame:
    """``key``, ``weight``, ``last_run``: each key's rows counted by run and folded with decay, each run exactly once.

    A micro-batch folds its runs, in order, onto the state of the one before and writes a new version of it; repeating
    a micro-batch writes the same version again, and runs up to a key's last one are left out.
    """
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, label)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"`{key}` {kinds[key]}, weight double, last_run {kinds[run]}"
    versions: list[int] = []

    def before(batch_id: int) -> DataFrame:
        older = [v for v in versions if v < batch_id]
        return spark.read.schema(schema).parquet(f"{out}/{older[-1]}") if older else spark.createDataFrame([], schema)

    def fold(batch: DataFrame, batch_id: int) -> None:
        old = before(batch_id)
        counts = batch.groupBy(key, run).agg(F.count("*").cast("double").alias("v")).join(old.select(key, "last_run"), key, "left").where(F.col("last_run").isNull() | (F.col(run) > F.col("last_run")))
        runs = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), "v"))).alias("x"))
        both = old.join(runs, key, "full_outer").select(
            key, decayed_fold(F.coalesce(F.transform("x", lambda r: r["v"]), F.array().cast("array<double>")), rate, start=F.coalesce("weight", F.lit(0.0))).alias("weight"),
            F.coalesce(F.get("x", F.size("x") - 1)["r"], F.col("last_run")).alias("last_run"),
        )
        both.write.mode("overwrite").parquet(f"{out}/{batch_id}")
        if batch_id not in versions:
            versions.append(batch_id)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", fresh_path(spark, f"{label}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return before(1 << 62)
