"""The queries of the general training-data problems (1: instants, 4: changes between snapshots) on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.timestamps import normalise
from tidemill.operators import snapshot_diff
from tidemill.session import fresh_path, table, written

#: (table, field, row key, zone column, source column)
INSTANT_FIELDS = (
    ("candidates", "last_seen", "cand_no", "site_tz", "board"),
    ("candidates", "search_published_at", "cand_no", "site_tz", "board"),
    ("ashby_postings", "publishedAt", "posting_no", "board_tz", "board"),
    ("greenhouse_postings", "updated_at", "id", "board_tz", "board"),
)
COMPARED = ("title", "company", "board", "tier", "score", "last_seen", "verification_age_days")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, field, key, zone, source in INSTANT_FIELDS:
        part = table(spark, sf_dir, name).where(F.col(field).isNotNull()).select(
            F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_key"), F.col(field).alias("value"), F.col(zone).alias("zone"), F.concat_ws("|", F.lit(field), source).alias("source")
        )
        rows = part if rows is None else rows.unionByName(part)
    return normalise(rows, "value", "zone", "source").select("field", "row_key", "utc_us", "time_status")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).where("utc_us IS NOT NULL").select("field", "row_key", "utc_us").distinct()


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of each field were read."""
    return _instants(spark, sf_dir).groupBy("field", "time_status").agg(F.count("*").alias("n_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.diff_all(table(spark, sf_dir, "feed_snapshots"), "snapshot_no", "id", COMPARED)


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each delivery, how many ids changed in each column."""
    df, out = table(spark, sf_dir, "feed_snapshots"), []
    index = snapshot_diff.SnapshotIndex(spark, fresh_path(spark, "snapshots"), "id", COMPARED)
    for n in snapshot_diff.deliveries(df, "snapshot_no"):
        index.apply(df.where(F.col("snapshot_no") == n))
        # counted now: a later delivery takes the place of the values
        counts = written(index.fetch().groupBy("column_name").agg(F.count("*").alias("n_ids")), "changed-values")
        out.append(counts.select(F.lit(n).cast("bigint").alias("snapshot_no"), "column_name", "n_ids"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "snapshot_no bigint, column_name string, n_ids bigint")


QUERIES = {"p1_found": p1_found, "p1_status": p1_status, "p4_found": p4_found, "p4_values": p4_values}

_STEPS = """
WITH n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before
           FROM (SELECT DISTINCT snapshot_no FROM feed_snapshots WHERE snapshot_no IS NOT NULL)),
r AS (SELECT DISTINCT snapshot_no, id, title, company, board, tier, score, last_seen, verification_age_days
      FROM feed_snapshots WHERE id IS NOT NULL),
new AS (SELECT n.snapshot_no, r.* EXCLUDE (snapshot_no) FROM n JOIN r ON r.snapshot_no = n.snapshot_no WHERE n.before IS NOT NULL),
old AS (SELECT n.snapshot_no, r.* EXCLUDE (snapshot_no) FROM n JOIN r ON r.snapshot_no = n.before)
"""

SQL = {
    "p4_found": _STEPS
    + """SELECT coalesce(new.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(new.id, old.id) AS id,
  CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new FULL OUTER JOIN old ON new.snapshot_no = old.snapshot_no AND new.id = old.id
WHERE old.id IS NULL OR new.id IS NULL OR new.title IS DISTINCT FROM old.title OR new.company IS DISTINCT FROM old.company
  OR new.board IS DISTINCT FROM old.board OR new.tier IS DISTINCT FROM old.tier OR new.score IS DISTINCT FROM old.score
  OR new.last_seen IS DISTINCT FROM old.last_seen OR new.verification_age_days IS DISTINCT FROM old.verification_age_days""",
    "p4_values": _STEPS
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT new.snapshot_no, '{c}' AS column_name, count(*) AS n_ids FROM new JOIN old ON new.snapshot_no = old.snapshot_no"
        f" AND new.id = old.id WHERE new.{c} IS DISTINCT FROM old.{c} GROUP BY ALL"
        for c in COMPARED
    )
    + ")",
}
