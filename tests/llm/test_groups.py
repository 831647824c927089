import pytest
from pyspark.sql import functions as F

from tidemill.llm import multiset, survivor


def test_collapse(spark):
    rows = [
        (5, "json", '{"company": "Acme, Inc.", "title": "Data-Entry [x]"}'), (3, "lines", "title = data entry X\r\ncompany=\tACME INC "), (9, "json", '{\n "title":"dataentry(x)", "company":"Acme／Inc" }'),
        (1, "json", '{"company": "Acme Inc", "title": "Other"}'), (2, "json", '{"company": "Acme"'), (4, "json", '{"company": "　", "title": "t"}'), (6, "json", None), (7, "lines", ""),
        (8, "json", '{"company": null, "title": "t"}'), (10, "json", '{"company": "Straße", "title": "a"}'), (11, "json", '{"title": "A", "company": "STRASSE"}'), (11, "json", '{"title": "A", "company": "STRASSE"}'),
        (None, "json", '{"company": "Acme Inc", "title": "Other"}'), (12, "json", '{"company": "Other", "title": "Acme Inc"}'), (13, "json", '{"company": "%s", "title": "t"}' % ("L" * 100_000)),
    ]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "card_id bigint, form string, payload string, first string, copies int")
    cards = df.select("card_id", "first", "copies", *multiset.fields_of(F.col("payload"), F.col("form"), ["company", "title"]))
    got = {r["first"]: r["copies"] for r in multiset.collapse(cards, "card_id", ["company", "title"]).collect()}
    assert got == {3: 3, 1: 1, 10: 3, 12: 1, 13: 1}
    assert multiset.collapse(cards.limit(0), "card_id", ["company"]).count() == 0


def test_field_order_makes_no_difference(spark):
    a, b = F.lit("x"), F.lit("y")
    row = spark.range(1).select(*multiset.multiset_hash({"p": a, "q": b}), *[c.alias(f"g{i}") for i, c in enumerate(multiset.multiset_hash({"q": b, "p": a}))], *[c.alias(f"s{i}") for i, c in enumerate(multiset.multiset_hash({"p": b, "q": a}))]).first()
    assert row[0:2] == row[2:4] != row[4:6]


def test_latest_rows(spark):
    rows = [("f", 1, "review", "viewjob-jk", 90, 90), ("f", 2, " HIGH　", None, 10, None), ("f", 3, "high", "search_vjk", 101, 5), ("f", 4, "High", "Search-VJK", -1, 5), ("g", 5, None, None, None, None), ("g", 6, "other", "", 999, 255), (None, 7, "high", None, 1, 1), ("h", 8, "high", None, 1, 1), ("f", 3, "high", "search_vjk", 101, 5)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "fp string, n bigint, tier string, kind string, s int, a int, g string, o string")
    tiers, kinds = survivor.merged("t", [survivor.OTHER, "review", "high"]), survivor.merged("k", [survivor.OTHER, "search-vjk", "viewjob-jk"])
    ranks = [tiers.place(survivor.named(F.col("tier"), ["review", "high"])), kinds.place(survivor.named(F.col("kind"), ["search-vjk", "viewjob-jk"]))]
    rules = (ranks, [F.col("s"), F.col("a")])
    got = {r["fp"]: (r["n"], r["n_rows"]) for r in survivor.latest_rows(df, "fp", "n", *rules).collect()}
    assert got == {"f": (3, 5), "g": (5, 2), "h": (8, 1)}
    big = spark.createDataFrame([("f", -(2**63)), ("f", 2**63 - 1)], "fp string, n bigint")
    assert survivor.latest_rows(big, "fp", "n", []).first()["n"] == -(2**63)
    assert survivor.latest_rows(df.limit(0), "fp", "n", *rules).count() == 0


def test_currency(spark):
    rows = [(f"g{i}", 1, "draft") for i in range(3)] + [(f"g{i}", 2, "open") for i in range(3)] + [(f"g{i}", 3, "closed") for i in range(2)] + [("back", 1, "closed"), ("back", 2, "open")]
    rows += [("untimed", None, "open"), ("untimed", None, "draft"), ("untimed", None, None), ("timed", 5, "draft"), ("timed", None, "closed"), ("empty", 1, None), (None, 1, "open"), ("unknown", None, "zzz"), ("unknown", None, "draft")]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "grp string, at bigint, v string, i int, place string")
    learned = survivor.learn(df, "grp", "at", "v")
    assert learned.order == ["draft", "open", "closed"]
    got = {r["grp"]: (r["v"], r["v_from"]) for r in survivor.built_record(df, "grp", "at", [survivor.Field("v", F.col("v"), F.col("v"), learned)]).collect()}
    assert got["untimed"] == ("open", "precedence") and got["timed"] == ("draft", "time") and got["empty"] == (None, None)
    assert got["g0"] == ("closed", "time") and got["unknown"] == ("draft", "precedence") and None not in got
    assert survivor.learn(df.limit(0), "grp", "at", "v").order == []
    many = spark.range(200).selectExpr("'g' AS grp", "id AS at", "cast(id AS string) AS v")
    with pytest.raises(ValueError):
        survivor.learn(many, "grp", "at", "v")


def test_declared_edges_come_before_learned_ones():
    p = survivor.merged("x", ["low", "mid", "high"], [("high", "low", 9, 1), ("mid", "side", 5, 0), ("side", "high", 4, 1), ("new", "low", 1, 0), ("high", "side", 1, 0)])
    assert p.order == ["new", "low", "mid", "side", "high"]
    assert p.against == [("high", "low", 9, 1), ("high", "side", 1, 0)]


def test_learned_edges_decide_rows_without_timestamps(spark):
    rows = [(f"g{i}", 1, 1, "b") for i in range(5)] + [(f"g{i}", 2, 2, "a") for i in range(5)] + [("x", 10, None, "a"), ("x", 11, None, "b"), ("y", 12, None, "b"), ("y", 13, None, "a"), ("y", 14, None, "a")]
    df = spark.createDataFrame(rows, "g string, n bigint, at bigint, v string")
    order = survivor.learn(df, "g", "at", "v")
    got = {r["g"]: r["n"] for r in survivor.latest_rows(df, "g", "n", [order.place(F.col("v"))]).collect()}
    assert got["x"] == 10 and got["y"] == 13
    wide = survivor.built_record(df.withColumn("s", F.lit(87)), "g", "at", [survivor.Field("s", F.col("s"), F.lit("08"), order)])
    assert wide.where("g = 'x'").first()["s"] == "87"


def test_a_large_group_is_never_gathered(spark):
    df = spark.range(200_000).selectExpr("'hot' AS g", "id AS n", "CASE WHEN id % 2 = 0 THEN id END AS at", "concat('v', id % 7) AS v")
    order = survivor.learn(df, "g", "at", "v")
    assert survivor.latest_rows(df, "g", "n", [order.place(F.col("v"))]).first()["n_rows"] == 200_000
    plan = survivor.latest_rows(df, "g", "n", [order.place(F.col("v"))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_p5_found_runs_no_stage_that_changes_nothing(spark):
    """The declared order names every place, so p5_found reads no timestamps, learns nothing and starts no job of its own."""
    from tests.conftest import SMALL
    from tidemill.llm import catalog

    for declared in (catalog._TIERS, catalog._KINDS):
        against = [(x, y, 9, 0) for x in declared for y in declared if x != y]
        assert survivor.merged("x", declared, against).order == survivor.merged("x", declared).order == declared
    spark.sparkContext.setJobGroup("p5_found", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("p5_found"))
    plan = catalog.p5_found(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("p5_found")
    assert "last_seen" not in plan and "ArrowEvalPython" not in plan
    assert len(jobs) - before <= 1  # the footer of the table
