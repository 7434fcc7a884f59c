"""Steps are computed once a row, and sums don't depend on the order of rows."""

import os
from decimal import Decimal
from itertools import permutations, product

from pyspark.sql import functions as F

from tallyloom.functions.scalars import exact_sum, strict_number
from tallyloom.operators import classify, evidence, filings, rows
from tallyloom.plans import evidence as plans


def _copies(spark, column, what):
    """How often a function stands in the plan of a column over a text."""
    plan = spark.createDataFrame([("x",)], "text string").select(column.alias("c"))
    return plan._jdf.queryExecution().analyzed().toString().count(what)


def _low():
    """Three amounts whose sum is a half, and which add up to less in this order."""
    cents = [10.1, 20.3, 33.7, 41.9, 57.1, 63.3, 71.7, 88.9, 12.6, 95.2]
    for a, b in product(cents, repeat=2):
        c = float(Decimal("1000.5") - Decimal(str(a)) - Decimal(str(b)))
        for p in permutations((a, b, c)):
            if (p[0] + p[1]) + p[2] < 1000.5:
                return p
    raise AssertionError("no such amounts")


def test_numbers_are_read_in_few_steps(spark):
    assert _copies(spark, strict_number(F.col("text")), "regexp_replace") <= 6
    assert _copies(spark, rows.header_year(F.col("text")), "regexp_replace") <= 20


def test_periods_are_read_in_few_steps(spark):
    assert _copies(spark, filings.period_of(F.col("text"), True), "regexp_extract") <= 4
    text = "annual accounting period beginning 1-2-2020, and ending 3-4-2021"
    got = spark.createDataFrame([(text,)], "text string").select(filings.period_of(F.col("text"), True).alias("p")).first().p
    assert (got.begin, got.end) == ("01/02/2020", "03/04/2021")


def test_printed_rows_are_put_in_order_once(spark):
    tokens = spark.createDataFrame([(1, 1, 10.0, 700.0, 5.0, 10.0, "total of"), (1, 1, 10.0, 690.0, 5.0, 10.0, "cash"), (1, 1, 90.0, 690.0, 5.0, 10.0, "7"), (2, 1, 10.0, 690.0, 5.0, 10.0, "cash")], "doc_id long, page int, x double, y double, w double, h double, text string")
    done = rows.finished_rows(tokens)
    assert sorted((r.doc_id, r.row, [c.text for c in r.cells]) for r in done.collect()) == [(1, 1, ["total of cash", "7"]), (2, 0, ["cash"])]
    assert done._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_sums_of_captions_do_not_depend_on_order(spark):
    given = spark.createDataFrame([(1, "t", "a", 2020, v) for v in _low()], "entity_id int, target string, label string, year int, value double").coalesce(1)
    assert evidence.caption_evidence(given).first().current == 1001


def test_large_and_odd_amounts_are_added_as_before(spark):
    given = spark.createDataFrame([(1, 1e35), (1, 2e35), (2, float("inf")), (3, None), (4, 0.1), (4, 0.2)], "k int, v double")
    got = {r.k: r.s for r in given.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {1: 1e35 + 2e35, 2: float("inf"), 3: None, 4: 0.3}


def test_opening_balances_do_not_depend_on_order(spark, tmp_path):
    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "orders.parquet":
            os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    spark.createDataFrame([(i, 1, "F", v) for i, v in enumerate(_low())], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").selectExpr("*", "timestamp'2020-01-01' AS o_orderdate", "'x' AS o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    lines = plans._base(spark, str(tmp_path), "lines")[0]
    assert lines.first().boy == 1000.5


def test_scopes_of_pages_are_found_once(spark):
    page = spark.createDataFrame([("form 5471", "page 1 of 2", "form 5471", ["x"])], "head string, foot string, all string, titles array<string>")
    plan = page.select(classify.page_kind(False).alias("c"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.count("companies house") == 1 and text.count("all dates") == 1
    assert plan.first().c.kind == "us-5471-face"
