"""Queries take the whole of their inputs."""

import datetime
import os

import pytest

from tallyloom.plans import evidence, registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with the given tables; the others are those of the smallest size."""

    def make(**tables):
        for name in os.listdir(SMALL):
            if name.removesuffix(".parquet") not in tables:
                os.symlink(f"{SMALL}/{name}", tmp_path / name)
        for name, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return make


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_policies_match_after_40_characters(spark, folder):
    """Policies decide by id, else category, else the whole message."""
    far = "x" * 5000
    docs = documents(spark, [(1, f"{far} les choses", "es"), (2, f"{far} The end", "es"), (3, far, "fr"), (4, far, "de"), (5, far, "es"), (17, far, "de")])
    labels = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3, 4, 5, 17)], "doc_id bigint, quality int, toxic int")
    got = registry.first_policy(spark, folder(documents=docs, labels=labels)).collect()
    assert sorted((r.id, r.level, r.action) for r in got if r.action) == [(1, "warn", "warn"), (2, "block", "keep"), (3, "info", "info"), (17, "block", "block")]
    assert [(r.id, r.level) for r in got if not r.action] == [(5, "block")]


def test_whole_texts_are_masked(spark, folder):
    far = "ab " * 1000
    docs = documents(spark, [(7, f"{far}111-22-3333, {far}444-55-6666", "en"), (8, "  A-b " + "c" * 100, "en")])
    got = {r.doc_id: (r.masked, r.name) for r in registry.mask_tax_id(spark, folder(documents=docs)).collect()}
    assert got[7] == (f"{far}***-**-3333, {far}***-**-6666 id ***-**-0007 end", ("ab_" * 20))
    assert got[8] == ("  A-b " + "c" * 100 + " id ***-**-0008 end", "A_b_" + "c" * 56)


def test_rates_of_all_days(spark, folder):
    """91 orders on the first days of 1995 by a customer of nation 1: no day is left out."""
    orders = spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, timestamp(date_add(DATE'1995-01-01', int(id))) AS o_orderdate, '1' AS o_orderpriority FROM range(91)")
    customer = spark.sql("SELECT 1L AS c_custkey, 1 AS c_nationkey")
    nation = spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name")
    path = folder(orders=orders, customer=customer, nation=nation)
    first = datetime.date(1995, 1, 1)
    got = {r.d: (r.as_of, r.diff_days) for r in registry.nearest_rate(spark, path).collect()}
    asked = [first + datetime.timedelta(i + 2) for i in range(91)]
    last = first + datetime.timedelta(90)
    assert got == {d: (min(d, last), (min(d, last) - d).days) for d in asked}
    assert {(r.start.year, r.points) for r in registry.period_average(spark, path).collect()} == {(1994, 91), (1995, 91), (1996, 0)}


def test_every_event_is_a_fact_or_a_schedule(spark, folder):
    rows = [(1, 1), (5, 1), (2, 3), (10, 5), (4, 7), (9, 9), (15, 9)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint").selectExpr("event_id", "TIMESTAMP'2024-01-01' AS ts", "user_id", "'click' AS event_type", "1.0D AS value", "'' AS props")
    got = {r.ref: r.value for r in evidence.build_writes(spark, folder(events=events)).collect()}
    assert got == {1: "1", 3: "2", 5: "s10", 7: "4", 9: "s15"}
