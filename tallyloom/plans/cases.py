"""Queries of the operators over cases, with their DuckDB SQL; see layout_books for the manner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import cases
from tallyloom.session import table

_NAMES = "concat(replace(n_name, '_', ' '), CASE WHEN n_nationkey % 3 = 0 THEN ' Holdings Pty Ltd' WHEN n_nationkey % 3 = 1 THEN ' Group Limited' ELSE ' The and Inc' END)"
_BASE = {
    "cells": "SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN concat('(', CAST(CAST(l_quantity * 7 AS INT) AS VARCHAR(12)), ')') WHEN 1 THEN concat('Item ', CAST(l_partkey AS VARCHAR(12))) ELSE concat('A ', CAST(l_partkey AS VARCHAR(12)), '.5') END AS text FROM lineitem",
    "docs": "SELECT o_custkey AS entity_id, CASE o_orderstatus WHEN 'F' THEN 'cfc-financial-statements' WHEN 'O' THEN 'cfc-tax-return' ELSE 'trial-balance' END AS kind, CASE WHEN o_totalprice > 5000 THEN CAST(year(o_orderdate) AS INT) END AS year, o_orderpriority LIKE '1%' AS duplicate FROM orders",
    "pages": "SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'cfc-financial-statements' WHEN 'N' THEN 'prior-year-us-return' ELSE 'trial-balance' END AS kind, CASE l_partkey % 6 WHEN 0 THEN 'fs-pnl' WHEN 1 THEN 'fs-balance-sheet' WHEN 2 THEN 'us-5471-e' WHEN 3 THEN 'fs-cover' WHEN 4 THEN 'ato-return' ELSE 'us-1120' END AS page_kind, l_linenumber > 5 AS duplicate FROM lineitem",
    "captions": "SELECT c_custkey AS entity_id, concat(CASE c_custkey % 4 WHEN 0 THEN 'Loan to ' WHEN 1 THEN 'Payable, ' WHEN 2 THEN 'Balance with ' ELSE 'Due from X' END, replace(n_name, '_', ' ')) AS label, CASE WHEN c_custkey % 5 = 0 THEN 'is' ELSE 'bs' END AS feed, CASE WHEN c_custkey % 7 = 0 THEN 'kept' END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "names": f"SELECT c_custkey AS entity_id, {_NAMES} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "papers": "SELECT c_custkey AS id, c_name AS entity_name FROM customer",
    "documents": "SELECT o_custkey AS workpaper_id FROM orders",
    "tasks": "SELECT o_orderkey AS task_id, upper(c_name) AS entity_name, CASE WHEN o_orderstatus = 'P' THEN CAST(-1 AS BIGINT) END AS workpaper_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "equity": "SELECT c_custkey AS entity_id, c_acctbal AS opening, CASE WHEN c_nationkey > 4 THEN 100.25 END AS profit, CASE WHEN c_nationkey > 9 THEN 7.5 END AS dividends, CASE WHEN c_nationkey > 20 THEN 1.0 END AS closing FROM customer",
    "bound": "SELECT user_id AS entity_id, event_type AS label FROM events WHERE value > 20",
    "unmatched": "SELECT user_id AS entity_id, concat(event_type, '?') AS label FROM events WHERE value <= 20",
    "translated": "SELECT user_id AS entity_id, event_type AS label FROM events WHERE value > 60",
    "derived": "SELECT user_id AS entity_id, event_id AS id, event_type AS level FROM events WHERE value > 10",
    "stored": "SELECT user_id AS entity_id, event_id AS id, 'old' AS level, CASE WHEN event_id % 2 = 0 THEN 'check' ELSE 'typed' END AS origin, event_id % 3 = 0 AS dismissed FROM events WHERE value < 30",
    "lines": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS target, p_name AS label, l_linestatus AS schedule, l_quantity > 20 AS multi, l_discount > 0.05 AS edited FROM lineitem JOIN part ON l_partkey = p_partkey",
    "holders": "SELECT o_custkey AS entity_id, o_orderpriority AS name, o_totalprice AS shares, o_orderkey AS ord FROM orders",
    "currencies": "SELECT CAST(n_nationkey AS VARCHAR(4)) AS code, concat(n_name, ' dollar') AS name, n_name AS country FROM nation",
    "asked": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR(4)) WHEN 1 THEN concat(' ', n_name, '  Dollar') ELSE lower(n_name) END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
_TABLES = ("nation", "customer", "orders", "lineitem", "part", "events")


def _base(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    for x in _TABLES:
        table(spark, sf_dir, x).createOrReplaceTempView(x)
    return [spark.sql(_BASE[n]) for n in names]


def value_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return cases.value_fingerprint(*_base(spark, d, "cells"))


def derive_case_years(spark: SparkSession, d: str) -> DataFrame:
    return cases.derive_case_years(*_base(spark, d, "docs")).withColumn("dissent", F.array_join("dissent", ","))


def resolve_feeds(spark: SparkSession, d: str) -> DataFrame:
    pages = _base(spark, d, "pages")[0]
    return pages.select("doc_id", "page", "l_partkey", "l_suppkey", F.array_join(cases.feeds_of(F.col("kind"), F.col("page_kind"), F.col("duplicate")), ",").alias("feeds"))


def pages_for_feed(spark: SparkSession, d: str) -> DataFrame:
    return cases.pages_for_feed(_base(spark, d, "pages")[0], "profile").select("doc_id", "page", "l_partkey", "l_suppkey")


def entity_similarity(spark: SparkSession, d: str) -> DataFrame:
    names = _base(spark, d, "names")[0]
    other = F.when(F.col("entity_id") % 2 == 0, F.upper("name")).otherwise(F.substring_index("name", " ", 1))
    return names.select("entity_id", cases.entity_similarity(F.col("name"), F.concat(F.lit("UNITED "), other)).alias("similarity"))


def route_related_party(spark: SparkSession, d: str) -> DataFrame:
    return cases.route_related_party(*_base(spark, d, "captions", "names")).select("entity_id", "label", "feed", "target")


def list_workpapers(spark: SparkSession, d: str) -> DataFrame:
    return cases.list_workpapers(*_base(spark, d, "papers", "documents"))


def link_tasks(spark: SparkSession, d: str) -> DataFrame:
    return cases.link_tasks(*_base(spark, d, "tasks", "papers"))


def filter_events(spark: SparkSession, d: str) -> DataFrame:
    return cases.filter_events(table(spark, d, "events"), kind="purchase").select("event_id", "user_id")


def equity_rollforward(spark: SparkSession, d: str) -> DataFrame:
    return cases.equity_rollforward(_base(spark, d, "equity")[0].selectExpr("entity_id", "opening", "double(profit) AS profit", "double(dividends) AS dividends", "double(closing) AS closing"))


def labels_to_translate(spark: SparkSession, d: str) -> DataFrame:
    return cases.labels_to_translate(*_base(spark, d, "bound", "unmatched", "translated"))


def all_review_items(spark: SparkSession, d: str) -> DataFrame:
    return cases.all_review_items(*_base(spark, d, "derived", "stored"))


def filter_lines(spark: SparkSession, d: str) -> DataFrame:
    return cases.filter_lines(_base(spark, d, "lines")[0], text="RING", schedule="O", multi=True, edited=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label")


def top_shareholders(spark: SparkSession, d: str) -> DataFrame:
    return cases.top_shareholders(*_base(spark, d, "holders"))


def currency_lookup(spark: SparkSession, d: str) -> DataFrame:
    return cases.currency_lookup(*_base(spark, d, "asked", "currencies"))


_QUERIES = (
    value_fingerprint, derive_case_years, resolve_feeds, pages_for_feed, entity_similarity, route_related_party, list_workpapers, link_tasks, filter_events, equity_rollforward, labels_to_translate,
    all_review_items, filter_lines, top_shareholders, currency_lookup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    b = {k: f"({v})" for k, v in _BASE.items()}
    feeds = "CASE WHEN duplicate THEN 'none' WHEN kind = 'trial-balance' THEN 'generic-is,generic-bs,profile' WHEN kind = 'prior-year-us-return' THEN CASE WHEN page_kind = 'us-5471-e' THEN 'carry-forward' ELSE 'none' END WHEN page_kind = 'fs-pnl' THEN 'generic-is,profile' WHEN page_kind = 'fs-balance-sheet' THEN 'generic-bs,profile' WHEN page_kind = 'fs-cover' THEN 'profile' WHEN page_kind = 'ato-return' THEN 'targeted-ato' ELSE 'none' END"
    return {
        "value_fingerprint": "SELECT DISTINCT l_orderkey AS doc_id, CAST(CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity * 7 AS INT) ELSE l_partkey + 1 END AS BIGINT) AS value FROM lineitem WHERE l_linenumber % 3 <> 1 AND CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity * 7 AS INT) ELSE l_partkey + 0.5 END >= 100",
        "derive_case_years": f"WITH v AS (SELECT DISTINCT entity_id, year FROM {b['docs']} WHERE kind <> 'trial-balance' AND NOT duplicate AND year IS NOT NULL), m AS (SELECT entity_id, max(year) AS cy FROM v GROUP BY 1) SELECT m.entity_id, cy, cy - 1 AS py, coalesce(string_agg(CAST(year AS VARCHAR), ',' ORDER BY year DESC) FILTER (WHERE year < cy), '') AS dissent FROM m JOIN v USING (entity_id) GROUP BY 1, 2",
        "resolve_feeds": f"SELECT doc_id, page, l_partkey, l_suppkey, {feeds} AS feeds FROM {b['pages']}",
        "pages_for_feed": f"SELECT doc_id, page, l_partkey, l_suppkey FROM {b['pages']} WHERE contains({feeds}, 'profile')",
        "entity_similarity": "SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS similarity FROM customer",
        "route_related_party": f"SELECT entity_id, label, feed, CASE WHEN target IS NOT NULL OR feed <> 'bs' THEN target WHEN NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(lower(replace(n_name, '_', ' ')), ' ')) AS w FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey = entity_id) WHERE length(w) >= 4 AND list_contains(regexp_extract_all(lower(label), '[a-z0-9_]+'), w)) THEN NULL WHEN label LIKE 'Loan to%' OR label LIKE 'Due from%' THEN 'loan-asset' WHEN label LIKE 'Payable%' THEN 'loan-liability' END AS target FROM {b['captions']}",
        "list_workpapers": "SELECT c_custkey AS id, c_name AS entity_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS documents FROM customer",
        "link_tasks": "SELECT o_orderkey AS task_id, upper(c_name) AS entity_name, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE (SELECT min(x.c_custkey) FROM customer x WHERE lower(x.c_name) = lower(c.c_name)) END AS workpaper_id FROM orders JOIN customer c ON o_custkey = c.c_custkey",
        "filter_events": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
        "equity_rollforward": f"SELECT entity_id, opening, profit, dividends, coalesce(closing, round(opening + coalesce(profit, 0) - coalesce(dividends, 0), 2)) AS closing FROM {b['equity']}",
        "labels_to_translate": f"SELECT entity_id, label FROM {b['bound']} UNION SELECT entity_id, label FROM {b['unmatched']} EXCEPT SELECT entity_id, label FROM {b['translated']}",
        "all_review_items": f"SELECT d.entity_id, d.id, d.level, coalesce(s.dismissed, false) AS dismissed FROM {b['derived']} d LEFT JOIN {b['stored']} s USING (entity_id, id) UNION ALL SELECT entity_id, id, level, dismissed FROM {b['stored']} WHERE origin <> 'check' AND id NOT IN (SELECT id FROM {b['derived']})",
        "filter_lines": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label FROM {b['lines']} WHERE (target ILIKE '%ring%' OR label ILIKE '%ring%') AND schedule = 'O' AND multi AND edited",
        "top_shareholders": f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ord) AS n FROM {b['holders']}) SELECT e.entity_id, CAST(s + 18 AS INT) AS slot, coalesce(h.name, '') AS name, h.shares FROM (SELECT DISTINCT entity_id FROM h) e CROSS JOIN range(1, 9) r(s) LEFT JOIN h ON h.entity_id = e.entity_id AND h.n = s",
        "currency_lookup": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN ' ' || n_name || '  Dollar' ELSE lower(n_name) END AS text, CAST(c_nationkey AS VARCHAR) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey",
    }
