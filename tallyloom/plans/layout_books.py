"""Queries of layout, books, streaming and scalar operators over the given tables, with their DuckDB SQL.

Each entry of ``_BASE`` is SQL over the tables that both engines read alike; it prepares an operator's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import books, layout
from tallyloom.session import fresh_path, table
from tallyloom.streaming import live

_BASE = {
    "tokens": """SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_returnflag AS text, l_discount * 20 AS x, l_tax * 10 AS y,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem""",
    "rows": "SELECT o_custkey % 10 AS doc_id, CAST(floor(o_custkey / 10) AS BIGINT) AS page, o_orderkey AS row_id, o_totalprice AS y FROM orders WHERE o_orderstatus <> 'P'",
    "rulers": "SELECT o_custkey % 10 AS doc_id, CAST(floor(o_custkey / 10) AS BIGINT) AS page, o_totalprice AS y FROM orders WHERE o_orderstatus = 'P'",
    "ruled": "SELECT l_suppkey AS doc_id, CAST(floor(l_partkey / 50) AS BIGINT) AS page, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS has_ruler FROM lineitem GROUP BY 1, 2",
    "kinds": "SELECT l_orderkey AS doc_id, l_linenumber AS page, max(CASE l_returnflag WHEN 'N' THEN 'a' WHEN 'A' THEN 'balance' ELSE 'cover' END) AS k FROM lineitem GROUP BY 1, 2",
    "seen": "SELECT user_id, event_type, event_id FROM events",
    "pool": "SELECT user_id AS entity_id, event_type AS caption, event_id AS ord, value FROM events",
    "captions": "SELECT l_suppkey AS entity_id, p_name AS caption FROM lineitem JOIN part ON l_partkey = p_partkey",
    "dividends": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders",
    "asked": "SELECT n_name AS code, CAST(y AS INT) AS year FROM nation, (VALUES (1993),(1995),(1997),(2002)) t(y)",
    "table_rates": "SELECT n_name AS code, CAST(y AS INT) AS year, CAST(1 + n_nationkey AS DOUBLE) AS rate FROM nation, (VALUES (1995),(1997)) t(y) WHERE (n_nationkey + y) % 3 <> 0",
    "daily_rates": "SELECT n_name AS code, CAST(year(o_orderdate) AS INT) AS year, round(max(o_totalprice) / 1000, 4) AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "manual_rates": "SELECT n_name AS code, 2002 AS year, CAST(n_nationkey AS DOUBLE) AS rate FROM nation",
    "edits": "SELECT n_name AS code, 'spot' AS kind, CAST(y AS INT) AS year, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN -1.0E0 ELSE 9.5E0 END AS rate FROM nation, (VALUES (1995),(1996)) t(y)",
    "ledger": "SELECT o_custkey AS entity_id, o_totalprice AS source, CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'cash paid' ELSE 'credit note' END AS details FROM orders",
    "booked": "SELECT o_custkey AS entity_id, round(sum(o_totalprice), 2) AS booked FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "papers": "SELECT o_orderkey, o_custkey FROM orders",
    "deleted": "SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal < 0",
    "files": "SELECT doc_id, concat(source, '.', lang) AS name, n_chars AS bytes FROM documents",
    "known_rules": "SELECT lower(n_name) AS kw, 'nation' AS target FROM nation",
    "assigned": "SELECT c_mktsegment AS kw, 'segment' AS target FROM customer UNION ALL SELECT n_name, 'again' FROM nation UNION ALL SELECT r_name, 'region' FROM region",
    "clients": "SELECT c_custkey AS entity_id, c_mktsegment AS portfolio FROM customer",
    "client_docs": "SELECT o_custkey AS entity_id, o_orderstatus = 'O' AS open FROM orders",
    "facts": "SELECT c_custkey AS entity_id, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment FROM customer",
}
_RATES = "SELECT n_name AS code, 'spot' AS kind, CAST(y AS INT) AS year, CAST(1 + n_nationkey AS DOUBLE) AS rate FROM nation, (VALUES (1995),(1997)) t(y)"
_CHECKS = {"overdrawn": "balance < 0", "no segment": "segment IS NULL OR segment = 'MACHINERY'", "far": "nation > 20 AND balance < 500"}
_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents")


def _base(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    for x in _TABLES:
        table(spark, sf_dir, x).createOrReplaceTempView(x)
    return [spark.sql(_BASE[n] if n in _BASE else _RATES) for n in names]


def dedupe_overprint(spark: SparkSession, d: str) -> DataFrame:
    return layout.dedupe_overprint(*_base(spark, d, "tokens")).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


def select_ruler(spark: SparkSession, d: str) -> DataFrame:
    rows, rulers = _base(spark, d, "rows", "rulers")
    has = rulers.select("doc_id", "page").distinct().withColumn("has_ruler", F.lit(True))
    pages = rows.select("doc_id", "page").union(rulers.select("doc_id", "page")).distinct().join(has, ["doc_id", "page"], "left").withColumn("has_ruler", F.coalesce("has_ruler", F.lit(False)))
    return layout.select_ruler(rows, rulers, layout.inherit_rulers(pages))


def inherit_rulers(spark: SparkSession, d: str) -> DataFrame:
    return layout.inherit_rulers(*_base(spark, d, "ruled")).select("doc_id", "page", "ruler_page")


def inherit_kinds(spark: SparkSession, d: str) -> DataFrame:
    pages = _base(spark, d, "kinds")[0].select("doc_id", "page", F.when(F.col("k") == "a", "unknown").otherwise(F.col("k")).alias("kind"))
    return layout.inherit_kinds(pages, ["balance"])


def mode_first(spark: SparkSession, d: str) -> DataFrame:
    return layout.mode_first(*_base(spark, d, "seen"), "user_id", "event_type", "event_id")


def allocate_pool(spark: SparkSession, d: str) -> DataFrame:
    return layout.allocate_pool(*_base(spark, d, "pool"), 3)


def batch_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return layout.batch_suggestions(*_base(spark, d, "captions")).groupBy("entity_id", "batch").agg(F.count("*").alias("n"), F.min("caption").alias("first_caption"))


def first_dividends(spark: SparkSession, d: str) -> DataFrame:
    return layout.numbered_slots(*_base(spark, d, "dividends"), "o_custkey", ["o_orderdate", "o_orderkey"], 3, 4).select("o_custkey", "o_orderkey", "slot")


def rate_chain(spark: SparkSession, d: str) -> DataFrame:
    asked, t, daily, manual = _base(spark, d, "asked", "table_rates", "daily_rates", "manual_rates")
    return books.rate_chain(asked, [("table", t), ("daily", daily), ("manual", manual)])


def set_fx_overrides(spark: SparkSession, d: str) -> DataFrame:
    return books.set_fx_overrides(*_base(spark, d, "rates", "edits"))


def cash_paid_total(spark: SparkSession, d: str) -> DataFrame:
    return books.cash_paid_total(*_base(spark, d, "ledger"))


def ledger_tie_out(spark: SparkSession, d: str) -> DataFrame:
    return books.ledger_tie_out(*_base(spark, d, "ledger", "booked"))


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    return books.delete_cascade(*_base(spark, d, "papers", "deleted"), "o_custkey").select("o_orderkey", "o_custkey")


def delete_set_null(spark: SparkSession, d: str) -> DataFrame:
    return books.delete_set_null(*_base(spark, d, "papers", "deleted"), "o_custkey").select("o_orderkey", "o_custkey")


def filter_supported(spark: SparkSession, d: str) -> DataFrame:
    return books.filter_supported(*_base(spark, d, "files"), ["en", "de"], 5000).select("doc_id", "status")


def learn_rules(spark: SparkSession, d: str) -> DataFrame:
    return books.learn_rules(*_base(spark, d, "known_rules", "assigned"))


def portfolio_rollup(spark: SparkSession, d: str) -> DataFrame:
    return books.portfolio_rollup(*_base(spark, d, "clients", "client_docs"))


def paginate(spark: SparkSession, d: str) -> DataFrame:
    return books.paginate(*_base(spark, d, "seen"), [F.col("event_id").desc()], 3, 50)


def validate_entities(spark: SparkSession, d: str) -> DataFrame:
    return books.validate_entities(*_base(spark, d, "facts"), _CHECKS)


def period_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    swapped = F.when(F.dayofmonth("day") > 12, F.date_format("day", "d-M-yyyy")).otherwise(F.date_format("day", "M/d/yyyy"))
    serial = F.datediff("day", F.lit("1899-12-30").cast("date")) + F.lit(0.25)
    resolved = F.date_sub("day", (F.col("o_orderkey") % 2).cast("int"))
    return o.select("o_orderkey", S.to_iso_date(swapped).alias("from_text"), S.serial_to_date(serial).alias("from_serial"), S.as_of_label(F.col("day"), resolved).alias("label"))


def is_mostly_non_latin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.is_mostly_non_latin(F.col("text")).alias("other_script"))


def column_numbers(spark: SparkSession, d: str) -> DataFrame:
    word = F.substring_index("p_name", " ", -1)
    return table(spark, d, "part").select("p_partkey", S.column_number(word).alias("col"))


def ingest_audit_events(spark: SparkSession, d: str) -> DataFrame:
    """The events are delivered twice into one table, which has each of them once."""
    sink = fresh_path(spark, "audit")
    for _ in range(2):
        live.deliver(live.ingest(live.read(spark, f"{d}/events.parquet")), sink, ["user_id", "event_id"])
    return spark.read.parquet(sink).select("event_id", "event_type", "props")


def advance_tasks(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.advance_tasks(live.read(spark, f"{d}/events.parquet")), "tasks", "complete")


def provider_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    daily = live.drain(live.usage_daily(live.read(spark, f"{d}/events.parquet")), "usage", "complete")
    return daily.withColumn("day", F.col("day").cast("date"))


def audit_counts_live(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.counts_live(live.read(spark, f"{d}/events.parquet")), "counts", "complete")


_QUERIES = (
    dedupe_overprint, select_ruler, inherit_rulers, inherit_kinds, mode_first, allocate_pool, batch_suggestions, first_dividends, rate_chain, set_fx_overrides,
    cash_paid_total, ledger_tie_out, delete_cascade, delete_set_null, filter_supported, learn_rules, portfolio_rollup, paginate, validate_entities, period_dates,
    is_mostly_non_latin, column_numbers, ingest_audit_events, advance_tasks, provider_usage_daily, audit_counts_live,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    b = {k: f"({v})" for k, v in _BASE.items()}
    checks = " UNION ALL ".join(f"SELECT entity_id, '{n}' AS \"check\" FROM {b['facts']} WHERE {c}" for n, c in _CHECKS.items())
    return {
        "dedupe_overprint": f"SELECT doc_id, page, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords FROM (SELECT doc_id, page, text, min(ord) AS ord FROM {b['tokens']} GROUP BY 1, 2, 3, floor(x * 2 + 0.5), floor(y * 2 + 0.5)) GROUP BY 1, 2",
        "select_ruler": f"WITH r AS ({_BASE['rows']}), u AS ({_BASE['rulers']}), o AS (SELECT r.*, (SELECT min(u.y) FROM u WHERE u.doc_id = r.doc_id AND u.page = r.page AND u.y > r.y) AS own, (SELECT max(u.page) FROM u WHERE u.doc_id = r.doc_id AND u.page <= r.page) AS src FROM r) SELECT doc_id, page, row_id, y, CASE WHEN own IS NOT NULL THEN page WHEN src < page AND page - src <= 3 THEN src END AS ruler_page, CASE WHEN own IS NOT NULL THEN own WHEN src < page AND page - src <= 3 THEN (SELECT min(u.y) FROM u WHERE u.doc_id = o.doc_id AND u.page = o.src) END AS ruler_y FROM o",
        "inherit_rulers": f"SELECT doc_id, page, CASE WHEN page - r <= 3 THEN r END AS ruler_page FROM (SELECT doc_id, page, max(CASE WHEN has_ruler THEN page END) OVER (PARTITION BY doc_id ORDER BY page) AS r FROM {b['ruled']})",
        "inherit_kinds": f"SELECT doc_id, page, CASE WHEN k <> 'a' THEN k WHEN l = 'balance' THEN l ELSE 'unknown' END AS kind FROM (SELECT *, last_value(CASE WHEN k <> 'a' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS l FROM {b['kinds']})",
        "mode_first": f"SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM {b['seen']} GROUP BY 1, 2) WHERE k = 1",
        "allocate_pool": f"SELECT entity_id, slot, CASE WHEN count(*) = 1 THEN min(caption) ELSE 'Other (' || CAST(sum(k) AS VARCHAR) || ' items)' END AS label, round(sum(v), 2) AS value FROM (SELECT entity_id, caption, count(*) AS k, sum(value) AS v, CAST(least(row_number() OVER (PARTITION BY entity_id ORDER BY min(ord)), 3) AS INT) AS slot FROM {b['pool']} GROUP BY 1, 2) GROUP BY 1, 2",
        "batch_suggestions": f"SELECT entity_id, batch, count(*) AS n, min(caption) AS first_caption FROM (SELECT entity_id, caption, (row_number() OVER (PARTITION BY entity_id ORDER BY caption) - 1) // 40 AS batch FROM (SELECT DISTINCT * FROM {b['captions']})) GROUP BY 1, 2",
        "first_dividends": f"SELECT o_custkey, o_orderkey, CAST(n + 2 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM {b['dividends']}) WHERE n <= 4",
        "rate_chain": f"SELECT a.code, a.year, CASE WHEN t.rate > 0 THEN t.rate WHEN d.rate > 0 THEN d.rate WHEN m.rate > 0 THEN m.rate END AS rate, CASE WHEN t.rate > 0 THEN 'table' WHEN d.rate > 0 THEN 'daily' WHEN m.rate > 0 THEN 'manual' END AS source FROM {b['asked']} a LEFT JOIN {b['table_rates']} t USING (code, year) LEFT JOIN {b['daily_rates']} d USING (code, year) LEFT JOIN {b['manual_rates']} m USING (code, year)",
        "set_fx_overrides": f"SELECT * FROM (SELECT * FROM ({_RATES}) r WHERE NOT EXISTS (SELECT 1 FROM {b['edits']} e WHERE e.code = r.code AND e.year = r.year) UNION ALL SELECT code, kind, year, CAST(rate AS DOUBLE) FROM {b['edits']} WHERE rate > 0)",
        "cash_paid_total": f"SELECT entity_id, count(*) AS n, round(sum(source), 2) AS total FROM {b['ledger']} WHERE details = 'cash paid' GROUP BY 1",
        "ledger_tie_out": f"SELECT entity_id, coalesce(l, 0) AS ledger, coalesce(booked, 0) AS booked, abs(coalesce(l, 0) - coalesce(booked, 0)) <= 2 AS ties FROM (SELECT entity_id, round(sum(source), 2) AS l FROM {b['ledger']} WHERE details <> 'cash paid' GROUP BY 1) FULL JOIN {b['booked']} USING (entity_id)",
        "delete_cascade": f"SELECT * FROM {b['papers']} WHERE o_custkey NOT IN (SELECT o_custkey FROM {b['deleted']})",
        "delete_set_null": f"SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT o_custkey FROM {b['deleted']}) THEN o_custkey END AS o_custkey FROM {b['papers']}",
        "filter_supported": f"SELECT doc_id, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de') THEN 'unsupported' WHEN n_chars > 5000 THEN 'too large' ELSE 'accepted' END AS status FROM documents",
        "learn_rules": f"SELECT * FROM {b['known_rules']} UNION ALL SELECT kw, min(target) FROM (SELECT trim(regexp_replace(lower(kw), '\\s+', ' ', 'g')) AS kw, target FROM {b['assigned']}) WHERE length(kw) >= 3 AND kw NOT IN (SELECT lower(n_name) FROM nation) GROUP BY 1",
        "portfolio_rollup": f"SELECT portfolio, count(DISTINCT c.entity_id) AS entities, count(o.entity_id) AS documents, count(*) FILTER (WHERE o.open) AS open FROM {b['clients']} c LEFT JOIN {b['client_docs']} o ON c.entity_id = o.entity_id GROUP BY ROLLUP (portfolio)",
        "paginate": "SELECT user_id, event_type, event_id, 3 AS page, CAST((SELECT ceil(count(*) / 50) FROM events) AS INT) AS pages FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100",
        "validate_entities": checks,
        "period_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_text, CAST(o_orderdate AS DATE) AS from_serial, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || ' (requested ' || strftime(o_orderdate, '%Y-%m-%d') || ')' END AS label FROM orders",
        "is_mostly_non_latin": r"SELECT doc_id, coalesce(2 * length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '\p{Latin}', '', 'g')) > length(regexp_replace(text, '[^\p{L}]', '', 'g')), false) AS other_script FROM documents",
        "column_numbers": "SELECT p_partkey, CASE WHEN regexp_matches(s, '^[a-z]{1,3}$') THEN CAST(list_reduce(list_prepend(0, list_transform(string_split(s, ''), lambda c: ascii(c) - 96)), lambda a, x: a * 26 + x) AS INT) END AS col FROM (SELECT p_partkey, string_split(p_name, ' ')[-1] AS s FROM part)",
        "ingest_audit_events": "SELECT event_id, event_type, substr(props, 1, 2000) AS props FROM events",
        "advance_tasks": "SELECT user_id, CASE max(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) WHEN 0 THEN 'pending' WHEN 1 THEN 'in progress' ELSE 'completed' END AS status FROM events GROUP BY 1",
        "provider_usage_daily": "SELECT CAST(ts AS DATE) AS day, count(*) AS requests, round(sum(value), 2) AS units, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY 1",
        "audit_counts_live": "SELECT user_id, count(*) AS n_events FROM events GROUP BY 1",
    }
