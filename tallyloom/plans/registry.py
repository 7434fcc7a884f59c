"""Registered queries of the library's own operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import fx, mapping, review
from tallyloom.session import table

_RULES = """VALUES (1,1,'ring','income:11'),(2,1,'small ring','balance:3'),(3,1,'bolt','income:12'),(4,1,'anvil','SKIP'),
(5,1,'gear','balance:4'),(5,2,'large gear','income:13'),(6,1,'rod','balance:5'),(7,1,'plate','income:14'),(8,1,'widget','balance:6'),(9,1,'gizmo','income:15'),
(10,1,'a/r (trade)','balance:7'),(11,1,'現金','balance:1'),(12,1,'coût','income:16'),(13,1,'tax.paid','income:17')"""
_CAPTIONS = """SELECT o_custkey AS entity_id, l_orderkey AS doc_id, l_linenumber AS page, l_extendedprice AS value,
 concat(p_name, CASE WHEN l_partkey % 11 = 0 THEN ' 現金2024' WHEN l_partkey % 11 = 1 THEN ', A/R (trade)' WHEN l_partkey % 11 = 2 THEN ' Coûts' WHEN l_partkey % 11 = 3 THEN ' taxxpaid' ELSE '' END) AS label,
 year(o_orderdate) AS year, CASE WHEN l_linestatus = 'O' THEN 'bs' ELSE 'is' END AS feed,
 CASE l_returnflag WHEN 'N' THEN 'amount' WHEN 'A' THEN 'boy' ELSE 'eoy' END AS field,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
_DUCK_MATCHED = rf"""WITH rules AS (SELECT * FROM ({_RULES}) r(rule_ord, kw_ord, kw, target)), captions AS ({_CAPTIONS}),
best AS (SELECT low, target FROM (SELECT low, target, row_number() OVER (PARTITION BY low ORDER BY length(kw) DESC, rule_ord, kw_ord) AS n
 FROM (SELECT DISTINCT lower(label) AS low FROM captions) JOIN rules
 ON CASE WHEN regexp_matches(kw, '[^\x00-\x{{24F}}]') THEN contains(low, kw)
  ELSE regexp_matches(low, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(kw) || CASE WHEN length(kw) >= 5 THEN '\p{{L}}{{0,3}}' ELSE '' END || '([^\p{{L}}\p{{N}}]|$)') END) WHERE n = 1),
matched AS (SELECT c.*, b.target FROM captions c LEFT JOIN best b ON lower(c.label) = b.low),
contribs AS (SELECT * FROM matched WHERE target IS NOT NULL AND target <> 'SKIP'),
lines AS (SELECT entity_id, target, round(sum(value) FILTER (WHERE field = 'amount'), 2) AS amount,
 round(sum(value) FILTER (WHERE field = 'boy'), 2) AS boy, round(sum(value) FILTER (WHERE field = 'eoy'), 2) AS eoy FROM contribs GROUP BY 1, 2)"""
_RATES = """SELECT code, kind, year, rate FROM (SELECT n_name AS code, 'avg' AS kind, CAST(year(o_orderdate) AS INT) AS year, max(o_totalprice) / 1000 AS rate
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3
 UNION ALL SELECT n_name, 'spot', CAST(year(o_orderdate) AS INT), min(o_totalprice) / 1000
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) r"""
_ENTITIES = """SELECT c_custkey AS entity_id, n_name AS code, CASE WHEN c_custkey % 7 > 0 THEN CAST(1993 + c_custkey % 10 AS INT) END AS cy,
 CASE WHEN c_custkey % 5 > 0 THEN CAST(1992 + c_custkey % 10 AS INT) END AS py FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_DAILY = """SELECT n_name AS code, CAST(o_orderdate AS DATE) AS d, max(1 + n_nationkey / 10.0 + dayofyear(o_orderdate) / 1000.0) AS rate
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
_LEDGER = """SELECT o_custkey AS entity_id, CAST(month(o_orderdate) AS BIGINT) AS reference, o_totalprice AS source,
 CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'cash paid' ELSE 'credit note' END AS details FROM orders"""
_REVIEW = """SELECT source AS entity_id, d.doc_id AS id, CASE WHEN toxic = 1 THEN 'block' WHEN quality = 0 THEN 'warn' ELSE 'info' END AS level,
 lang AS category, text AS message FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_POLICIES = """VALUES (1, '17', CAST(NULL AS STRING), CAST(NULL AS STRING), false, 'block'), (2, CAST(NULL AS STRING), 'de', 'not read', false, 'suppress'),
 (3, CAST(NULL AS STRING), CAST(NULL AS STRING), 'l[ae]s? ', true, 'warn'), (4, CAST(NULL AS STRING), CAST(NULL AS STRING), 'THE', false, 'keep'),
 (5, CAST(NULL AS STRING), 'fr', CAST(NULL AS STRING), false, 'info'), (6, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), false, 'suppress')"""
_STATE = "SELECT user_id AS id, count(*) AS version FROM events WHERE event_type = 'click' GROUP BY 1"
_UPDATES = """SELECT e.user_id AS id, e.event_id AS ord, CASE WHEN e.event_id % 3 > 0 THEN s.n + e.event_id % 5 END AS base_version
 FROM events e LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) s ON e.user_id = s.user_id WHERE event_type <> 'click'"""
_CELLS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN concat('(', g, ')') WHEN 1 THEN translate(g, ',.', '.,') WHEN 2 THEN concat(g, ' CR')
 WHEN 3 THEN concat(g, '-') WHEN 4 THEN concat('USD ', g) WHEN 5 THEN concat('€', translate(g, ',.', '.,')) WHEN 6 THEN concat('Rs. ', g) WHEN 7 THEN concat(g, ' DR /')
 WHEN 8 THEN concat('A$ -', replace(g, ',', ' ')) ELSE concat('n/a ', l_returnflag) END AS cell FROM (SELECT *, {grouped} AS g FROM lineitem) t"""
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({_RULES}) r(rule_ord, kw_ord, kw, target)")


def _fixture(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {x: table(spark, sf_dir, x) for x in _TABLES}
    for x, df in t.items():
        df.createOrReplaceTempView(x)
    # the orders of a task are few beside its lines, which so need no sort before they are matched and summed
    hinted = _CAPTIONS.replace("SELECT", "SELECT /*+ SHUFFLE_HASH(orders) */", 1)
    return spark.sql({"captions": hinted, "rates": _RATES, "entities": _ENTITIES, "daily": _DAILY, "ledger": _LEDGER, "review": _REVIEW, "state": _STATE, "updates": _UPDATES, "cells": _CELLS.format(grouped="format_number(l_extendedprice, 2)")}[name])


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.match_rules(_fixture("captions", spark, sf_dir), _rules(spark))


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.skip_subtotals(_matched(spark, sf_dir)).where("target is not null")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US dollars a line of each entity: rules, sums, rates, translation."""
    fxs = fx.lookup_rates(_fixture("entities", spark, sf_dir), _fixture("rates", spark, sf_dir))
    return mapping.translate_usd(mapping.sum_lines(_contributions(spark, sf_dir)), fxs.select("entity_id", "avg_rate", "cy_rate", "py_rate"))


def match_rules(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).groupBy("label", "target").count().withColumnRenamed("count", "n")


def feed_scope(spark: SparkSession, d: str) -> DataFrame:
    return mapping.feed_scope(_matched(spark, d)).groupBy("feed", "target").count().withColumnRenamed("count", "n")


def count_once(spark: SparkSession, d: str) -> DataFrame:
    return mapping.count_once(_contributions(spark, d)).groupBy("entity_id").count().withColumnRenamed("count", "n")


def sum_lines(spark: SparkSession, d: str) -> DataFrame:
    return mapping.sum_lines(_contributions(spark, d))


def multi_source(spark: SparkSession, d: str) -> DataFrame:
    return mapping.multi_source(_contributions(spark, d))


def line_edits(spark: SparkSession, d: str) -> DataFrame:
    c = _contributions(spark, d)
    lines = mapping.sum_lines(c)
    return mapping.line_edits(lines.selectExpr("entity_id", "target", "CASE WHEN entity_id % 7 = 0 THEN amount + 1 ELSE amount END AS amount", "boy", "eoy"), c)


def schedule_subtotals(spark: SparkSession, d: str) -> DataFrame:
    return mapping.schedule_subtotals(mapping.sum_lines(_contributions(spark, d)))


def lookup_rates(spark: SparkSession, d: str) -> DataFrame:
    return fx.lookup_rates(_fixture("entities", spark, d), _fixture("rates", spark, d))


def nearest_rate(spark: SparkSession, d: str) -> DataFrame:
    asked = _fixture("daily", spark, d).selectExpr("code", "date_add(d, 2) AS d")
    return fx.nearest_rate(asked, _fixture("daily", spark, d))


def period_average(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.sql("SELECT * FROM VALUES (DATE'1995-01-01', DATE'1995-12-31'), (DATE'1996-01-01', DATE'1996-02-15'), (DATE'1994-03-17', DATE'1997-08-09') t(start, end)").crossJoin(table(spark, d, "nation").selectExpr("n_name AS code"))
    return fx.period_average(asked, _fixture("daily", spark, d))


def pivot_rate_book(spark: SparkSession, d: str) -> DataFrame:
    return fx.pivot_rate_book(_fixture("rates", spark, d), "spot", [1995, 1996, 1997])


def undeclared_codes(spark: SparkSession, d: str) -> DataFrame:
    return fx.undeclared_codes(_fixture("rates", spark, d), table(spark, d, "nation").where("n_regionkey <> 2").selectExpr("n_name AS code"))


def parse_number(spark: SparkSession, d: str) -> DataFrame:
    """One row a printed cell, with what both parsers read and whether it is textual."""
    c = F.col("cell")
    return _fixture("cells", spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cell", S.parse_number(c).alias("v"), S.strict_number(c).alias("s"), S.is_textual(c).alias("textual"))


def mask_tax_id(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, masked; as the given ones hold no identifier, each gets one at its end."""
    text = F.concat("text", F.lit(" id 123-45-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(" end"))
    return table(spark, d, "documents").select("doc_id", S.mask_tax_id(text).alias("masked"), S.safe_name(F.col("text")).alias("name"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.event_counts(table(spark, d, "events"), "event_type")


def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_events(table(spark, d, "events")).select("event_id", "user_id", "event_type")


def usage_quota(spark: SparkSession, d: str) -> DataFrame:
    return review.usage_quota(table(spark, d, "events"), 500)


def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.ledger_summary(_fixture("ledger", spark, d))


def invoice_credit_pairs(spark: SparkSession, d: str) -> DataFrame:
    return review.invoice_credit_pairs(_fixture("ledger", spark, d))


def first_policy(spark: SparkSession, d: str) -> DataFrame:
    policies = spark.sql(f"SELECT * FROM ({_POLICIES}) p(ord, m_id, m_category, m_message, regex, action)")
    return review.first_policy(_fixture("review", spark, d), policies).select("entity_id", "id", "level", "action")


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.level_counts(_fixture("review", spark, d), "entity_id")


def versioned_update(spark: SparkSession, d: str) -> DataFrame:
    return review.versioned_update(_fixture("state", spark, d), _fixture("updates", spark, d))


def newest_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "ts", "event_type")
    return review.newest_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_QUERIES = (match_rules, feed_scope, count_once, sum_lines, multi_source, line_edits, schedule_subtotals, lookup_rates, nearest_rate, period_average, pivot_rate_book, undeclared_codes, parse_number, mask_tax_id, event_counts, latest_events, usage_quota, ledger_summary, invoice_credit_pairs, first_policy, level_counts, versioned_update, newest_wins)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"translate_usd": flagship} | {f.__name__: f for f in _QUERIES}


def _duck(text: str) -> str:
    return text.replace("dayofyear(o_orderdate)", "dayofyear(CAST(o_orderdate AS DATE))").replace("AS STRING", "AS VARCHAR")


_DUCK_FX = f"""rates AS ({_RATES}), entities AS ({_ENTITIES}), spots AS (SELECT DISTINCT year FROM rates WHERE kind = 'spot'),
newest AS (SELECT max(year) AS n FROM spots), years AS (SELECT n, (SELECT max(year) FROM spots, newest WHERE year < n) AS p FROM newest),
fx AS (SELECT e.*, a.rate AS avg_rate, c.rate AS cy_rate, p.rate AS py_rate
 FROM entities e, years LEFT JOIN rates a ON a.code = e.code AND a.kind = 'avg' AND a.year = coalesce(cy, n)
 LEFT JOIN rates c ON c.code = e.code AND c.kind = 'spot' AND c.year = coalesce(cy, n) LEFT JOIN rates p ON p.code = e.code AND p.kind = 'spot' AND p.year = coalesce(py, years.p))"""
#: A printed number, read step by step.
_DUCK_NUMBER = r"""WITH a AS (SELECT *, regexp_replace(cell, '[\s\x{00A0}'']', '', 'g') AS t FROM (@cells@)),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(CR|DR)$', ''), '[^0-9.,-]', '', 'g'), '-+$', '') AS bare,
 regexp_matches(t, '^\(.*\)$') OR regexp_matches(t, '(?i)CR$') OR regexp_matches(regexp_replace(t, '[^0-9.,-]', '', 'g'), '-$') AS neg FROM a),
c AS (SELECT *, CASE WHEN contains(bare, ',') AND contains(bare, '.') THEN CASE WHEN strpos(reverse(bare), ',') < strpos(reverse(bare), '.')
  THEN regexp_replace(replace(bare, '.', ''), ',', '.') ELSE replace(bare, ',', '') END
  WHEN regexp_matches(bare, '^[^,]*,[0-9]{1,2}$') THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END AS plain FROM b),
d AS (SELECT *, TRY_CAST(regexp_extract(plain, '^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))', 1) AS DOUBLE) * CASE WHEN neg THEN -1 ELSE 1 END AS v FROM c),
e AS (SELECT *, CASE WHEN regexp_matches(cell, '(?i)^\s*\(?\s*-?[0-9.,\s'']+\)?\s*(CR|DR)?\s*/?\s*$') OR NOT regexp_matches(cell, '[A-Za-z\x{C0}-\x{24F}]') THEN v END AS s FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, v, s, regexp_matches(cell, '[A-Za-z\x{C0}-\x{24F}]') AND s IS NULL AS textual FROM e"""


def oracle_sql() -> dict[str, str]:
    m, daily = _DUCK_MATCHED, f"daily AS ({_duck(_DAILY)})"
    usd = lambda v, r: f"CASE WHEN {r} > 0 THEN floor({v} / {r} * 100 + 0.5) / 100 END AS {v}_usd"
    return {
        "translate_usd": f"{m}, {_DUCK_FX} SELECT l.entity_id, target, {usd('amount', 'avg_rate')}, {usd('boy', 'py_rate')}, {usd('eoy', 'cy_rate')} FROM lines l LEFT JOIN fx USING (entity_id)",
        "match_rules": f"{m} SELECT label, target, count(*) AS n FROM matched GROUP BY 1, 2",
        "feed_scope": f"{m} SELECT feed, CASE WHEN (feed = 'is' AND target LIKE 'income%') OR (feed = 'bs' AND target LIKE 'balance%') THEN target END AS target, count(*) AS n FROM matched GROUP BY 1, 2",
        "count_once": f"{m} SELECT entity_id, count(*) AS n FROM (SELECT *, first_value(page) OVER (PARTITION BY entity_id, target, doc_id, lower(label), value, field ORDER BY ord) AS f FROM contribs) WHERE page = f GROUP BY 1",
        "sum_lines": f"{m} SELECT * FROM lines",
        "multi_source": f"{m} SELECT entity_id, target, count(DISTINCT lower(label)) AS captions, count(DISTINCT lower(label)) > 1 AS multi FROM contribs GROUP BY 1, 2",
        "line_edits": f"{m} SELECT entity_id, target, entity_id % 7 = 0 AND amount IS NOT NULL AS edited FROM lines",
        "schedule_subtotals": f"{m} SELECT split_part(target, ':', 1) AS schedule, count(*) AS n_lines, round(sum(amount), 2) AS amount FROM lines GROUP BY ROLLUP (split_part(target, ':', 1))",
        "lookup_rates": f"WITH {_DUCK_FX} SELECT * FROM fx",
        "nearest_rate": f"WITH {daily}, asked AS (SELECT DISTINCT code, CAST(d + 2 AS DATE) AS d FROM daily) SELECT code, d, rate, as_of, CAST(as_of - d AS INT) AS diff_days FROM (SELECT a.code, a.d, p.rate, p.d AS as_of, row_number() OVER (PARTITION BY a.code, a.d ORDER BY abs(p.d - a.d), p.d) AS n FROM asked a JOIN daily p ON a.code = p.code AND abs(p.d - a.d) <= 7) WHERE n = 1",
        "period_average": f"WITH {daily}, asked AS (SELECT n_name AS code, s AS start, e AS \"end\" FROM nation, (VALUES (DATE '1995-01-01', DATE '1995-12-31'), (DATE '1996-01-01', DATE '1996-02-15'), (DATE '1994-03-17', DATE '1997-08-09')) t(s, e)) SELECT a.code, a.start, a.\"end\", count(rate) AS points, CASE WHEN count(rate) >= 60 THEN round(avg(rate), 6) END AS rate FROM asked a LEFT JOIN daily p ON a.code = p.code AND p.d BETWEEN a.start AND a.\"end\" GROUP BY 1, 2, 3",
        "pivot_rate_book": f"WITH rates AS ({_RATES}) SELECT code, max(rate) FILTER (WHERE year = 1995) AS y1995, max(rate) FILTER (WHERE year = 1996) AS y1996, max(rate) FILTER (WHERE year = 1997) AS y1997 FROM rates WHERE kind = 'spot' GROUP BY 1",
        "undeclared_codes": f"WITH rates AS ({_RATES}) SELECT DISTINCT code FROM rates WHERE code NOT IN (SELECT n_name FROM nation WHERE n_regionkey <> 2)",
        "parse_number": _DUCK_NUMBER.replace("@cells@", _CELLS.format(grouped="format('{:,.2f}', l_extendedprice)")),
        "mask_tax_id": "SELECT doc_id, regexp_replace(text || ' id 123-45-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' end', '[0-9]{3}-[0-9]{2}-([0-9]{4})', '***-**-\\1', 'g') AS masked, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS name FROM documents",
        "event_counts": "SELECT event_type, count(*) AS n_events, max(ts) AS last_ts FROM events GROUP BY 1",
        "latest_events": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
        "usage_quota": "SELECT CAST(ts AS DATE) AS d, count(*) AS used, greatest(500 - count(*), 0) AS remaining, least(1.0, count(*) / 500) AS ratio FROM events GROUP BY 1",
        "ledger_summary": f"WITH l AS ({_LEDGER}) SELECT entity_id, count(*) FILTER (WHERE details = 'invoice') AS n_invoices, count(*) FILTER (WHERE details = 'credit note') AS n_credits, round(sum(CASE details WHEN 'invoice' THEN source WHEN 'credit note' THEN -abs(source) END), 2) AS total, round(sum(source) FILTER (WHERE details = 'cash paid'), 2) AS cash_paid FROM l GROUP BY 1",
        "invoice_credit_pairs": f"WITH l AS ({_LEDGER}) SELECT entity_id, reference FROM l GROUP BY 1, 2 HAVING bool_or(details = 'invoice') AND bool_or(details = 'credit note')",
        "first_policy": f"WITH r AS ({_REVIEW}), p AS (SELECT * FROM ({_duck(_POLICIES)}) p(ord, m_id, m_category, m_message, regex, action)), h AS (SELECT r.*, (SELECT arg_min(action, ord) FROM p WHERE CASE WHEN m_id <> '' THEN CAST(id AS VARCHAR) = m_id WHEN m_category <> '' THEN category = m_category WHEN regex THEN regexp_matches(message, m_message, 'i') ELSE contains(lower(message), lower(m_message)) END) AS action FROM r) SELECT entity_id, id, CASE WHEN action IS NULL OR action = 'keep' THEN level ELSE action END AS level, action FROM h WHERE action IS NULL OR action <> 'suppress'",
        "level_counts": f"WITH r AS ({_REVIEW}) SELECT entity_id, count(*) FILTER (WHERE level = 'block') AS n_block, count(*) FILTER (WHERE level = 'warn') AS n_warn, count(*) FILTER (WHERE level = 'info') AS n_info FROM r GROUP BY 1",
        "versioned_update": f"WITH RECURSIVE c AS ({_STATE}), u AS (SELECT x.id, ord, base_version, version AS now, row_number() OVER (PARTITION BY x.id ORDER BY ord) AS n FROM ({_UPDATES}) x LEFT JOIN c USING (id)), r AS (SELECT id, ord, n, base_version, now AS before, CASE WHEN base_version IS NULL OR base_version = now THEN now + 1 ELSE now END AS version FROM u WHERE n = 1 UNION ALL SELECT u.id, u.ord, u.n, u.base_version, r.version, CASE WHEN u.base_version IS NULL OR u.base_version = r.version THEN r.version + 1 ELSE r.version END FROM r JOIN u ON u.id = r.id AND u.n = r.n + 1) SELECT id, ord, CASE WHEN before IS NULL THEN 'not found' WHEN base_version IS NULL OR base_version = before THEN 'accepted' ELSE 'conflict' END AS status, version FROM r",
        "newest_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    }
