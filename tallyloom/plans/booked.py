"""Queries of the whole booking of captions: line items as rows of statements in every shape, with SQL of the same order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import captions
from tallyloom.session import table

_RULES = """VALUES (1,1,'ring','income:11'),(2,1,'bolt','income:54'),(3,1,'anvil','SKIP'),(4,1,'gear','balance:OCA'),(5,1,'rod','income:OI'),(6,1,'plate','income:OD'),(7,1,'widget','balance:3'),(7,2,'cold widget','balance:OL')"""
#: Statement rows: a caption with a number that makes pools overflow, some of them owed by the group; grids without pages;
#: values under years or not by ``v``; income, balance and unscoped pages.
_ROWS = """SELECT *, doc_id * 100 + n AS row_id, row_number() OVER (PARTITION BY entity_id ORDER BY doc_id, n) AS ord FROM (
 SELECT o_custkey AS entity_id, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_extendedprice AS price, CAST(floor(l_quantity / 10) AS INT) * 1.0 AS qty,
  CAST(l_suppkey % 7 AS INT) AS v, l_orderkey % 4 = 0 AS is_grid, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_linenumber % 3 + 1 AS INT) END AS page, CAST(year(o_orderdate) AS INT) AS y,
  CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'bs' WHEN 1 THEN 'bs' WHEN 2 THEN NULL ELSE 'is' END AS feed,
  CASE WHEN l_partkey % 9 = 0 THEN concat('Owed by Northwind ', l_partkey % 4) WHEN l_partkey % 9 = 1 THEN concat('Creditor northwind ', l_partkey % 4) WHEN l_partkey % 9 = 2 THEN concat('Less ', p_name) ELSE concat(p_name, ' ', l_partkey % 3) END AS label
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) t"""
#: The rows as Spark makes them: names come first, so that lines meet their order and are numbered in one place; the order within an
#: entity is that of documents and rows, which row_id has already.
_ROWS_MADE = _ROWS.replace("row_number() OVER (PARTITION BY entity_id ORDER BY doc_id, n) AS ord", "doc_id * 100 + n AS ord").replace(
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey", "lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"
)
_OVERRIDES = """SELECT c_custkey AS entity_id, label, target FROM customer JOIN (VALUES (0, 'HOT   Ring 1', 'income:23'), (0, 'red gear 2', 'balance:16'), (1, 'cold rod 0', NULL), (1, 'Blue anvil 1', 'income:12'), (2, 'new gizmo 1', 'balance:17'), (2, 'small plate 2', 'income:50'), (2, 'old gear 0', 'balance:16'), (2, 'hot gear 1', 'balance:18')) o(k, label, target) ON c_custkey % 4 = k"""
_NAMES = "SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'The Northwind Group' ELSE 'Contoso Ltd' END AS name FROM customer"


def _mapped(spark: SparkSession, d: str) -> captions.Mapped:
    for x in ("lineitem", "orders", "part", "customer"):
        table(spark, d, x).createOrReplaceTempView(x)
    v = F.col("v")
    vals = F.when(v.isin(0, 3), F.array("price")).otherwise(F.array("price", F.col("qty").cast("double")))
    years = F.when(v == 1, F.array("y", F.col("y") - 1)).when(v == 2, F.array(F.col("y") - 1, "y")).when(v == 3, F.array(F.col("y") - 1)).when(v == 4, F.array("y", "y")).when(v == 5, F.array(F.lit(None).cast("int"), F.col("y")))
    rows = spark.sql(_ROWS_MADE).select(
        "row_id", "entity_id", "doc_id", "page", "ord", "label", vals.alias("vals"), years.alias("years"), F.when(F.col("doc_id") % 5 > 0, F.col("y")).alias("cy"), F.when(F.col("doc_id") % 5 > 0, F.col("y") - 1).alias("py"), F.when(F.col("is_grid"), "grid").otherwise("pdf").alias("kind"), "feed",
    )
    return captions.map_captions(rows, spark.sql(f"SELECT * FROM ({_RULES}) r(rule_ord, kw_ord, kw, target)"), spark.sql(_OVERRIDES), spark.sql(_NAMES))


def map_captions(spark: SparkSession, d: str) -> DataFrame:
    """The fate of every row."""
    return _mapped(spark, d).fates.select("row_id", "target", "fate")


def map_captions_booked(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).contributions.select("row_id", "target", "field", "value", "year")


def map_captions_named(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).relabels


def map_captions_review(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).review


_QUERIES = (map_captions, map_captions_booked, map_captions_named, map_captions_review)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_SQL = f"""
WITH rws AS (SELECT *, lower(label) AS low FROM ({_ROWS})),
rules AS (SELECT * FROM ({_RULES}) r(rule_ord, kw_ord, kw, target)),
hit AS (
  SELECT low, first(target ORDER BY length(kw) DESC, rule_ord, kw_ord) AS target FROM (SELECT DISTINCT low FROM rws) l JOIN rules
  ON regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}])' || kw || CASE WHEN length(kw) >= 5 THEN '\\p{{L}}{{0,3}}' ELSE '' END || '($|[^\\p{{L}}\\p{{N}}])') GROUP BY low),
ov AS (SELECT entity_id, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS low, target AS own_to, true AS own FROM ({_OVERRIDES})),
grp AS (SELECT entity_id, name LIKE '%Northwind%' AS northwind FROM ({_NAMES})),
a AS (
  SELECT rws.*, hit.target AS ruled, coalesce(ov.own, false) AND hit.target IS DISTINCT FROM 'SKIP' AS own, own_to, northwind
  FROM rws LEFT JOIN hit USING (low) LEFT JOIN ov ON ov.entity_id = rws.entity_id AND ov.low = rws.low LEFT JOIN grp ON grp.entity_id = rws.entity_id),
b AS (
  SELECT *, CASE WHEN ruled = 'SKIP' THEN 'SKIP' WHEN own THEN own_to WHEN feed = 'is' AND ruled NOT LIKE 'income%' THEN NULL WHEN feed = 'bs' AND ruled NOT LIKE 'balance%' THEN NULL ELSE ruled END AS scoped FROM a),
c AS (
  SELECT *, CASE WHEN scoped IS NULL AND NOT own AND feed = 'bs' AND northwind AND low LIKE 'owed by northwind%' THEN 'balance:19' WHEN scoped IS NULL AND NOT own AND feed = 'bs' AND northwind AND low LIKE 'creditor northwind%' THEN 'balance:52' END AS loan FROM b),
e AS (
  SELECT *, coalesce(scoped, loan) AS tgt, coalesce(scoped, loan) LIKE 'balance%' AS bal, CASE WHEN label LIKE 'Less %' THEN -1 ELSE 1 END AS sg, CASE WHEN doc_id % 5 > 0 THEN y END AS cy FROM c),
r AS (
  -- v: 0 one value, 1 this and last year, 2 last and this, 3 last year only, 4 this year twice, 5 one without a year, 6 two without years
  SELECT *, CASE WHEN sg < 0 AND price > 0 THEN -price ELSE price END AS p1, CASE WHEN sg < 0 AND qty > 0 THEN -qty ELSE qty END AS p2,
         v = 4 OR (v = 6 AND NOT is_grid) AS unclear FROM e),
x AS (
  SELECT *, CASE
    WHEN unclear THEN []
    WHEN v IN (1, 2, 3, 5) THEN CASE
      WHEN v = 3 AND cy IS NULL THEN CASE WHEN bal THEN [{{'f': 'eoy', 'x': p1, 'yr': y - 1}}] ELSE [{{'f': 'amount', 'x': p1, 'yr': y - 1}}] END
      WHEN v = 3 THEN CASE WHEN bal THEN [{{'f': 'boy', 'x': p1, 'yr': y - 1}}] ELSE [] END
      WHEN bal AND v = 5 THEN [{{'f': 'eoy', 'x': p2, 'yr': y}}]
      WHEN bal THEN [{{'f': 'eoy', 'x': CASE WHEN v = 1 THEN p1 ELSE p2 END, 'yr': y}}, {{'f': 'boy', 'x': CASE WHEN v = 1 THEN p2 ELSE p1 END, 'yr': y - 1}}]
      ELSE [{{'f': 'amount', 'x': CASE WHEN v = 1 THEN p1 ELSE p2 END, 'yr': y}}] END
    WHEN v = 0 THEN [{{'f': CASE WHEN bal THEN 'eoy' ELSE 'amount' END, 'x': p1, 'yr': NULL}}]
    WHEN bal THEN [{{'f': 'eoy', 'x': p2, 'yr': NULL}}, {{'f': 'boy', 'x': p1, 'yr': NULL}}]
    ELSE [{{'f': 'amount', 'x': p2, 'yr': NULL}}] END AS routes FROM r),
f AS (
  SELECT *, CASE WHEN tgt = 'SKIP' THEN 'skipped' WHEN tgt IS NULL AND own THEN 'unassigned' WHEN tgt IS NULL THEN 'unmatched' WHEN unclear THEN 'ambiguous' WHEN len(routes) = 0 THEN 'no value' ELSE 'booked' END AS fate FROM x),
pools AS (
  SELECT pool, i, split_part(pool, ':', 1) || ':' || n AS slot FROM (SELECT pool, unnest(range(1, len(ns) + 1)) AS i, unnest(ns) AS n FROM (VALUES
   ('income:OI', [22, 23, 24]), ('income:OD', range(34, 51)), ('balance:OCA', [16, 17, 18]), ('balance:OL', [54, 55, 56])) p(pool, ns))),
pooled AS (SELECT *, tgt IN (SELECT pool FROM pools) AND NOT own AS inpool FROM f WHERE fate = 'booked'),
caps AS (SELECT entity_id, tgt, low, row_number() OVER (PARTITION BY entity_id, tgt ORDER BY min(ord)) AS k FROM pooled WHERE inpool GROUP BY 1, 2, 3),
free AS (
  SELECT n.entity_id, pool, slot, row_number() OVER (PARTITION BY n.entity_id, pool ORDER BY i) AS k, count(*) OVER (PARTITION BY n.entity_id, pool) AS total
  FROM (SELECT DISTINCT entity_id FROM rws) n, pools WHERE NOT EXISTS (SELECT 1 FROM ({_OVERRIDES}) o WHERE o.entity_id = n.entity_id AND o.target = slot)),
z AS (
  SELECT p.*, CASE WHEN NOT inpool THEN p.tgt ELSE coalesce(own.slot, lst.slot, CASE p.tgt WHEN 'balance:OCA' THEN 'balance:18' END) END AS slot, inpool AND own.slot IS NULL AS inlast
  FROM pooled p LEFT JOIN caps ON caps.entity_id = p.entity_id AND caps.tgt = p.tgt AND caps.low = p.low AND inpool
  LEFT JOIN free own ON own.entity_id = p.entity_id AND own.pool = p.tgt AND own.k = caps.k AND own.k < own.total
  LEFT JOIN free lst ON lst.entity_id = p.entity_id AND lst.pool = p.tgt AND lst.k = lst.total),
w AS (SELECT row_id, entity_id, doc_id, page, ord, label, low, slot, inpool, inlast, loan, scoped, unnest(routes, recursive := true) FROM z),
once AS (SELECT *, coalesce(page <> first(page) OVER (PARTITION BY entity_id, slot, doc_id, low, x, f ORDER BY ord), false) AS again, CASE WHEN f = 'amount' AND slot IN ('income:54', 'income:55') AND x > 0 THEN -x ELSE x END AS booked FROM w),
lines AS (SELECT entity_id, slot, row_id, min(ord) AS ord, min(label) AS label, bool_or(inlast) AS inlast, bool_or(inpool) AS inpool FROM once GROUP BY 1, 2, 3),
named AS (
  SELECT entity_id, slot AS target, count(*) FILTER (inlast) AS k, coalesce(first(label ORDER BY ord) FILTER (inpool), first(label ORDER BY ord)) AS label FROM lines
  WHERE inpool OR slot IN ('income:22', 'income:23', 'income:24', 'balance:16', 'balance:17', 'balance:18') OR slot IN (SELECT 'income:' || n FROM range(34, 51) t(n)) OR slot IN ('balance:54', 'balance:55', 'balance:56') GROUP BY 1, 2)
"""
_FATES = "SELECT f.row_id, coalesce(o.slot, f.tgt) AS target, CASE WHEN o.again THEN 'counted once' ELSE f.fate END AS fate FROM f LEFT JOIN (SELECT row_id, min(slot) AS slot, bool_and(again) AS again FROM once GROUP BY 1) o USING (row_id)"
_BOOKED = "SELECT row_id, slot AS target, f AS field, booked AS value, yr AS year FROM once WHERE NOT again"
_NAMED = "SELECT entity_id, target, CASE WHEN k > 1 THEN 'Other (' || k || ' items)' ELSE label END AS label FROM named"
_REVIEW = """SELECT entity_id, 'warn' AS level, 'related-party' AS category, slot AS target, label, count(DISTINCT row_id) AS n FROM once WHERE scoped IS NULL AND loan IS NOT NULL GROUP BY ALL
UNION ALL SELECT entity_id, 'info', 'counted-once', slot, label, count(DISTINCT row_id) FROM once WHERE again GROUP BY ALL
UNION ALL SELECT entity_id, 'warn', 'tax-sign', slot, label, count(DISTINCT row_id) FROM once WHERE booked <> x GROUP BY ALL
UNION ALL SELECT entity_id, 'info', 'pool', target, 'Other (' || k || ' items)', k FROM named WHERE k > 1"""


def oracle_sql() -> dict[str, str]:
    return {"map_captions": _SQL + _FATES, "map_captions_booked": _SQL + _BOOKED, "map_captions_named": _SQL + _NAMED, "map_captions_review": _SQL + _REVIEW}
