"""Queries of replayed edit logs: orders and events as contributions, review items and what users did to them, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import edits, stale
from tallyloom.session import table

_TARGETS = "VALUES (0, 'income:11'), (1, 'income:12'), (2, 'balance:3'), (3, 'balance:4'), (4, 'balance:5')"
_GIVEN = f"""SELECT entity_id, target, label, CASE WHEN target LIKE 'income%' THEN 'amount' WHEN p % 2 = 0 THEN 'eoy' ELSE 'boy' END AS field, value, row_id FROM (
 SELECT o_custkey AS entity_id, t.target, concat('caption ', l_partkey % 5) AS label, l_suppkey AS p, floor(l_extendedprice) AS value, n AS row_id
 FROM (SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) i JOIN orders ON l_orderkey = o_orderkey JOIN ({_TARGETS}) t(k, target) ON l_partkey % 5 = (k + o_custkey) % 5 OR (l_partkey % 7 = 0 AND l_suppkey % 5 = k)) x"""
#: The moves of an entity's captions, one an order: chains, moves back, lines that don't exist, captions taken off.
_MOVES = f"""SELECT o_custkey AS entity_id, o_orderkey AS seq, concat('Caption ', o_orderkey % 5) AS spelled, concat('caption ', o_orderkey % 5) AS label, f.target AS from_target,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'income:99' ELSE g.target END AS to_target
 FROM orders JOIN ({_TARGETS}) f(k, target) ON (o_orderkey + o_custkey + CAST(floor(o_orderkey / 5) AS BIGINT)) % 5 = f.k JOIN ({_TARGETS}) g(k, target) ON CAST(floor(o_orderkey / 3) AS BIGINT) % 5 = g.k"""
_LINES = f"""SELECT entity_id, target, sum(CASE WHEN field = 'amount' THEN value END) AS amount, sum(CASE WHEN field = 'boy' THEN value END) + CASE WHEN entity_id % 5 = 0 AND target = 'balance:3' THEN 7 ELSE 0 END AS boy,
 sum(CASE WHEN field = 'eoy' THEN value END) AS eoy FROM ({_GIVEN}) c GROUP BY 1, 2"""
#: Review items of users, their writes and a log of sign-offs.
_ITEMS = """SELECT c_custkey AS entity_id, concat('r', k) AS id, CASE k WHEN 0 THEN 'income!F11' WHEN 1 THEN 'income!F11' WHEN 2 THEN 'balance!D3' WHEN 3 THEN 'other!D3' ELSE 'balance!F3' END AS target, k % 2 = 0 AS stored FROM customer JOIN (VALUES (0), (1), (2), (3), (4)) v(k) ON true"""
_WRITES = "SELECT c_custkey AS entity_id, CASE WHEN j < 2 THEN 'r4' ELSE 'r3' END AS review_id, j AS ord, concat('w', j) AS value FROM customer JOIN (VALUES (0), (1), (2)) v(j) ON j < 2 OR c_custkey % 2 = 0"
_FIGURES = "SELECT c_custkey AS entity_id, 'income:11' AS target, 100.5D AS amount, CAST(NULL AS DOUBLE) AS boy, CAST(NULL AS DOUBLE) AS eoy FROM customer"
_SIGNED = """SELECT o_custkey AS entity_id, concat('r', o_orderkey % 5) AS id, o_orderkey AS seq, CASE CAST(floor(o_orderkey / 5) AS BIGINT) % 4 WHEN 0 THEN 'restore' WHEN 1 THEN 'dismiss' ELSE 'edit' END AS action,
 CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 1 THEN '1,234' ELSE CAST(o_orderkey % 1000 AS STRING) END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' END AS note FROM orders"""


def _base(spark: SparkSession, d: str) -> None:
    for x in ("lineitem", "orders", "customer"):
        table(spark, d, x).createOrReplaceTempView(x)


def _remapped(spark: SparkSession, d: str) -> edits.Remapped:
    _base(spark, d)
    given = spark.sql(_GIVEN).withColumn("value", F.col("value").cast("double"))
    lines = spark.sql(_LINES).select("entity_id", "target", *(F.col(f).cast("double").alias(f) for f in edits.FIELDS))
    return edits.remap_contributions(given, lines, spark.sql(_MOVES).drop("spelled"), spark.sql(f"SELECT target FROM ({_TARGETS}) t(k, target)"))


def remap_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _remapped(spark, d).contributions.select("row_id", "entity_id", "label", "target", "field", "value")


def remap_log(spark: SparkSession, d: str) -> DataFrame:
    return _remapped(spark, d).log.select("entity_id", "seq", "status", "moved", "dropped")


def remap_lines(spark: SparkSession, d: str) -> DataFrame:
    return _remapped(spark, d).lines


def _resolved(spark: SparkSession, d: str) -> edits.Resolved:
    _base(spark, d)
    return edits.resolve_review_edits(*(spark.sql(x) for x in (_ITEMS, _WRITES, _FIGURES, _SIGNED)))


def resolve_review_edits(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).items


def resolved_writes(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).writes


def resolved_cells(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).cells


#: Facts of entities by key and source, files that some entities no longer have, and values of which some were typed.
_FILES = "SELECT c_custkey AS entity_id, name FROM customer JOIN (VALUES (2, 'a.pdf'), (3, 'Return 2023.PDF'), (5, 'book.xlsx')) f(k, name) ON c_custkey % k > 0"
_DETECTED = """SELECT c_custkey AS entity_id, key, concat(v, c_custkey % 7) AS value, label, doc FROM customer JOIN (VALUES ('currency', 'A', 'a.pdf · face', CAST(NULL AS STRING)), ('name', 'N', 'Return 2023.PDF, page 2', NULL), ('cat:4', 'Yes', 'any', 'a.pdf'), ('cat:5a', 'Yes', 'x', 'book.xlsx'),
 ('city', 'C', 'statement year', NULL), ('days', 'D', CAST(NULL AS STRING), NULL), ('both', 'B', 'see a.pdf', NULL), ('pct', 'P', 'book.xlsx · B2', NULL), ('code', 'K', 'a.pdf', 'book.xlsx')) f(key, v, label, doc) ON true"""
_PROFILE = """SELECT c_custkey AS entity_id, bucket, key, CASE WHEN bucket = 'category' THEN 'Yes' ELSE concat(v, (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) % 7) END AS value FROM customer JOIN (VALUES ('profile', 'currency', 'A'), ('profile', 'name', 'N'), ('category', '4', ''), ('category', '5a', ''), ('category', '1a', ''),
 ('profile', 'city', 'C'), ('ownership', 'days', 'D'), ('profile', 'both', 'B'), ('ownership', 'both', 'B'), ('ownership', 'pct', 'P'), ('profile', 'code', 'K'), ('profile', 'typed', 'T')) f(bucket, key, v) ON true"""
_HOLDERS = "SELECT o_orderkey AS holder, o_custkey AS entity_id, CASE o_orderkey % 4 WHEN 0 THEN 'a.pdf · Part II' WHEN 1 THEN 'other.pdf' WHEN 2 THEN '' END AS source FROM orders"


def _pruned(spark: SparkSession, d: str) -> stale.Pruned:
    _base(spark, d)
    return stale.prune_stale(*(spark.sql(x) for x in (_DETECTED, _FILES, _PROFILE, _HOLDERS)))


def prune_stale(spark: SparkSession, d: str) -> DataFrame:
    """What stays detected, and what went."""
    p = _pruned(spark, d)
    return p.detected.select("entity_id", "key", F.lit(True).alias("kept")).unionByName(p.tombstones.withColumn("kept", F.lit(False)))


def prune_stale_profile(spark: SparkSession, d: str) -> DataFrame:
    p = _pruned(spark, d)
    return p.profile.join(p.reset.withColumn("reset", F.lit(True)), "entity_id", "left").withColumn("reset", F.coalesce("reset", F.lit(False)))


def prune_stale_holders(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d).holders.select("holder", "entity_id", "source")


_QUERIES = (prune_stale, prune_stale_profile, prune_stale_holders, remap_contributions, remap_log, remap_lines, resolve_review_edits, resolved_writes, resolved_cells)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_REPLAY = f"""
WITH RECURSIVE c AS (SELECT * FROM ({_GIVEN})),
hand AS (SELECT DISTINCT entity_id, target FROM c WHERE entity_id % 5 = 0 AND target = 'balance:3' AND field = 'boy'),
m AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.entity_id, label ORDER BY seq) AS n, hand.target IS NOT NULL AS refused, coalesce(to_target = 'income:99' OR to_target = from_target, false) AS wrong
  FROM ({_MOVES}) m LEFT JOIN hand ON hand.entity_id = m.entity_id AND hand.target = m.from_target),
-- each contribution goes through its caption's moves one by one; 'off' is nowhere
p AS (
  SELECT row_id, c.target AS origin, entity_id, label, value, CAST(0 AS BIGINT) AS n, c.target, field, CAST(NULL AS BIGINT) AS seq, false AS dropped, false AS moved FROM c
  UNION ALL
  SELECT p.row_id, p.origin, p.entity_id, p.label, p.value, m.n,
         CASE WHEN NOT hit THEN p.target WHEN to_target IS NULL OR (to_target LIKE 'income%' AND field = 'boy') THEN 'off' ELSE to_target END,
         CASE WHEN NOT hit OR to_target IS NULL THEN field WHEN to_target LIKE 'income%' AND field = 'eoy' THEN 'amount' WHEN to_target LIKE 'balance%' AND field = 'amount' THEN 'eoy' ELSE field END,
         m.seq, hit AND coalesce(to_target LIKE 'income%' AND field = 'boy', false), hit
  FROM (SELECT p.*, p.n + 1 AS next FROM p) p JOIN (SELECT * FROM m) m ON m.entity_id = p.entity_id AND m.label = p.label AND m.n = p.next, LATERAL (SELECT p.target = m.from_target AND NOT refused AND NOT wrong AS hit) h),
z AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY row_id, origin ORDER BY n DESC) = 1)
"""
_LOG = """SELECT m.entity_id, m.seq, CASE WHEN wrong THEN 'no such line' WHEN refused THEN 'edited by hand' WHEN k.n IS NULL THEN 'nothing to move' WHEN to_target IS NULL THEN 'unassigned' ELSE 'moved' END AS status,
 coalesce(k.moved, 0) AS moved, coalesce(k.dropped, 0) AS dropped
FROM m LEFT JOIN (SELECT entity_id, seq, count(*) AS n, count(*) FILTER (NOT dropped) AS moved, count(*) FILTER (dropped) AS dropped FROM p WHERE moved GROUP BY 1, 2) k ON k.entity_id = m.entity_id AND k.seq = m.seq"""
_LINES_NOW = """SELECT entity_id, target, CASE WHEN sum(v) FILTER (f = 'amount') IS NOT NULL THEN sum(v) FILTER (f = 'amount') END AS amount, sum(v) FILTER (f = 'boy') AS boy, sum(v) FILTER (f = 'eoy') AS eoy
FROM (SELECT entity_id, target, field AS f, value AS v FROM z WHERE target <> 'off' UNION ALL SELECT entity_id, target, 'boy', 7 FROM hand
      UNION ALL SELECT h.entity_id, h.target, x.f, 0 FROM hand h JOIN (SELECT DISTINCT entity_id, target, field AS f FROM c) x ON x.entity_id = h.entity_id AND x.target = h.target) GROUP BY 1, 2"""
_SIGN_OFFS = f"""
WITH RECURSIVE items AS (SELECT *, CASE WHEN id = 'r4' OR (id = 'r3' AND entity_id % 2 = 0) THEN true ELSE false END AS linked FROM ({_ITEMS})),
e AS (SELECT s.*, CASE WHEN action = 'edit' THEN replace(value, ',', '') END AS v, row_number() OVER (PARTITION BY entity_id, id ORDER BY seq) AS n FROM ({_SIGNED.replace('AS STRING', 'AS VARCHAR')}) s),
cell AS (
  SELECT e.entity_id, e.id, e.seq, v, target, CASE WHEN target = 'income!F11' THEN '100.5' END AS held,
         lag(v) OVER (PARTITION BY e.entity_id, target ORDER BY seq) AS before, row_number() OVER (PARTITION BY e.entity_id, target ORDER BY seq DESC) AS r
  FROM e JOIN items i ON i.entity_id = e.entity_id AND i.id = e.id WHERE v IS NOT NULL AND v <> 'n/a' AND NOT linked AND target <> 'other!D3'),
p AS (
  SELECT entity_id, id, target, linked, CAST(0 AS BIGINT) AS n, false AS dismissed, '' AS note, CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS VARCHAR) AS edited, CAST(NULL AS VARCHAR) AS prior, stored,
         CASE WHEN id = 'r4' THEN 'w0' WHEN linked THEN 'w2' END AS write, false AS touched FROM items
  UNION ALL
  SELECT p.entity_id, p.id, p.target, p.linked, e.n, CASE WHEN action <> 'restore' THEN true WHEN p.stored THEN false ELSE p.dismissed END, CASE WHEN action <> 'restore' THEN coalesce(e.note, '') WHEN p.stored THEN '' ELSE p.note END,
         CASE WHEN action = 'edit' THEN 'edited' WHEN action = 'restore' AND p.stored THEN NULL ELSE p.resolution END, CASE WHEN action = 'edit' THEN e.v WHEN action = 'restore' AND p.stored THEN NULL ELSE p.edited END,
         CASE WHEN action = 'edit' AND p.linked THEN p.write WHEN action = 'edit' THEN coalesce(cell.before, cell.held) WHEN action = 'restore' AND p.stored THEN NULL ELSE p.prior END, p.stored OR action <> 'restore',
         CASE WHEN p.linked AND action = 'edit' THEN e.v WHEN p.linked AND action = 'restore' AND p.stored AND p.resolution = 'edited' THEN coalesce(p.prior, p.write) ELSE p.write END, p.touched OR (p.linked AND action = 'edit')
  FROM p JOIN e ON e.entity_id = p.entity_id AND e.id = p.id AND e.n = p.n + 1 LEFT JOIN cell ON cell.entity_id = e.entity_id AND cell.id = e.id AND cell.seq = e.seq),
z AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id, id ORDER BY n DESC) = 1)
"""

_STALE = f"""
WITH d AS (
  SELECT *, CASE WHEN doc IS NOT NULL THEN EXISTS (SELECT 1 FROM ({_FILES}) f WHERE f.entity_id = d.entity_id AND f.name = doc) WHEN label IS NULL OR NOT regexp_matches(label, '\\.(pdf|xlsx|xlsm|xls|csv)', 'i') THEN true
                 ELSE EXISTS (SELECT 1 FROM ({_FILES}) f WHERE f.entity_id = d.entity_id AND starts_with(label, f.name)) END AS kept
  FROM ({_DETECTED.replace('AS STRING', 'AS VARCHAR')}) d),
p AS (
  SELECT p.*, d.key IS NOT NULL AND (bucket = 'category' OR p.value = d.value) AND NOT (bucket = 'ownership' AND p.key = 'both' AND p.value = d.value) AS blank
  FROM ({_PROFILE}) p LEFT JOIN d ON d.entity_id = p.entity_id AND d.key = CASE WHEN bucket = 'category' THEN 'cat:' || p.key ELSE p.key END AND NOT kept)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "prune_stale": _STALE + "SELECT entity_id, key, kept FROM d",
        "prune_stale_profile": _STALE + "SELECT entity_id, bucket, key, CASE WHEN blank THEN '' ELSE value END AS value, bool_or(blank AND bucket = 'profile' AND key = 'currency') OVER (PARTITION BY entity_id) AS reset FROM p",
        "prune_stale_holders": f"SELECT holder, entity_id, source FROM ({_HOLDERS}) h WHERE coalesce(source, '') = '' OR EXISTS (SELECT 1 FROM ({_FILES}) f WHERE f.entity_id = h.entity_id AND starts_with(source, f.name))",
        "remap_contributions": _REPLAY + "SELECT row_id, entity_id, label, target, field, CAST(value AS DOUBLE) AS value FROM z WHERE target <> 'off'",
        "remap_log": _REPLAY + _LOG,
        "remap_lines": _REPLAY + _LINES_NOW,
        "resolve_review_edits": _SIGN_OFFS + "SELECT entity_id, id, target, dismissed, note, resolution, edited AS edited_value, prior AS prior_value, stored FROM z",
        "resolved_writes": _SIGN_OFFS + f"SELECT w.entity_id, review_id, ord, CASE WHEN z.touched THEN z.write ELSE w.value END AS value FROM ({_WRITES}) w LEFT JOIN z ON z.entity_id = w.entity_id AND z.id = w.review_id",
        "resolved_cells": _SIGN_OFFS + "SELECT entity_id, CASE target WHEN 'income!F11' THEN 'income:11' ELSE 'balance:3' END AS target, CASE target WHEN 'income!F11' THEN 'amount' WHEN 'balance!D3' THEN 'boy' ELSE 'eoy' END AS field, CAST(v AS DOUBLE) AS value FROM cell WHERE r = 1",
    }
