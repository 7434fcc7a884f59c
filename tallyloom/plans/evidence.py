"""Queries of the evidence operators over the given tables, with their DuckDB SQL; see layout_books for the manner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import evidence
from tallyloom.session import table

_BASE = {
    "kinds": "SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' AND l_linenumber > 2 THEN 'return' WHEN l_returnflag = 'R' THEN 'statement' WHEN l_linenumber = 1 THEN 'terms' ELSE 'unknown' END AS kind FROM lineitem",
    "votes": "SELECT o_custkey AS doc_id, CAST(year(o_orderdate) + 5 AS INT) AS year, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS weight, o_orderkey AS pos FROM orders",
    "sales": "SELECT o_custkey AS entity_id, o_orderstatus AS target, o_orderpriority AS label, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS value FROM orders",
    "texts": "SELECT source AS entity_id, lang, n_chars > 3000 AS bound FROM documents",
    "lines": "SELECT o_custkey AS entity_id, o_orderstatus AS target, sum(o_totalprice) AS boy FROM orders GROUP BY 1, 2",
    "filed": "SELECT o_custkey AS entity_id, o_orderstatus AS target, floor(sum(o_totalprice) / 2 + 0.5) + max(o_orderkey % 3) AS filed FROM orders GROUP BY 1, 2",
    "fx": "SELECT c_custkey AS entity_id, CASE WHEN c_nationkey % 5 = 0 THEN 0.0E0 ELSE 2.0E0 END AS rate FROM customer",
    "values": "SELECT o_custkey AS entity_id, l_orderkey AS doc_id, floor(l_quantity / 10) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "items": "SELECT user_id AS entity_id, event_id AS id, value FROM events",
    "earlier": "SELECT user_id AS entity_id, event_id AS id, event_id % 4 = 0 AS dismissed, CASE WHEN event_id % 6 = 0 THEN value + 1 END AS edited FROM events WHERE event_type <> 'view'",
    "sheet": "SELECT c_custkey, c_acctbal AS y2023, c_acctbal - 5000 AS y2024 FROM customer",
    "facts": "SELECT event_type AS sheet, user_id AS ref, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR(20)) END AS value, event_id AS ord FROM events WHERE event_id % 5 <> 0",
    "schedules": "SELECT event_type AS sheet, user_id AS ref, concat('s', CAST(event_id AS VARCHAR(20))) AS value, event_id AS ord FROM events WHERE event_id % 5 = 0",
}
#: The sums of prices as Spark adds them: in cents, so that they are the same in whatever order the rows come.
_EXACT = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)"
_TABLES = ("customer", "orders", "lineitem", "events", "documents")


def _base(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    for x in _TABLES:
        table(spark, sf_dir, x).createOrReplaceTempView(x)
    return [spark.sql(_BASE[n].replace("sum(o_totalprice)", _EXACT)) for n in names]


def doc_kind(spark: SparkSession, d: str) -> DataFrame:
    return evidence.doc_kind(*_base(spark, d, "kinds"), ["return", "statement", "terms"])


def statement_year(spark: SparkSession, d: str) -> DataFrame:
    return evidence.statement_year(*_base(spark, d, "votes"))


def caption_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.caption_evidence(*_base(spark, d, "sales"))


def evidence_stats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evidence_stats(*_base(spark, d, "texts"))


def boy_tie_out(spark: SparkSession, d: str) -> DataFrame:
    made = evidence.boy_tie_out(*_base(spark, d, "lines", "filed", "fx"))
    return made.select("entity_id", "target", F.col("ties"))


def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    return evidence.duplicate_documents(*_base(spark, d, "values"), least=3)


def carry_sign_offs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.carry_sign_offs(*_base(spark, d, "items", "earlier"))


def unpivot_rate_sheet(spark: SparkSession, d: str) -> DataFrame:
    return evidence.unpivot_rate_sheet(*_base(spark, d, "sheet"), "c_custkey", {"y2023": 2023, "y2024": 2024})


def build_writes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.build_writes(*_base(spark, d, "facts", "schedules"))


_QUERIES = (doc_kind, statement_year, caption_evidence, evidence_stats, boy_tie_out, duplicate_documents, carry_sign_offs, unpivot_rate_sheet, build_writes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    b = {k: f"({v})" for k, v in _BASE.items()}
    usd = "floor(CASE WHEN rate > 0 THEN boy / rate END + 0.5)"
    return {
        "doc_kind": f"SELECT doc_id, CASE WHEN bool_or(kind = 'return') THEN 'return' WHEN bool_or(kind = 'statement') THEN 'statement' WHEN bool_or(kind = 'terms') THEN 'terms' ELSE 'unknown' END AS kind, round(avg(CASE WHEN kind <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM {b['kinds']} GROUP BY 1",
        "statement_year": f"SELECT doc_id, year, CAST(votes AS BIGINT) AS votes FROM (SELECT doc_id, year, sum(weight) AS votes, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, min(pos)) AS n FROM {b['votes']} WHERE year BETWEEN 2000 AND 2035 GROUP BY 1, 2) WHERE n = 1",
        "caption_evidence": f"SELECT entity_id, target, label, arg_max(v, year) AS current, string_agg(CAST(v AS VARCHAR) || ' (' || CAST(year AS VARCHAR) || ')', ' · ' ORDER BY year DESC) AS display FROM (SELECT entity_id, target, label, year, CAST(round(sum(value)) AS BIGINT) AS v FROM {b['sales']} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
        "evidence_stats": f"SELECT entity_id, count(*) AS captions, count(*) FILTER (WHERE lang <> 'en') AS foreign, count(*) FILTER (WHERE bound) AS bound, CAST(floor(100.0 * count(*) FILTER (WHERE bound) / count(*) + 0.5) AS BIGINT) AS percent FROM {b['texts']} GROUP BY 1".replace("AS foreign", 'AS "foreign"'),
        "boy_tie_out": f"SELECT entity_id, target, abs({usd} - filed) <= 1 AS ties FROM {b['lines']} JOIN {b['filed']} USING (entity_id, target) LEFT JOIN {b['fx']} USING (entity_id)",
        "duplicate_documents": f"WITH s AS (SELECT DISTINCT * FROM {b['values']}), n AS (SELECT entity_id, doc_id, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3), p AS (SELECT x.entity_id, x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.entity_id = y.entity_id AND x.value = y.value AND x.doc_id < y.doc_id GROUP BY 1, 2, 3) SELECT p.* FROM p JOIN n u ON p.entity_id = u.entity_id AND a = u.doc_id JOIN n v ON p.entity_id = v.entity_id AND b = v.doc_id WHERE shared >= 0.8 * (u.n + v.n - shared) OR shared >= 0.9 * least(u.n, v.n)",
        "carry_sign_offs": f"SELECT i.entity_id, i.id, coalesce(e.edited, i.value) AS value, coalesce(e.dismissed, false) AS dismissed FROM {b['items']} i LEFT JOIN {b['earlier']} e USING (entity_id, id)",
        "unpivot_rate_sheet": "SELECT c_custkey AS code, 2023 AS year, c_acctbal AS rate FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 2024, c_acctbal - 5000 FROM customer WHERE c_acctbal > 5000",
        "build_writes": f"SELECT sheet, ref, coalesce(CASE WHEN value <> '' THEN value END, add, value) AS value FROM (SELECT sheet, ref, arg_max(value, ord) AS value FROM {b['facts']} GROUP BY 1, 2) FULL JOIN (SELECT sheet, ref, arg_min(value, ord) AS add FROM {b['schedules']} GROUP BY 1, 2) USING (sheet, ref)",
    }
