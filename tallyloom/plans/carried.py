"""Queries of earlier filings and of particulars: customers as entities, their orders as filings, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import periods
from tallyloom.operators import carry, profile
from tallyloom.session import table

_NAME = "CASE {k} % 7 WHEN 0 THEN 'Alpha Mining Ltd' WHEN 1 THEN 'ALPHA Mining (Holdings)' WHEN 2 THEN 'Beta Mining Inc' WHEN 3 THEN 'Gamma Co.' WHEN 4 THEN NULL WHEN 5 THEN 'Delta Trading Company Corp' ELSE 'Trading Delta' END"
_FILINGS = f"SELECT o_custkey AS entity_id, o_orderkey AS ord, {_NAME.format(k='CAST(floor(o_orderkey / 2) AS BIGINT)')} AS name, o_orderkey % 9 AS i, CAST(o_orderkey % 5 AS INT) AS pages, CAST(year(o_orderdate) AS INT) AS year FROM orders"
_ENTITIES = f"SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 > 0 THEN {_NAME.format(k='c_custkey')} END AS known_name, CASE WHEN c_custkey % 4 > 0 THEN 1999 END AS cy FROM customer"
_EXISTING = f"SELECT c_nationkey AS owner_id, {_NAME.format(k='c_custkey')} AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('R', c_custkey % 40) ELSE '' END AS ref_id FROM customer WHERE c_acctbal > 8000"
#: Particulars as they are, faces of earlier filings, and what documents say.
_PROFILE = "SELECT c_custkey AS entity_id, bucket, key, CASE WHEN c_custkey % m = 0 THEN concat('typed ', key) ELSE '' END AS value FROM customer JOIN (VALUES ('profile', 'legalName', 3), ('profile', 'currency', 4), ('profile', 'cyEnd', 7), ('ownership', 'cfc', 5), ('profile', 'note', 2)) p(bucket, key, m) ON true"
_FACES = "SELECT o_custkey AS entity_id, concat('return ', o_orderkey) AS source, CASE o_orderkey % 4 WHEN 0 THEN concat('6/30/', year(o_orderdate)) WHEN 1 THEN concat('12/31/', year(o_orderdate)) WHEN 2 THEN 'unread' END AS period_end, concat('Name ', o_orderkey) AS name, o_orderpriority AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'AUD' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN 7.5D WHEN 1 THEN 40D END AS pct, CAST(year(o_orderdate) AS INT) AS y, o_orderkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) t WHERE n = 1"
_FOUND = "SELECT o_custkey AS entity_id, 'profile' AS bucket, CASE o_orderkey % 3 WHEN 0 THEN 'countryInc' WHEN 1 THEN 'phone' ELSE 'legalName' END AS key, concat('said ', o_orderkey % 4) AS value, concat('doc ', o_orderkey % 6) AS source, o_orderkey AS ord FROM orders"
_SNIFFED = "SELECT o_custkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'NZD' END AS value, 'seen' AS source, o_orderkey AS ord FROM orders"
_YEARS = "SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 5 > 0 THEN 1998 END AS cy, CASE WHEN c_custkey % 5 > 1 THEN 1997 END AS py FROM customer"


def _base(spark: SparkSession, d: str) -> None:
    for x in ("orders", "customer"):
        table(spark, d, x).createOrReplaceTempView(x)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    _base(spark, d)
    filings = spark.sql(_FILINGS).withColumn("ref_ids", F.when(F.col("i") < 3, F.array(F.concat(F.lit("R"), F.col("i").cast("string")), F.lit("X"))).when(F.col("i") == 3, F.array(F.lit("R3"))).otherwise(F.array().cast("array<string>"))).drop("i")
    return carry.dedupe_carry_forward(filings)


def dedupe_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("entity_id", "ord", "place")


def _selected(spark: SparkSession, d: str) -> carry.Selected:
    kept = _kept(spark, d)
    return carry.select_carry_forward(kept, spark.sql(_ENTITIES))


def select_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The chosen filing, the siblings and what is to be looked at, each under its role."""
    s = _selected(spark, d)
    rows = s.chosen.select("entity_id", "ord", F.lit("chosen").alias("role")).unionByName(s.siblings.select("entity_id", "ord", F.lit("sibling").alias("role")))
    return rows.unionByName(s.review.select("entity_id", "ord", F.col("kind").alias("role")))


def sibling_entities(spark: SparkSession, d: str) -> DataFrame:
    siblings = _selected(spark, d).siblings.join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("owner_id")), "entity_id")
    return carry.sibling_entities(siblings, spark.sql(_EXISTING)).select("owner_id", "entity_id", "ord")


def _filled(spark: SparkSession, d: str) -> profile.Filled:
    _base(spark, d)
    none = F.lit(None).cast("string")
    faces = spark.sql(_FACES).select("entity_id", "source", "period_end", "name", "country", "currency", F.col("pct").alias("pct_voting"), *(none.alias(c) for c in ("addr1", "addr2", "addr3", "formed", "activity", "ref_id", "place", "activity_code")))
    return profile.propose_profile(*(spark.sql(x) if isinstance(x, str) else x for x in (_PROFILE, _YEARS, faces, _FOUND, _SNIFFED)))


def propose_profile(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    return f.profile.join(f.provenance.select("entity_id", "bucket", "key", "source"), ["entity_id", "bucket", "key"], "left")


def propose_profile_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).disagreements


def period_ends(spark: SparkSession, d: str) -> DataFrame:
    """Months, short forms, the next year's end and days between ends as typed on forms."""
    _base(spark, d)
    typed = F.when(F.col("o_orderkey") % 5 == 4, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "M-d-yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", typed.alias("p"))
    p, after = F.col("p"), periods.period_plus_one_year(F.col("p"))
    return rows.select("o_orderkey", periods.month_from_period(p).alias("month"), periods.is_fiscal(p).alias("fiscal"), periods.short_period(p).alias("short"), after.alias("next_end"), periods.days_between_periods(p, after).alias("days"), periods.days_between_periods(p, p).alias("none"))


_QUERIES = (dedupe_carry_forward, select_carry_forward, sibling_entities, propose_profile, propose_profile_disagreements, period_ends)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_WORDS = "list_filter(list_distinct(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+')), lambda w: NOT list_contains(['pty', 'ltd', 'limited', 'inc', 'llc', 'corp', 'corporation', 'co', 'gmbh', 'plc', 'the', ''], w))"
_LIKE = "(len({a}) > 0 AND len({b}) > 0 AND 2 * len(list_intersect({a}, {b})) >= least(len({a}), len({b})))"
_KEPT = f"""
WITH RECURSIVE f AS (
  SELECT *, {_WORDS.format(c='name')} AS words, CASE WHEN i < 3 THEN ['R' || i, 'X'] WHEN i = 3 THEN ['R3'] ELSE CAST([] AS VARCHAR[]) END AS ids, row_number() OVER (PARTITION BY entity_id ORDER BY ord) AS n FROM ({_FILINGS})),
fold AS (
  SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ord BIGINT, words VARCHAR[], ids VARCHAR[], pages INTEGER)[]) AS kept FROM f
  UNION ALL
  SELECT g.entity_id, g.n, CASE WHEN g.at IS NULL OR g.at = 0 THEN list_append(g.kept, g.c) WHEN g.c.pages > g.kept[g.at].pages THEN list_concat(g.kept[: g.at - 1], [g.c], g.kept[g.at + 1 :]) ELSE g.kept END
  FROM (
    SELECT f.entity_id, f.n, kept, {{'ord': f.ord, 'words': f.words, 'ids': f.ids, 'pages': f.pages}} AS c,
           list_position(list_transform(kept, lambda k: len(list_intersect(k.ids, f.ids)) > 0 OR {_LIKE.format(a='k.words', b='f.words')}), true) AS at
    FROM fold JOIN f ON f.entity_id = fold.entity_id AND f.n = fold.n + 1) g),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1),
places AS (SELECT entity_id, unnest(range(len(kept))) AS place, unnest(list_transform(kept, lambda k: k.ord)) AS ord FROM last),
k AS (SELECT f.*, place FROM f LEFT JOIN places USING (entity_id, ord)),
e AS (SELECT *, {_WORDS.format(c='known_name')} AS kw FROM ({_ENTITIES})),
m AS (SELECT k.*, e.known_name, e.cy, {_LIKE.format(a='words', b='kw')} AS alike, len(list_intersect(words, kw)) / nullif(least(len(words), len(kw)), 0) AS sim FROM k JOIN e USING (entity_id) WHERE place IS NOT NULL),
best AS (
  SELECT entity_id, coalesce(first(place ORDER BY sim DESC, place) FILTER (known_name IS NOT NULL AND alike), min(place) FILTER (known_name IS NOT NULL AND name IS NULL), min(place) FILTER (known_name IS NULL)) AS best FROM m GROUP BY 1),
j AS (SELECT m.*, best, coalesce(place = best, false) AS chosen FROM m JOIN best USING (entity_id)),
roles AS (
  SELECT entity_id, ord, 'chosen' AS role FROM j WHERE chosen UNION ALL SELECT entity_id, ord, 'sibling' FROM j WHERE NOT chosen AND name IS NOT NULL
  UNION ALL SELECT entity_id, ord, CASE WHEN chosen THEN 'older year' WHEN best IS NULL THEN 'other entity' ELSE 'without name' END FROM j WHERE (chosen AND year < cy - 1) OR (NOT chosen AND (best IS NULL OR name IS NULL)))
"""
_SIBLINGS = f"""
SELECT c.c_nationkey AS owner_id, j.entity_id, j.ord FROM j JOIN customer c ON c.c_custkey = j.entity_id
WHERE NOT chosen AND name IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT *, {_WORDS.format(c='name')} AS theirs FROM ({_EXISTING})) x WHERE x.owner_id = c.c_nationkey AND (list_contains(j.ids, nullif(x.ref_id, '')) OR {_LIKE.format(a='j.words', b='x.theirs')}))
"""
_FILL = f"""
WITH y AS (SELECT * FROM ({_YEARS})), f AS (SELECT * FROM ({_FACES.replace('7.5D', '7.5').replace('40D', '40.0')})),
b AS (SELECT y.*, f.* EXCLUDE (entity_id), f.k IS NOT NULL AS has, period_end LIKE '6/%' AS fiscal, period_end LIKE '12/%' AS calendar FROM y LEFT JOIN f USING (entity_id)),
p AS (
  SELECT entity_id, 'cyEnd' AS key, '06/30/' || right(CAST(b.y + 1 AS VARCHAR), 2) AS value, source || ' · annual accounting period' AS source, 1 AS rank FROM b WHERE fiscal AND (cy IS NULL OR b.y + 1 = cy)
  UNION ALL SELECT entity_id, 'pyEnd', '06/30/' || right(CAST(b.y AS VARCHAR), 2), source || ' · annual accounting period', 1 FROM b WHERE fiscal AND (cy IS NULL OR b.y + 1 = cy)
  UNION ALL SELECT entity_id, 'cyEnd', '12/31/98', 'statement year', 2 FROM b WHERE cy IS NOT NULL UNION ALL SELECT entity_id, 'pyEnd', '12/31/97', 'statement year', 2 FROM b WHERE py IS NOT NULL
  UNION ALL SELECT entity_id, 'cyEnd', '12/31/' || right(CAST(b.y + 1 AS VARCHAR), 2), source || ' · annual accounting period', 3 FROM b WHERE calendar
  UNION ALL SELECT entity_id, 'pyEnd', '12/31/' || right(CAST(b.y AS VARCHAR), 2), source || ' · annual accounting period', 3 FROM b WHERE calendar),
given AS (SELECT * FROM ({_PROFILE})),
ends AS (
  SELECT y.entity_id, coalesce((SELECT value FROM given g WHERE g.entity_id = y.entity_id AND key = 'cyEnd' AND value <> ''), (SELECT value FROM p WHERE p.entity_id = y.entity_id AND key = 'cyEnd' ORDER BY rank LIMIT 1)) AS cy_end,
         (SELECT value FROM p WHERE p.entity_id = y.entity_id AND key = 'pyEnd' ORDER BY rank LIMIT 1) AS py_end FROM y),
days AS (
  SELECT b.*, CASE WHEN fiscal AND cy_end NOT LIKE 'typed%' AND py_end IS NOT NULL THEN date_diff('day', CAST(strptime('20' || right(py_end, 2) || '/' || left(py_end, 5), '%Y/%m/%d') AS DATE), CAST(strptime('20' || right(cy_end, 2) || '/' || left(cy_end, 5), '%Y/%m/%d') AS DATE)) END AS fd
  FROM b JOIN ends USING (entity_id)),
d AS (SELECT *, CASE WHEN fd > 0 AND fd < 400 THEN fd END AS fdays FROM days WHERE has),
pct AS (SELECT *, CASE WHEN pct = 40 THEN '40' WHEN pct = 7.5 THEN '7.5' END AS shown FROM d),
q AS (
  SELECT entity_id, 'profile' AS bucket, key, value, source, rank, 0 AS ord FROM p
  UNION ALL SELECT entity_id, 'profile', 'legalName', name, source || ' · 5471 face', 10, 0 FROM d UNION ALL SELECT entity_id, 'profile', 'countryInc', country, source || ' · 5471 face', 10, 0 FROM d
  UNION ALL SELECT entity_id, 'profile', 'currency', currency, source || ' · 5471 face', 10, 0 FROM d UNION ALL SELECT entity_id, 'ownership', 'ownStart', shown, source || ' · 5471 face', 10, 0 FROM pct UNION ALL SELECT entity_id, 'ownership', 'ownEnd', shown, source || ' · 5471 face', 10, 0 FROM pct
  UNION ALL SELECT entity_id, 'ownership', 'cfc', 'Yes', source || ' · prior-year filing', 10, 0 FROM d
  UNION ALL SELECT entity_id, 'ownership', 'tenPct', 'Yes', CASE WHEN shown IS NULL THEN source || ' · prior-year filing' ELSE source || ' · ' || shown || '% voting per prior filing' END, 10, 0 FROM pct WHERE shown IS DISTINCT FROM '7.5'
  UNION ALL SELECT entity_id, 'ownership', 'daysCfc', CAST(coalesce(fdays, CASE WHEN cy IS NOT NULL THEN 365 END) AS VARCHAR), CASE WHEN fdays IS NULL THEN 'full-year CFC' ELSE 'full fiscal-year CFC' END, 10, 0 FROM d
  UNION ALL SELECT entity_id, 'ownership', 'daysOwned', CAST(coalesce(fdays, CASE WHEN cy IS NOT NULL THEN 365 END) AS VARCHAR), CASE WHEN fdays IS NULL THEN 'full-year ownership' ELSE 'full fiscal-year ownership' END, 10, 0 FROM d
  UNION ALL SELECT entity_id, bucket, key, value, source, 100, ord FROM ({_FOUND}) UNION ALL SELECT entity_id, 'profile', 'currency', value, source, 1000, ord FROM ({_SNIFFED})),
v AS (SELECT entity_id, bucket, key, value, min(CAST(rank AS BIGINT) * 100000000 + ord) AS first, first(source ORDER BY rank, ord, source) AS source, count(DISTINCT source) AS sources FROM q WHERE value <> '' GROUP BY 1, 2, 3, 4),
won AS (
  SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.entity_id = v.entity_id AND g.bucket = v.bucket AND g.key = v.key AND g.value <> '') QUALIFY row_number() OVER (PARTITION BY entity_id, bucket, key ORDER BY first, value) = 1)
"""


def oracle_sql() -> dict[str, str]:
    typed = "CASE WHEN o_orderkey % 5 < 4 THEN {x} END"
    return {
        "dedupe_carry_forward": _KEPT + "SELECT entity_id, ord, place FROM k",
        "select_carry_forward": _KEPT + "SELECT * FROM roles",
        "sibling_entities": _KEPT + _SIBLINGS,
        "propose_profile": _FILL + "SELECT coalesce(g.entity_id, w.entity_id) AS entity_id, coalesce(g.bucket, w.bucket) AS bucket, coalesce(g.key, w.key) AS key, coalesce(nullif(g.value, ''), w.value, g.value) AS value, w.source FROM given g FULL JOIN won w ON g.entity_id = w.entity_id AND g.bucket = w.bucket AND g.key = w.key",
        "propose_profile_disagreements": _FILL + "SELECT v.entity_id, v.bucket, v.key, v.value, v.sources FROM v JOIN won w ON w.entity_id = v.entity_id AND w.bucket = v.bucket AND w.key = v.key WHERE w.value <> v.value",
        "period_ends": "SELECT o_orderkey, " + typed.format(x="month(o_orderdate)") + " AS month, coalesce(" + typed.format(x="month(o_orderdate) <> 12") + ", false) AS fiscal, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%m/%d/%y') ELSE 'n/a' END AS short, " + typed.format(x="month(o_orderdate) || '/' || day(o_orderdate) || '/' || (year(o_orderdate) + 1)") + " AS next_end, " + typed.format(x="date_diff('day', CAST(o_orderdate AS DATE), CAST(make_date(year(o_orderdate) + 1, month(o_orderdate), 1) AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER))") + " AS days, CAST(NULL AS INTEGER) AS none FROM orders",
    }
