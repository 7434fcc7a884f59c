"""Queries of facts on filed forms: each order is printed as a face page with its holders, in layouts that vary by key, with SQL
from the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import filings
from tallyloom.session import table

_PERIODS, _FACTS = 8, 6


def _row(n: int, *cells: tuple[float, Column | str]) -> Column:
    given = [F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 40)).alias("x1")) for x, t in cells]
    return F.struct(F.lit(n).alias("row"), F.array(*given).alias("cells"))


def _case(selector: Column, *choices: Column) -> Column:
    out = choices[-1]
    for i, c in reversed(list(enumerate(choices[:-1]))):
        out = F.when(selector == i, c).otherwise(out)
    return out


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey with its dates as printed, place and code."""
    day = F.col("o_orderdate")
    fmt = lambda p: F.date_format(day, p)
    # orders are dealt by document while they are short: pages are printed and read by as many tasks as there are, whatever file they come from
    dealt = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("cust"), "o_orderdate").repartition("doc_id")
    return dealt.select(
        "doc_id", "cust", fmt("MM-dd-yyyy").alias("dash"), fmt("MM/dd/yyyy").alias("slash"), F.upper(fmt("MMM d")).alias("named"), fmt("yyyy").alias("year"), fmt("MM").alias("mm"), fmt("dd").alias("dd"), fmt("MM/dd/yy").alias("short"),
    )


def _periods(spark: SparkSession, d: str) -> DataFrame:
    """The period's caption and dates in one row, over several, split and glued, by name, with an end only, too late, impossible."""
    o, v = _orders(spark, d), F.col("doc_id") % _PERIODS
    cat, caption = F.concat, F.lit("G Annual accounting period of corporation")
    rows = _case(
        v,
        F.array(_row(0, (10, caption), (90, cat(F.lit("beginning "), F.col("dash"), F.lit(", and ending "), F.col("dash"))))),
        F.array(_row(0, (10, caption)), _row(1, (10, "of the"), (30, cat(F.lit("filer beginning "), F.col("slash")))), _row(2, (10, "and")), _row(3, (10, cat(F.lit("ending "), F.col("mm"), F.lit(" - "), F.col("dd"), F.lit(" , "), F.substring("year", 1, 2), F.lit(" "), F.substring("year", 3, 2))))),
        F.array(_row(0, (10, caption)), _row(2, (10, cat(F.lit("beginning "), F.col("named"), F.lit(", "), F.col("year"), F.lit(" ending "), F.col("named"), F.lit(" "), F.col("year"))))),
        F.array(_row(0, (10, caption)), _row(1, (10, cat(F.lit("ending "), F.col("mm"), F.lit("/"), F.col("dd"), F.lit(", "), F.col("year"))))),
        F.array(*(_row(i, (10, "x" if i else caption)) for i in range(5)), _row(5, (10, cat(F.lit("beginning "), F.col("dash"), F.lit(" ending "), F.col("dash"))))),
        F.array(_row(0, (10, caption)), _row(1, (10, cat(F.lit("Filer's tax year beginning "), F.col("dash"), F.lit(" and ending "), F.col("dash"))))),
        F.array(_row(0, (10, caption), (90, cat(F.lit("beginning 13-01-2020 ending "), F.col("dash"))))),
        F.array(_row(0, (10, "nothing is said")), _row(1, (10, F.col("slash")))),
    )
    return o.select("doc_id", F.lit(1).alias("page"), F.inline(rows))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """Pages (doc_id, page, rows): a face with two columns of captions; what stands below them moves, wraps and is glued by the order's key."""
    o, v = _orders(spark, d), F.col("doc_id") % _FACTS
    cat = F.concat
    name, key = cat(F.lit("Company "), F.col("cust").cast("string")), F.col("doc_id").cast("string")
    code = F.lpad(cat((F.col("doc_id") % 9000).cast("string"), F.lit("11")), 6, "4")
    captions = lambda n: _row(n, (20, "d Date of incorporation"), (150, "e Principal place of business"), (280, "f Principal business activity code"), (380, "g Principal business activity"), (480, "h Functional currency code"))
    facts = _case(
        v,
        F.array(captions(20), _row(21, (22, F.col("slash")), (148, "CAYMAN ISLANDS"), (290, code), (381, "Retail trade"), (490, "KYD"))),
        F.array(captions(20), _row(21, (22, cat(F.col("short"), F.lit(" GRAND CAYMAN"))), (300, cat(F.lit("code number "), code))), _row(22, (375, "Mining"), (468, "AUD"))),
        F.array(captions(20), _row(21, (22, F.col("dash")), (139, "SYDNEY"), (285, "number")), _row(22, (140, "NSW"), (290, code), (370, "Farming"), (470, "usd"), (500, "NZD")), _row(23, (20, "2 Provide the following")), _row(24, (20, "1/1/2001"), (480, "GBP"))),
        F.array(captions(20), _row(21, (150, "PERTH"), (480, "CHF")), captions(30), _row(31, (25, F.col("slash")), (290, code)), captions(40), _row(41, (25, "1/1/2001"), (150, "LATE"))),
        F.array(_row(20, (20, "Date of incorporation")), _row(21, (20, "text")), _row(22, (20, F.col("dash")), (90, "Trading"), (150, "SGD"))),
        F.array(_row(20, (20, "functional currency")), _row(21, (20, F.col("dash")))),
    )
    top = F.array(
        _row(0, (10, "Form 5471")),
        _row(1, (20, "1a Name and address of foreign corporation"), (300, "b(1) Employer identification number")),
        _row(2, (20, name), (300, "98-1234567")),
        _row(3, (20, cat(F.lit("AB"), key, F.lit(" b(3) Previous reference ID number"))), (300, "b(2) Reference ID number")),
        _row(4, (20, cat(key, F.lit(" Main Street"))), (300, cat(F.lit("XY"), key))),
        _row(5, (20, name), (300, "c Country under whose laws incorporated")),
        _row(6, (20, "Some Town"), (300, "Cayman Islands")),
        _row(7, (20, "Not part of it")),
        _row(8, (10, "Category of filer (see instructions)")),
        _row(9, (10, F.when(v < 3, F.lit("1a X 1b 1c 2 3 4")).otherwise(F.lit("1a 1b"))), (200, F.when(v < 4, F.lit("✓ 5a x 5b 5c")).otherwise(F.lit("5b")))),
        _row(10, (10, "Percentage of the foreign corporation's voting")),
        _row(11, (10, F.when(v == 4, F.lit("none")).otherwise(cat(F.lit("stock is "), (F.col("doc_id") % 100).cast("string"), F.lit(".5 %"))))),
        _row(12, (10, "Ordinary Shares"), (200, cat((F.col("doc_id") % 50).cast("string"), F.lit(".000"))), (260, "1,200")),
    )
    return o.select("doc_id", F.lit(1).alias("page"), F.concat(top, facts).alias("rows"))


_HELD = """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS n, l_partkey, l_suppkey, l_quantity, CAST(l_suppkey % 7 AS INT) AS v,
 CASE WHEN l_suppkey % 3 = 0 THEN 'COMMON' WHEN l_suppkey % 3 = 1 THEN 'Ordinary shares' ELSE 'Class A Shares' END AS class FROM lineitem"""


def _holders(spark: SparkSession, d: str) -> DataFrame:
    """Holder rows by line item: name or identifier first, counts apart, glued or one only, rows that are none, a section's end."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    held = spark.sql(_HELD)
    name, q = F.concat(F.lit("Holder "), F.substring(F.lit("ABCDEFGHIJ"), (F.col("l_partkey") % 10 + 1).cast("int"), F.lit(3))), F.format_string("%.3f", "l_quantity")
    at = lambda n: F.col("n") * 2 + 10 + n
    row = lambda k, *cells: F.struct(at(k).alias("row"), F.array(*(F.struct(c.alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1")) for c in cells)).alias("cells"))
    body = _case(
        F.col("v"),
        F.array(row(0, name, F.col("class"), q, F.lit("7.000"))),
        F.array(row(0, F.upper(name), F.col("class"), F.concat(q, F.lit("12.000")))),
        F.array(row(0, F.lit("87-1188632"), F.lit("US"), F.col("class"), F.concat(q, F.lit(" 5.000"))), row(1, name, F.lit("an address"))),
        F.array(row(0, name, F.col("class"), q)),
        F.array(row(0, name, F.lit("nothing"), q, q)),
        F.array(row(0, F.lit("(a) Name, address"), F.col("class"), q, q)),
        F.array(row(0, F.lit("US"), F.col("class"), q, q), row(1, F.lit("Instructions"))),
    )
    lines = held.select("doc_id", F.lit(1).alias("page"), F.inline(body))
    ends = held.groupBy("doc_id").agg(F.max("n").alias("n"))
    first = ends.select("doc_id", F.lit(1).alias("page"), F.inline(F.array(_row(1, (0, "Early Bird"), (0, "Common"), (0, "1 2")), _row(5, (0, "Part II of Schedule B: Direct Shareholders")), _row(6, (0, "entered in Schedule A, column (a)")))))
    last = ends.select("doc_id", F.lit(1).alias("page"), F.inline(F.array(row(2, F.lit("Part III")), row(3, F.lit("Late Bird"), F.lit("Common"), F.lit("1.000"), F.lit("1.000")))))
    return lines.unionByName(first).unionByName(last)


def parse_accounting_period(spark: SparkSession, d: str) -> DataFrame:
    return filings.parse_accounting_period(_periods(spark, d)).select("doc_id", F.col("begin").alias("period_begin"), F.col("end").alias("period_end"))


def face_fields(spark: SparkSession, d: str) -> DataFrame:
    f = filings.face_fields(_faces(spark, d))
    return f.select("doc_id", "name", F.array_join("address", "|").alias("address"), "country", "formed", "place", "activity_code", "activity", "currency", "pct_voting", F.array_join("categories", "|").alias("categories"), F.col("shares.class").alias("share_class"), F.col("shares.boy").alias("boy"), F.col("shares.eoy").alias("eoy"))


def shareholder_rows(spark: SparkSession, d: str) -> DataFrame:
    return filings.shareholder_rows(_holders(spark, d)).withColumnRenamed("class", "share_class")


def reference_ids(spark: SparkSession, d: str) -> DataFrame:
    return filings.reference_ids(_faces(spark, d).select("doc_id", "page", F.inline("rows"))).select("doc_id", F.array_join("ids", "|").alias("ids"))


def match_form_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a balance sheet, a part of the order's rows: the caption with its number, glued or apart, and two amounts."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    held = spark.sql(_LINES)
    price = F.format_number("l_extendedprice", 2)
    label = F.element_at(F.array(*(F.lit(x) for x in ("Cash", "Trade notes and accounts receivable", "Total assets", "Other"))), F.col("kind") + 1)
    number = (F.col("kind") + 2).cast("string")
    cell = lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"))
    cells = _case(F.col("v"), F.array(cell(F.concat(number, F.lit("a "), label)), cell(number), cell(price), cell(F.lit("(1,000)"))), F.array(cell(number), cell(label), cell(F.lit("combine lines 7 through 13")), cell(price)), F.array(cell(label), cell(F.lit("no amount"))))
    rows = held.select("doc_id", F.lit(1).alias("page"), F.col("n").alias("row"), cells.alias("cells"))
    return filings.match_form_lines(rows, [("cash", "(?i)^cash$", "last"), ("receivable", "(?i)^trade notes and accounts receivable", "first"), ("assets", "(?i)^total assets", "last")])


_LINES = """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS n, l_extendedprice, CAST(l_partkey % 4 AS INT) AS kind, CAST(l_suppkey % 3 AS INT) AS v FROM lineitem"""

_QUERIES = (parse_accounting_period, face_fields, shareholder_rows, reference_ids, match_form_lines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_PERIOD = f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % {_PERIODS} < 3 THEN strftime(o_orderdate, '%m/%d/%Y') END AS period_begin, strftime(o_orderdate, '%m/%d/%Y') AS period_end
FROM orders WHERE o_orderkey % {_PERIODS} IN (0, 1, 2, 3, 6)
"""
_FACE = f"""
WITH o AS (SELECT *, o_orderkey % {_FACTS} AS v, lpad(CAST(o_orderkey % 9000 AS VARCHAR) || '11', 6, '4') AS code FROM orders)
SELECT o_orderkey AS doc_id, 'Company ' || o_custkey AS name, o_orderkey || ' Main Street|Some Town' AS address, 'Some Town' AS country,
       CASE v WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') END AS formed,
       CASE v WHEN 0 THEN 'CAYMAN ISLANDS' WHEN 1 THEN 'GRAND CAYMAN' WHEN 2 THEN 'SYDNEY NSW' WHEN 3 THEN 'PERTH' END AS place,
       CASE WHEN v < 4 THEN code END AS activity_code, CASE v WHEN 0 THEN 'Retail trade' WHEN 1 THEN 'Mining' WHEN 2 THEN 'Farming' WHEN 4 THEN 'Trading' END AS activity,
       CASE v WHEN 0 THEN 'KYD' WHEN 1 THEN 'AUD' WHEN 2 THEN 'NZD' WHEN 3 THEN 'CHF' WHEN 4 THEN 'SGD' END AS currency,
       CASE WHEN v <> 4 THEN o_orderkey % 100 + 0.5 END AS pct_voting, CASE WHEN v < 3 THEN '1a|4|5a' WHEN v < 4 THEN '1b|5a' END AS categories, 'Ordinary Shares' AS share_class, CAST(o_orderkey % 50 AS DOUBLE) AS boy, 1200.0 AS eoy
FROM o
"""
_SHAREHOLDERS = f"""
WITH h AS (SELECT *, 'Holder ' || substr('ABCDEFGHIJ', CAST(l_partkey % 10 AS INT) + 1, 3) AS name FROM ({_HELD}) t WHERE v < 4 AND n * 2 + 10 < 5000),
k AS (SELECT *, CASE WHEN v = 1 THEN upper(name) ELSE name END AS shown, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY n) AS r FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS place, 1 AS page, shown AS name, CASE WHEN class LIKE 'Class%' THEN 'Class A' WHEN class LIKE 'Ord%' THEN 'Ordinary' ELSE class END AS share_class,
       l_quantity AS boy, CASE v WHEN 0 THEN 7.0 WHEN 1 THEN 12.0 WHEN 2 THEN 5.0 ELSE l_quantity END AS eoy, v = 3 AS single
FROM k WHERE r = 1
"""
#: An id has four characters at least, but not where it stands before the next caption.
_IDS = "SELECT o_orderkey AS doc_id, 'AB' || o_orderkey || CASE WHEN o_orderkey >= 10 THEN '|XY' || o_orderkey ELSE '' END AS ids FROM orders"
_FORM_LINES = f"""
SELECT doc_id, CASE kind WHEN 0 THEN 'cash' WHEN 1 THEN 'receivable' ELSE 'assets' END AS key, 1 AS page, CASE WHEN v = 0 AND kind <> 1 THEN -1000.0 ELSE l_extendedprice END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) AS r FROM ({_LINES}) t WHERE v < 2 AND kind < 3) WHERE r = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"parse_accounting_period": _PERIOD, "face_fields": _FACE, "shareholder_rows": _SHAREHOLDERS, "reference_ids": _IDS, "match_form_lines": _FORM_LINES}
