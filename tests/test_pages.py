"""Pages that come whole: their rows aren't put together again, and rules are tried where they can hold only."""

import inspect
import re

from pyspark.sql import functions as F

from tallyloom.functions.scalars import parse_number, strict_number
from tallyloom.operators import classify, filings, rows
from tallyloom.plans import filed, papers, printed

#: A text for each alternative of a rule's pattern.
SAID = [
    "form 5472", "form8992", "(form 8992)", "federal supporting statements", "accumulated earnings profits", "accumulated earnings & profits", "transactions between controlled foreign corporation",
    "income, war profits, and excess profits taxes", "current earnings and profits", "previously taxed earnings and profits", "distributions from a foreign corporation", "organization or reorganization of foreign corporation",
    "information return of us persons", "information return of u.s. persons", "schedule c\nx income statement", "income statement schedule c", "schedule f\nbalance sheet", "balance sheet schedule f", "schedule i", "summary of shareholder",
    "schedule b", "us shareholders of foreign corporation", "schedule a", "stock of the foreign corporation", "form 1120", "(form 1120)", "u.s. corporation income tax return", "form 851", "form 1125-e", "form 1125e", "form 7004", "form 4562",
    "company tax return 2023", "franking account", "dividend and interest schedule", "calculation statement", "contents", "director statement", "directors' report", "directors report", "director's", "accountants' report", "accountant' report", "compilation report",
    "independent auditor", "accounting policies", "notes to the accounts", "notes to the financial statements", "trading account", "statement of financial position", "balance sheet", "statement of changes in equity", "opening retained profits",
    "opening retained earnings", "retained earnings at the start", "retained profits at the beginning", "movement in equity", "movements in equity", "statement of financial performance", "profit and loss", "profit or loss", "profit & loss",
    "income statement", "statement of comprehensive income", "notes to x", "financial statements", "balance sheet - 2023", "statement of activity", "profit & loss - 2023", "terms and conditions", "terms&conditions", "letter of engagement", "engagement terms",
    "abn", "acn", "a.b.n.", "a. b. n", "company no. 1", "company number", "company registration", "registered office", "registered number", "companies house",
]


def test_words_of_rules_stand_in_every_match():
    rules = [(r[2], r[5]) for r in classify.PAGE_RULES if r[2]] + [(classify.BAND_HEAD, classify.BAND_WORDS)]
    for pattern, words in rules:
        met = [t for t in SAID if re.search(pattern, t, re.A)]
        assert met and words, pattern
        assert all(any(w in t for w in words) for t in met), pattern


def test_whole_pages_are_judged_as_rows(spark):
    pages = papers._printed(spark, "/root/testdata/sf0.001")
    want = classify.classify_pages(pages.select("doc_id", "page", F.inline("rows")))
    got = classify.classify_pages(pages)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_pages_stay_dealt_by_document(spark):
    plan = papers.classify_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan


def test_whole_faces_are_read_as_rows(spark):
    pages = filed._faces(spark, "/root/testdata/sf0.001")
    cells = "array<struct<text:string,x0:double,x1:double>>"
    bare = spark.createDataFrame([(-1, 1, 0, [("nothing", 0.0, 1.0)]), (-2, 2, 3, [("Stock you owned at the end", 0.0, 1.0)]), (-2, 2, 4, [("7 %", 0.0, 1.0)]), (-2, 1, 9, [("PERCENTAGE OF THE FOREIGN CORPORATION'S VOTING", 0.0, 1.0)]), (-2, 1, 12, [("5 %", 0.0, 1.0)])], f"doc_id long, page int, row int, cells {cells}")
    given = pages.select("doc_id", "page", F.inline("rows")).unionByName(bare)
    want = filings.face_fields(given).where("doc_id >= 0")
    got = filings.face_fields(pages)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    assert {r.doc_id: (r.pct_voting, r.name) for r in filings.face_fields(bare).collect()} == {-1: (None, None), -2: (5.0, None)}


def test_faces_are_read_in_their_own_arrays(spark):
    plan = filed.face_fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_plain_numbers_are_read_as_others(spark):
    said = ["12", "12.50", "1,234.50", "1,23.5", "1,,2.5", "0.000", "12,5", "1,234", "1.2.3", "12.", ".5", "", "7\n", None, "1,234.5CR", "(5.0)", "9" * 30 + ".25"]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", strict_number(F.col("t")).alias("a"), parse_number(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got), got


def test_grid_lines_are_dealt_by_order_once(spark):
    plan = printed.route_years(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L, (row|n)#", plan)


def test_tokens_and_cells_come_from_one_pass(spark):
    for made in (printed._tokens, printed._grid):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and plan.count("Join") == 2


def test_batches_without_lone_captions_are_handed_on(spark):
    """Captions that wrap from the end of one batch to the next still join, with batches handed on before and after."""
    full = [("Cash", 10.0, 50.0), ("7", 90.0, 99.0)]
    lines = [(1, 1, i, 900.0 - 20 * i, full) for i in range(6)] + [(1, 1, 6, 700.0, [("total of", 10.0, 50.0)]), (1, 1, 7, 690.0, [("cash", 10.0, 50.0), ("8", 90.0, 99.0)])] + [(1, 1, 8 + i, 600.0 - 20 * i, full) for i in range(5)]
    given = spark.createDataFrame(lines, f"doc_id long, page int, row int, y double, cells {rows.CELLS}")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "7", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = rows.merge_wrapped_labels(given).collect()
            assert [(r.row, r.cells[0].text) for r in got] == [(i, "Cash") for i in range(6)] + [(7, "total of cash")] + [(8 + i, "Cash") for i in range(5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "held" in inspect.signature(rows._walk).parameters


def test_clean_cells_are_left_alone(spark):
    said = ["Revenue", "a  b", " a", "a ", "x ... y", "x . . . y", "a__b", "Statement #12 a", "a\tb", "...", "1.5", "a.b.", "a . b", "", None, "\n"]
    want = {"Revenue": "Revenue", "a  b": "a b", " a": "a", "a ": "a", "x ... y": "x y", "x . . . y": "x y", "a__b": "a b", "Statement #12 a": "a", "a\tb": "a b", "...": "", "1.5": "1.5", "a.b.": "a.b.", "a . b": "a . b", "": "", None: None, "\n": ""}
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", rows.clean_cell_text(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == want
