"""Periods, columns under captions, holders and ids of printed forms, against plain versions and pinned cases."""

import random
import re

from pyspark.sql import functions as F

from tallyloom.operators import filings

CELLS = "array<struct<text:string,x0:double,x1:double>>"


def printed(spark, rows):
    """Rows of (doc, page, row, [(text, x0)])."""
    return spark.createDataFrame([(d, p, r, [(t, float(x), float(x) + 10) for t, x in cells]) for d, p, r, cells in rows], f"doc_id int, page int, row int, cells {CELLS}")


def plain_period(rows):
    """rows: (page, text) in order; the first complete parse in growing windows."""
    day, named = r"(\d{1,2})\s*[-/]\s*(\d{1,2})\s*[-/,]\s*((?:19|20)\s?\d{2})", r"([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,?\s*((?:19|20)\s?\d{2})"
    texts = []
    for i, (page, text) in enumerate(rows):
        if "annual accounting period" in text.lower():
            for k in range(5):
                if i + k < len(rows) and rows[i + k][0] == page:
                    texts.append(re.sub(r"(?is)filer'?s tax year.*$", "", " ".join(t for _, t in rows[i : i + k + 1])))
                else:
                    break

    def date(m, d, y):
        month = filings.MONTHS.index(m[:3].lower()) + 1 if not m.isdigit() and m[:3].lower() in filings.MONTHS else int(m) if m.isdigit() else 0
        y = int(re.sub(r"\s", "", y))
        return f"{month:02d}/{int(d):02d}/{y}" if 1 <= month <= 12 and 1 <= int(d) <= 31 and 1990 <= y <= 2100 else None

    for whole in (True, False):
        for t in texts:
            for one in (day, named):
                m = re.search((rf"(?i)annual accounting period[\s\S]{{0,240}}?beginning\s*{one}\s*,?\s*(?:and\s*)?" if whole else r"(?i)annual accounting period[\s\S]{0,240}?") + rf"ending\s*{one}", t)
                if m:
                    got = [date(*m.groups()[k : k + 3]) for k in range(0, len(m.groups()), 3)]
                    if None not in got:
                        return tuple(got) if whole else (None, got[0])
    return None


def test_periods_equal_a_plain_parser(spark):
    rng = random.Random(6)
    dates = ["01-02-2020", "13-01-2020", "1/2 , 20 21", "JAN 5, 2022", "Febtober 3 2021", "Mar. 7 2023", "12-40-2020", "5-6-1980"]
    docs, want = [], {}
    for doc in range(150):
        parts = [f"beginning {rng.choice(dates)}", rng.choice(["and ending", ", ending", "ending"]), rng.choice(dates)]
        if rng.random() < 0.3:
            parts = parts[1:]
        lines = [["G annual Accounting Period of it"]]
        for p in parts:
            (lines[-1].append(p) if rng.random() < 0.5 else lines.append([p]))
            if rng.random() < 0.3:
                lines.insert(rng.randint(1, len(lines)), [rng.choice(["x", "Filer's tax year beginning 01-01-2001, and ending 12-31-2001", "annual accounting period"])])
        rows = [(1 + (k > 5), " ".join(x)) for k, x in enumerate(lines)]
        docs += [(doc, p, k, [(t, 0)]) for k, (p, t) in enumerate(rows)]
        if (found := plain_period(rows)) is not None:
            want[doc] = found
    got = {r.doc_id: (r.begin, r.end) for r in filings.parse_accounting_period(printed(spark, docs)).collect()}
    assert got == want and 20 < len(want) < 140


def test_values_go_to_the_last_caption_not_right_of_them(spark):
    captions = F.array(*(F.struct(F.lit(float(x)).alias("x0"), F.lit(k).alias("key")) for x, k in ((10, "a"), (50, "b"), (50, "c"), (90, "d"))))
    rows = printed(spark, [(1, 1, 0, [("far left", -3), ("slack", -2), ("a", 37.5), ("tie", 38), ("c", 77), ("d", 78), ("right", 900)])])
    got = rows.select(filings.nearest_columns(captions, F.array("cells")).alias("v")).first().v
    assert [tuple(v) for v in got] == [("a", "slack"), ("a", "a"), ("c", "tie"), ("c", "c"), ("d", "d"), ("d", "right")]


def test_faces_of_several_forms(spark):
    caption = [("d Date of", 10), ("e Principal place of business", 100), ("h Functional currency code", 300)]
    rows = [
        (1, 1, 0, caption), (1, 1, 1, [("incorporation", 10), ("PLACE ONE", 100)]), (1, 1, 2, [("03-04-05 ISLE", 10), ("AUD", 305)]), (1, 1, 3, [("2 The next", 10), ("NZD", 300)]),
        (1, 1, 4, caption), (1, 1, 5, [("1/1/2001", 10), ("OTHER", 100)]),  # behind the first with a date
        (2, 1, 0, [*caption]), (2, 2, 1, [("1/1/2001", 10)]),  # on another page
        (3, 1, 0, [("1a Name and address of foreign corporation", 10), ("b(1)", 200)]), (3, 1, 1, [("BME01 b(3) Previous", 10)]), (3, 1, 2, [("The Name", 10)]), (3, 1, 3, [("right only", 195)]), (3, 1, 4, [("The Name", 10)]),
        (3, 1, 5, [("Street", 10), ("c Country under whose laws incorporated", 200)]), (3, 1, 6, [("Town", 10), ("Samoa", 200)]), (3, 1, 7, [("Not", 10)]),
        (4, 1, 0, [("nothing", 0)]),
    ]
    got = {r.doc_id: r for r in filings.face_fields(printed(spark, rows)).collect()}
    assert (got[1].formed, got[1].place, got[1].currency) == ("03/04/05", "PLACE ONE", "AUD")
    assert got[2].formed is None and got[4].name is None and got[4].categories is None
    assert (got[3].name, got[3].address, got[3].country) == ("The Name", ["Street", "Town"], "Town")


def test_holders_and_ids(spark):
    rows = [
        (1, 1, 0, [("Early", 0), ("Common", 1), ("1 1", 2)]), (1, 1, 1, [("Part II Direct Shareholders", 0)]), (1, 1, 2, [("schedule a, column (a)", 0)]),
        (1, 1, 3, [("JOYCE C", 0), ("COMMON", 1), ("40.000 40.000", 2)]), (1, 1, 4, [("87-1188632", 0), ("US", 1), ("Ordinary Shares", 2), ("120", 3), ("130", 4)]), (1, 2, 1, [("Next Page Name", 0)]),
        (1, 2, 2, [("joyce c", 0), ("Class A", 1), ("9.000", 2)]), (1, 2, 3, [("One Count", 0), ("Class B shares", 1), ("7", 2)]), (1, 2, 4, [("Glued", 0), ("preferred", 1), ("1,100.0002,200.000", 2)]),
        (1, 2, 5, [("Minus", 0), ("Common", 1), ("-5", 2), ("3", 3)]), (1, 2, 6, [("Schedule C", 0)]), (1, 2, 7, [("Late", 0), ("Common", 1), ("1 1", 2)]),
        (2, 1, 0, [("Reference ID number", 0), ("bme01 b(3) x", 1)]), (2, 1, 1, [("12345678", 0), ("MAC2022", 1), ("NODIGIT", 2), ("123456", 3)]), (2, 1, 2, [("reference id", 0), ("MAC2022", 0)]), (2, 2, 0, [("OTHER1", 0)]),
    ]
    held = [tuple(r)[1:] for r in filings.shareholder_rows(printed(spark, rows)).orderBy("place").collect()]
    assert held == [(1, 1, "JOYCE C", "COMMON", 40.0, 40.0, False), (2, 1, "Next Page Name", "Ordinary", 120.0, 130.0, False), (3, 2, "One Count", "Class B", 7.0, 7.0, True), (4, 2, "Glued", "preferred", 1100.0, 2200.0, False)]
    assert [(r.doc_id, r.ids) for r in filings.reference_ids(printed(spark, rows)).collect()] == [(2, ["BME01", "12345678", "MAC2022"])]
    empty = printed(spark, rows).limit(0)
    for f in (filings.parse_accounting_period, filings.face_fields, filings.shareholder_rows, filings.reference_ids):
        assert f(empty).collect() == []
