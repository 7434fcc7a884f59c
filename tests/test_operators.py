import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import fx, layout, mapping, review
from tallyloom.plans import registry


@pytest.mark.parametrize(("text", "want"), [("(1,234)", -1234.0), ("1.234,56", 1234.56), ("1,5", 1.5), ("12,345", 12345.0), ("1 234 CR", -1234.0), ("99-", -99.0), ("1.2.3", 1.2), (" 7 ", 7.0), ("", None), (None, None)])
def test_parse_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_number(F.col("t"))).first()[0] == want


def test_year_before(spark):
    day = lambda s: spark.sql(f"SELECT DATE'{s}' AS d").select(S.year_before(F.col("d"))).first()[0]
    assert day("2024-06-30") == datetime.date(2023, 7, 1)
    assert day("2024-02-29") == datetime.date(2023, 3, 1)


def test_nearest_rate_prefers_earlier_and_respects_tolerance(spark):
    daily = spark.sql("SELECT * FROM VALUES ('AUD', DATE'2024-06-18', 1.51D), ('AUD', DATE'2024-06-21', 1.52D), ('AUD', DATE'2024-06-23', 1.53D) t(code, d, rate)")
    asked = spark.sql("SELECT * FROM VALUES ('AUD', DATE'2024-06-22'), ('AUD', DATE'2024-06-21'), ('AUD', DATE'2024-07-01') t(code, d)")
    got = {r.d.day: r.rate for r in fx.nearest_rate(asked, daily).collect()}
    assert got == {22: 1.52, 21: 1.52}


def test_longest_keyword_wins(spark):
    rules = spark.sql("SELECT * FROM VALUES (1,1,'ring','a'), (2,1,'small ring','b') r(rule_ord, kw_ord, kw, target)")
    labels = spark.sql("SELECT * FROM VALUES ('Small ring'), ('spring'), (CAST(NULL AS STRING)) t(label)")
    assert {r.label: r.target for r in mapping.match_rules(labels, rules).collect()} == {"Small ring": "b", "spring": None, None: None}


def test_versioned_update(spark):
    now = spark.sql("SELECT * FROM VALUES (1, 5L), (2, 5L), (3, 5L) t(id, version)")
    new = spark.sql("SELECT * FROM VALUES (1, 1, 5L), (2, 1, 4L), (3, 1, NULL), (9, 1, 1L), (1, 2, 5L), (3, 2, 6L), (3, 3, 6L), (3, 4, NULL) t(id, ord, base_version)")
    got = {(r.id, r.ord): (r.status, r.version) for r in review.versioned_update(now, new).collect()}
    assert got == {
        (1, 1): ("accepted", 6), (1, 2): ("conflict", 6), (2, 1): ("conflict", 5), (9, 1): ("not found", None),
        (3, 1): ("accepted", 6), (3, 2): ("accepted", 7), (3, 3): ("conflict", 7), (3, 4): ("accepted", 8),
    }


NUMBERS = [
    ("USD 1,234", 1234.0, None), ("€1,234", 1234.0, 1234.0), ("A$ 5", 5.0, None), ("Rs. 1,000", 1.0, None), ("-5", -5.0, -5.0), ("(5)", -5.0, -5.0), ("- 5 -", 5.0, 5.0),
    ("1,234 CR", -1234.0, -1234.0), ("7 dr /", 7.0, 7.0), ("no number", None, None), ("1'234.5", 1234.5, 1234.5), ("現金 5", 5.0, None), ("1\u00a0000", 1000.0, 1000.0), ("1.234,5", 1234.5, 1234.5),
]


def test_printed_numbers(spark):
    got = spark.createDataFrame([(t,) for t, _, _ in NUMBERS], "t string").select("t", S.parse_number(F.col("t")).alias("a"), S.strict_number(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == NUMBERS


def test_labels_percents_and_captions(spark):
    labels = ["Less: returns", "lesser", "Provision for doubtful debts", "Accumulated amortisation", "Unaccumulated depreciation", "Allowance for bad debts"]
    df = spark.createDataFrame([(x,) for x in labels], "t string")
    assert [r[0] for r in df.select(S.sign_for_label(F.col("t"))).collect()] == [-1, 1, -1, -1, 1, -1]
    p = spark.createDataFrame([(x,) for x in ("0.5%", "0.5", "50%", "0", "101", "x", " 12.345 %")], "t string")
    assert [r[0] for r in p.select(S.clean_percent(F.col("t"))).collect()] == [50.0, 50.0, 50.0, 0.0, None, None, 12.35]
    c = spark.createDataFrame([("Total  Assets (see  note)", "  Fiscal  Year: ")], "a string, b string")
    assert tuple(c.select(S.norm_caption(F.col("a")), S.norm_profile(F.col("b"))).first()) == ("total assets see note", "fiscal year")


KEYWORDS = [
    ("a/r (trade)", "A/R (trade), net", True), ("tax.paid", "taxxpaid", False), ("tax.paid", "Tax.Paid 2024", True), ("現金", "現金2024", True), ("現金", "hk現金", True), ("land", "Iceland", False),
    ("purchase", "Purchases", True), ("purchase", "purchaser-led", True), ("land", "lands", False), ("coût", "Coûts", False), ("dépôt", "Dépôts", True), ("gear", "gear2", False), ("(loss)", "profit (loss)", True),
    ("été", "étés", False), ("note", "note", True), ("paid-in", "Paid-in capital", True),
]


def test_keywords(spark):
    """Each keyword by itself: labels carry its number, so that only its own label can hold it."""
    for keyword, label, hit in KEYWORDS[:3]:
        rules = spark.createDataFrame([(1, 1, keyword, "t"), (2, 1, "", "empty")], "rule_ord int, kw_ord int, kw string, target string")
        assert (mapping.match_rules(spark.createDataFrame([(label,)], "label string"), rules).first().target == "t") == hit
    patterns = mapping.rule_patterns(spark.createDataFrame([(i, 1, k, "t") for i, (k, _, _) in enumerate(KEYWORDS)], "rule_ord int, kw_ord int, kw string, target string"))
    labels = spark.createDataFrame([(i, label.lower()) for i, (_, label, _) in enumerate(KEYWORDS)], "rule_ord int, label string")
    tested = labels.join(patterns, "rule_ord").select("rule_ord", F.when(F.col("pattern").isNull(), F.contains("label", "low")).otherwise(F.regexp_like("label", F.col("pattern"))).alias("hit"))
    assert {r.rule_ord: r.hit for r in tested.collect()} == {i: hit for i, (_, _, hit) in enumerate(KEYWORDS)}


def test_keywords_equal_plain_matching(spark):
    """Every label against every keyword, as the equi-join must find them."""
    import random

    import regex

    rng = random.Random(8)
    part = ["tax", "taxes", "paid", "a/r", "(net)", "現金", "x現", "coût", "coûts", "b2b", "7", ".", "profit", "profitable", "loss"]
    words = lambda n: rng.choice(["", " "]).join(rng.choice(part) for _ in range(rng.randint(1, n)))
    labels, kws = sorted({" ".join(words(2) for _ in range(3)) for _ in range(150)}), list(dict.fromkeys(words(2) for _ in range(60)))

    def hits(label, kw):
        if regex.search(r"[^\x00-\u024f]", kw):
            return kw in label
        tail = r"\p{L}{0,3}" if len(kw) >= 5 else ""
        return bool(regex.search(r"(^|[^\p{L}\p{N}])" + regex.escape(kw, special_only=False) + tail + r"($|[^\p{L}\p{N}])", label))

    rules = spark.createDataFrame([(i, 1, k, str(i)) for i, k in enumerate(kws)], "rule_ord int, kw_ord int, kw string, target string")
    got = {r.label: r.target for r in mapping.match_rules(spark.createDataFrame([(x,) for x in labels], "label string"), rules).collect()}
    for label in labels:
        found = [(-len(k), i) for i, k in enumerate(kws) if hits(label.lower(), k.lower())]
        assert got[label] == (str(min(found)[1]) if found else None), label


def test_rates_fall_back_on_the_year_only(spark):
    rates = spark.sql("SELECT * FROM VALUES ('AUD','avg',2024,1.5D), ('AUD','spot',2024,1.6D), ('AUD','spot',2023,1.4D), ('NZD','spot',2022,1.7D) t(code, kind, year, rate)")
    asked = spark.sql("SELECT * FROM VALUES (1,'aud ',2024,2023), (2,'AUD',NULL,NULL), (3,'AUD',2022,2021), (4,'NZD',NULL,2022), (5,'XXX',2024,2023) t(entity_id, code, cy, py)")
    got = {r.entity_id: (r.avg_rate, r.cy_rate, r.py_rate) for r in fx.lookup_rates(asked, rates).collect()}
    assert got == {1: (1.5, 1.6, 1.4), 2: (1.5, 1.6, 1.4), 3: (None, None, None), 4: (None, None, 1.7), 5: (None, None, None)}


@pytest.mark.parametrize("block", [1, 2, 2_000])
def test_policies(spark, monkeypatch, block):
    """However many policies go along in one array, the first that holds decides, for each row by itself."""
    monkeypatch.setattr(review, "POLICY_BLOCK", block)
    rows = [("e", i, "info", c, m) for i, c, m in ((1, "fx", "Rate is old"), (2, "fx", "other"), (3, "doc", "RATE of 7"), (4, "doc", "none"), (5, None, None))]
    items = spark.createDataFrame(rows, "entity_id string, id int, level string, category string, message string")
    rules = [(1, "2", "doc", None, False, "keep"), (2, None, None, "(", True, "suppress"), (3, None, None, r"rate of \d", True, "block"), (4, "", "", "rate", False, "warn"), (5, None, None, None, False, "suppress"), (6, "4", None, None, False, "suppress")]
    schema = "ord int, m_id string, m_category string, m_message string, regex boolean, action string"
    got = {r.id: (r.level, r.action) for r in review.first_policy(items, spark.createDataFrame(rules, schema)).collect()}
    assert got == {1: ("warn", "warn"), 2: ("info", "keep"), 3: ("block", "block"), 5: ("info", None)}
    # items that share a key, and items without one
    same = spark.createDataFrame([("e", 1, "info", None, "alpha"), ("e", 1, "info", None, "beta"), (None, 2, "info", None, "alpha")], items.schema)
    got = [(r.entity_id, r.message, r.level) for r in review.first_policy(same, spark.createDataFrame([(1, None, None, "alpha", False, "block")], schema)).collect()]
    assert sorted(got, key=str) == [("e", "alpha", "block"), ("e", "beta", "info"), (None, "alpha", "block")]
    # expressions are read by the engine that matches them
    odd = [(1, None, None, r"(?P<x>al)pha", True, "block"), (2, None, None, r"\p{L}+pha", True, "warn"), (3, None, "late", None, False, "block"), (4, None, "late", None, False, "warn")]
    got = [(r.message, r.level) for r in review.first_policy(same.withColumn("category", F.when(F.col("message") == "beta", "late")), spark.createDataFrame(odd, schema)).collect()]
    assert sorted(got) == [("alpha", "warn"), ("alpha", "warn"), ("beta", "block")]
    assert len(review.first_policy(items, spark.createDataFrame([], schema)).collect()) == 5


def test_pairs_stay_within_an_entity(spark):
    ledger = spark.sql("SELECT * FROM VALUES (1, 'A', 'Invoice', 1.0D), (2, 'A', 'credit note', 1.0D), (3, 'B', 'invoice', 1.0D), (3, 'B', 'Credit Note', 1.0D) t(entity_id, reference, details, source)")
    assert [tuple(r) for r in review.invoice_credit_pairs(ledger).collect()] == [(3, "B")]


def test_rulers_stay_on_their_document_and_page(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 5, 700D), ('a', 6, 700D), ('a', 9, 700D), ('b', 5, 700D), ('a', 5, 760D) t(doc_id, page, y)")
    rulers = spark.sql("SELECT * FROM VALUES ('a', 5, 750D), ('a', 5, 720D), ('a', 5, 100D) t(doc_id, page, y)")
    pages = spark.sql("SELECT * FROM VALUES ('a', 5, true), ('a', 6, false), ('a', 9, false), ('b', 5, false) t(doc_id, page, has_ruler)")
    got = {(r.doc_id, r.page, r.y): (r.ruler_page, r.ruler_y) for r in layout.select_ruler(rows, rulers, layout.inherit_rulers(pages)).collect()}
    assert got == {("a", 5, 700.0): (5, 720.0), ("a", 6, 700.0): (5, 100.0), ("a", 9, 700.0): (None, None), ("b", 5, 700.0): (None, None), ("a", 5, 760.0): (None, None)}


def test_period_average_equals_plain_mean(spark):
    import datetime as dt

    days = [dt.date(2023, 11, 20) + dt.timedelta(i) for i in range(0, 400) if i % 3]
    daily = spark.createDataFrame([("X", d, 1 + d.toordinal() % 17 / 10) for d in days], "code string, d date, rate double")
    asked = [(dt.date(2024, 1, 1), dt.date(2024, 12, 31)), (dt.date(2023, 12, 5), dt.date(2024, 3, 7)), (dt.date(2024, 2, 3), dt.date(2024, 2, 20)), (dt.date(2024, 5, 1), dt.date(2024, 4, 1))]
    got = {(r.start, r.end): (r.points, r.rate) for r in fx.period_average(spark.createDataFrame([("X", *a) for a in asked], "code string, start date, end date"), daily).collect()}
    for a, b in asked:
        own = [1 + d.toordinal() % 17 / 10 for d in days if a <= d <= b]
        assert got[a, b] == (len(own), pytest.approx(round(sum(own) / len(own), 6)) if len(own) >= 60 else None)


def test_queries_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_lines_are_summed_in_one_aggregation(spark):
    """One group a line in a task's memory and one shuffle, not a group a field first."""
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 'amount', 1.0D), (1, 'a', 'boy', 2.0D), (1, 'a', 'amount', 4.0D), (1, 'b', 'other', 8.0D), (2, 'a', null, 1.0D) t(entity_id, target, field, value)")
    made = mapping.sum_lines(rows)
    assert sorted(map(tuple, made.collect()), key=str) == [(1, "a", 5.0, 2.0, None), (1, "b", None, None, None), (2, "a", None, None, None)]
    assert made._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2


def test_captions_of_a_common_label_stay_where_they_are(spark, monkeypatch):
    """The matched labels are written, so their size is known before captions would be shuffled by label."""
    written = []
    real = mapping.materialize
    monkeypatch.setattr(mapping, "materialize", lambda df, label: written.append(label) or real(df, label))
    captions = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'Cash at bank', 'Sales') AS label")
    rules = spark.sql("SELECT * FROM VALUES (1, 1, 'cash', 'balance:1'), (2, 1, 'sales', 'income:1') t(rule_ord, kw_ord, kw, target)")
    made = mapping.match_rules(captions, rules)
    assert written == ["labels-matched"] and {tuple(r) for r in made.groupBy("target").count().collect()} == {("balance:1", 1000), ("income:1", 2000)}
    assert "BroadcastHashJoin" in made._jdf.queryExecution().sparkPlan().toString()
