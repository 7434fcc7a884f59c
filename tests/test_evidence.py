"""Cases of the evidence operators."""

from tallyloom.operators import evidence
from tallyloom.plans import evidence as plans


def test_kind_and_year(spark):
    pages = spark.sql("SELECT * FROM VALUES (1, 'terms'), (1, 'statement'), (2, 'unknown'), (3, CAST(NULL AS STRING)) t(doc_id, kind)")
    assert {r.doc_id: (r.kind, r.confidence) for r in evidence.doc_kind(pages, ["return", "statement", "terms"]).collect()} == {1: ("statement", 1.0), 2: ("unknown", 0.0), 3: ("unknown", 0.0)}
    votes = spark.sql("SELECT * FROM VALUES (1, 2023, 2, 5), (1, 2024, 2, 1), (1, 1990, 9, 0) t(doc_id, year, weight, pos)")
    assert evidence.statement_year(votes).first().year == 2024


def test_duplicates_stay_within_an_entity(spark):
    values = spark.sql("SELECT e AS entity_id, d AS doc_id, explode(sequence(1, n)) AS value FROM VALUES (1, 1, 5), (1, 2, 6), (1, 3, 4), (2, 4, 5) t(e, d, n)")
    assert [tuple(r) for r in evidence.duplicate_documents(values.unionByName(values)).collect()] == [(1, 1, 2, 5)]


def test_writes_never_replace_values(spark):
    facts = spark.sql("SELECT * FROM VALUES ('a', 1, 'x', 1), ('a', 1, 'y', 2), ('a', 2, ' ', 1) t(sheet, ref, value, ord)")
    added = spark.sql("SELECT * FROM VALUES ('a', 1, 'z', 1), ('a', 2, 'z', 1), ('a', 3, 'w', 1) t(sheet, ref, value, ord)")
    assert {r.ref: r.value for r in evidence.build_writes(facts, added).collect()} == {1: "y", 2: "z", 3: "w"}


def test_sign_offs_and_sheets(spark):
    items = spark.sql("SELECT * FROM VALUES (1, 1, 5.0D), (1, 2, 6.0D) t(entity_id, id, value)")
    earlier = spark.sql("SELECT * FROM VALUES (1, 1, true, 7.0D), (9, 9, true, 1.0D) t(entity_id, id, dismissed, edited)")
    assert {r.id: (r.value, r.dismissed) for r in evidence.carry_sign_offs(items, earlier).collect()} == {1: (7.0, True), 2: (6.0, False)}
    sheet = spark.sql("SELECT * FROM VALUES ('A', 1.5D, -1.0D) t(code, a, b)")
    assert [tuple(r) for r in evidence.unpivot_rate_sheet(sheet, "code", {"a": 2023, "b": 2024}).collect()] == [("A", 2023, 1.5)]


def test_all_queries_have_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_cases(spark):
    from tallyloom.operators import cases

    cells = spark.createDataFrame([(1, "(1,234.5)"), (1, "1234.5"), (1, "Item 900"), (1, "99"), (1, "8J 150"), (1, None)], "doc_id int, text string")
    assert sorted(r.value for r in cases.value_fingerprint(cells).collect()) == [1235, 8150]
    docs = spark.createDataFrame([(1, "cfc-tax-return", 2023, False), (1, "cfc-financial-statements", 2024, None), (1, "trial-balance", 2030, False), (1, "cfc-tax-return", 2031, True), (2, "cfc-tax-return", None, False)], "entity_id int, kind string, year int, duplicate boolean")
    assert [tuple(r) for r in cases.derive_case_years(docs).collect()] == [(1, 2024, 2023, [2023])]
    names = spark.createDataFrame([(1, "Keystone Pty Ltd"), (1, "The Abc Group")], "entity_id int, name string")
    rows = [("Receivable from KEYSTONE", "bs", None), ("Keystoned receivable", "bs", None), ("Keystone", "bs", None), ("Due to Keystone", "is", None), ("Loan from keystone", "bs", None), ("ABC receivable", "bs", None), ("Keystone payable", "bs", "x")]
    captions = spark.createDataFrame([(1, *r) for r in rows], "entity_id int, label string, feed string, target string")
    got = {r.label: r.target for r in cases.route_related_party(captions, names).collect()}
    assert got == {"Receivable from KEYSTONE": "loan-asset", "Keystoned receivable": None, "Keystone": None, "Due to Keystone": None, "Loan from keystone": "loan-liability", "ABC receivable": None, "Keystone payable": "x"}


def test_equal_documents_share_one_count(spark):
    """Forty copies and one document more: two classes are counted, and all pairs come out."""
    docs = [(1, i, 5) for i in range(40)] + [(1, 40, 6), (1, 41, 4), (2, 42, 5)]
    values = spark.createDataFrame(docs, "entity_id int, doc_id int, n int").selectExpr("entity_id", "doc_id", "explode(sequence(1, n)) AS value")
    made = evidence.duplicate_documents(values)
    got = sorted(map(tuple, made.collect()))
    assert got == [(1, a, b, 5) for a in range(41) for b in range(a + 1, 41)]
    assert "xxhash64" in made._jdf.queryExecution().optimizedPlan().toString()
