"""Every caption row has one fate, in the fixed order of steps."""

import pytest

from tallyloom.operators import captions

ROWS = "row_id int, entity_id int, doc_id int, page int, ord int, label string, vals array<double>, years array<int>, cy int, py int, kind string, feed string"
RULES = [(1, 1, "sales", "income:11"), (2, 1, "tax", "income:54"), (3, 1, "total", "SKIP"), (4, 1, "other", "income:OI"), (5, 1, "cash", "balance:3")]


@pytest.fixture(scope="module")
def mapped(spark):
    given = [
        # label, vals, years, kind, feed, page, doc
        ("Sales", [5.0], None, "pdf", "is", 1, 1),
        ("SALES", [5.0], None, "pdf", "is", 2, 1),  # on another page: counted once
        ("Sales", [5.0], None, "pdf", "is", 2, 2),  # another document
        ("Sales", [5.0], None, "pdf", "bs", 1, 1),  # out of its feed
        ("Grand total", [5.0], None, "pdf", "is", 1, 1),
        ("Income tax", [9.0], None, "pdf", "is", 1, 1),
        ("Income tax", [-4.0], None, "pdf", "is", 1, 1),
        ("Cash", [1.0, 2.0], None, "pdf", "bs", 1, 1),
        ("Cash", [1.0, 2.0], None, "grid", "bs", None, 3),
        ("Cash", [1.0, 2.0], None, "grid", "bs", None, 3),  # grids repeat
        ("Cash", [7.0], [2019], "pdf", None, 1, 1),
        ("Owed by Acme", [3.0], None, "pdf", "bs", 1, 1),
        ("Owed by Acme", [3.0], None, "pdf", "is", 1, 1),
        ("Freed caption", [3.0], None, "pdf", "is", 1, 1),
        ("My  OWN line", [3.0], None, "pdf", "is", 1, 1),
        *((f"other {k}", [1.0 + k], None, "pdf", "is", 1, 1) for k in (1, 2, 3, 2, 1, 4)),
        (None, [1.0], None, "pdf", "is", 1, 1),
    ]
    rows = [(i, 1, g[6], g[5], i, g[0], g[1], g[2], 2024, 2023, g[3], g[4]) for i, g in enumerate(given)]
    overrides = [(1, "freed caption", None), (1, "my own line", "income:22"), (2, "sales", None), (1, "grand total", "income:12")]
    return captions.map_captions(
        spark.createDataFrame(rows, ROWS), spark.createDataFrame(RULES, "rule_ord int, kw_ord int, kw string, target string"),
        spark.createDataFrame(overrides, "entity_id int, label string, target string"), spark.createDataFrame([(1, "The ACME Group"), (2, "Other")], "entity_id int, name string"),
    )


def test_each_row_has_one_fate(mapped):
    got = {r.row_id: (r.target, r.fate) for r in mapped.fates.collect()}
    assert mapped.fates.count() == len(got) == 22
    assert [got[i] for i in range(15)] == [
        ("income:11", "booked"), ("income:11", "counted once"), ("income:11", "booked"), (None, "unmatched"), ("SKIP", "skipped"), ("income:54", "booked"), ("income:54", "booked"), ("balance:3", "ambiguous"),
        ("balance:3", "booked"), ("balance:3", "booked"), ("balance:3", "no value"), ("balance:19", "booked"), (None, "unmatched"), (None, "unassigned"), ("income:22", "booked"),
    ]
    # a user's line is not free: the first caption takes 23, all others the last line
    assert [got[i][0] for i in range(15, 21)] == ["income:23", "income:24", "income:24", "income:24", "income:23", "income:24"] and got[21] == (None, "unmatched")


def test_contributions_names_and_review(mapped):
    booked = {(r.row_id, r.field): r.value for r in mapped.contributions.collect()}
    assert booked[5, "amount"] == -9.0 and booked[6, "amount"] == -4.0 and booked[8, "eoy"] == 2.0 and booked[8, "boy"] == 1.0 and (1, "amount") not in booked
    assert {r.target: r.label for r in mapped.relabels.collect()} == {"income:22": "My  OWN line", "income:23": "other 1", "income:24": "Other (4 items)"}
    review = {(r.category, r.target): (r.level, r.n) for r in mapped.review.collect()}
    assert review == {("related-party", "balance:19"): ("warn", 1), ("counted-once", "income:11"): ("info", 1), ("tax-sign", "income:54"): ("warn", 1), ("pool", "income:24"): ("info", 4)}


def test_nothing_to_map(spark):
    none = captions.map_captions(spark.createDataFrame([], ROWS), spark.createDataFrame(RULES, "rule_ord int, kw_ord int, kw string, target string"), spark.createDataFrame([], "entity_id int, label string, target string"), spark.createDataFrame([], "entity_id int, name string"))
    assert [x.collect() for x in none] == [[], [], [], []]


def test_only_captions_that_someone_asked_for_are_joined_by_entity(spark, monkeypatch):
    """All others keep their place: neither a user's target nor a name of any group can meet them."""
    routed = []
    real = captions.route_related_party
    monkeypatch.setattr(captions, "route_related_party", lambda rows, names: routed.append(rows) or real(rows, names))
    given = [(i, 1 + i % 2, 1, 1, i, label, [1.0], None, 2024, 2023, "pdf", "bs") for i, label in enumerate(("Cash", "My  OWN line", "Owed by Acme", None, "Sundry", "owed by ACME"))]
    overrides = spark.createDataFrame([(2, "my own line", "balance:9"), (1, "elsewhere", "balance:9")], "entity_id int, label string, target string")
    rules = spark.createDataFrame(RULES, "rule_ord int, kw_ord int, kw string, target string")
    made = captions.decide_targets(spark.createDataFrame(given, ROWS), rules, overrides, spark.createDataFrame([(1, "The ACME Group")], "entity_id int, name string"))
    got = {r.row_id: (r.target, r.own, r.related) for r in made.collect()}
    assert got == {0: ("balance:3", False, False), 1: ("balance:9", True, False), 2: ("balance:19", False, True), 3: (None, False, False), 4: (None, False, False), 5: (None, False, False)}
    assert sorted(r.row_id for r in routed[0].collect()) == [1, 2, 5]
