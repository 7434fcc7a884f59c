"""What goes with a document, and what stays."""

from tallyloom.operators import stale


def test_what_rests_on_a_document_goes_with_it(spark):
    detected = [
        ("currency", "EUR", "gone.pdf · face", None), ("name", "Acme", "Kept.xlsx, sheet 1", None), ("city", "Rome", "gone.pdf", None), ("typed", "now", "gone.pdf", None), ("year", "2024", "statement year", None),
        ("plain", "x", None, None), ("cat:1a", "Yes", "anything", "gone.pdf"), ("cat:2", "Yes", "gone.pdf", "Kept.xlsx"), ("both", "b", "gone.csv", None), ("own", "o", "gone.pdf", None),
    ]
    profile = [("profile", "currency", "EUR"), ("profile", "name", "Acme"), ("profile", "city", "Rome"), ("profile", "typed", "other"), ("category", "1a", "Yes"), ("category", "2", "Yes"), ("profile", "both", "b"), ("ownership", "both", "b"), ("ownership", "own", "o"), ("profile", "none", None)]
    out = stale.prune_stale(
        spark.createDataFrame([(1, *d) for d in detected] + [(2, "city", "Rome", "gone.pdf", None)], "entity_id int, key string, value string, label string, doc string"), spark.createDataFrame([(1, "Kept.xlsx"), (2, "gone.pdf")], "entity_id int, name string"),
        spark.createDataFrame([(1, *p) for p in profile] + [(2, "profile", "city", "Rome")], "entity_id int, bucket string, key string, value string"), spark.createDataFrame([(1, "gone.pdf p. 2", "A"), (1, "", "B"), (1, None, "C"), (1, "Kept.xlsx", "D"), (2, "gone.pdf", "E")], "entity_id int, source string, name string"),
    )
    assert sorted((r.entity_id, r.key) for r in out.detected.collect()) == [(1, "cat:2"), (1, "name"), (1, "plain"), (1, "year"), (2, "city")]
    assert sorted(r.key for r in out.tombstones.collect()) == ["both", "cat:1a", "city", "currency", "own", "typed"]
    blank = sorted((r.bucket, r.key) for r in out.profile.collect() if r.value == "")
    assert blank == [("category", "1a"), ("ownership", "own"), ("profile", "both"), ("profile", "city"), ("profile", "currency")] and out.profile.count() == 11
    assert [r.entity_id for r in out.reset.collect()] == [1] and sorted(r.name for r in out.holders.collect()) == ["B", "C", "D", "E"]
