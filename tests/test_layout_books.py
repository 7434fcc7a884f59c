"""Cases of layout, books, scalar and streaming operators."""

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import books, layout
from tallyloom.plans import layout_books
from tallyloom.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_dates_and_columns(spark):
    dates = {"6/30/24": "2024-06-30", "30-6-2024": "2024-06-30", "2/30/2024": "None", "x": "None", "": "None"}
    for text, want in dates.items():
        assert str(one(spark, S.to_iso_date(F.lit(text)))) == want
    assert one(spark, S.to_iso_date(F.lit(None).cast("string"))) is None
    assert str(one(spark, S.serial_to_date(F.lit(45473.0)))) == "2024-06-30" and one(spark, S.serial_to_date(F.lit(5.0))) is None
    assert [one(spark, S.column_number(F.lit(x))) for x in ("A", "z", "AA", "A1", "")] == [1, 26, 27, None, None]


def test_scripts(spark):
    assert [one(spark, S.is_mostly_non_latin(F.lit(x))) for x in ("Bargeld", "現金", "現金 cash", "12", None)] == [False, True, False, False, False]


def test_ruler_is_strictly_above(spark):
    rows = spark.sql("SELECT * FROM VALUES (7, 1, 10.0D, 'a'), (7, 1, 20.0D, 'b'), (7, 2, 5.0D, 'c') t(doc_id, page, y, name)")
    rulers = spark.sql("SELECT * FROM VALUES (7, 1, 20.0D), (7, 1, 30.0D) t(doc_id, page, y)")
    assert {r.name: r.ruler_y for r in layout.select_ruler(rows, rulers).collect()} == {"a": 20.0, "b": 30.0, "c": None}


def test_inheritance(spark):
    pages = spark.sql("SELECT * FROM VALUES (1, 1, true, 'balance'), (1, 2, false, 'unknown'), (1, 5, false, 'cover'), (1, 6, false, 'unknown') t(doc_id, page, has_ruler, kind)")
    assert {r.page: r.ruler_page for r in layout.inherit_rulers(pages).collect()} == {1: 1, 2: 1, 5: None, 6: None}
    assert {r.page: r.kind for r in layout.inherit_kinds(pages, ["balance"]).collect()} == {1: "balance", 2: "balance", 5: "cover", 6: "unknown"}


def test_pool_and_mode(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'b', 1, 1.0D), (1, 'a', 2, 2.0D), (1, 'c', 3, 3.0D), (1, 'c', 4, 4.0D) t(entity_id, caption, ord, value)")
    assert {(r.slot, r.label, r.value) for r in layout.allocate_pool(rows, 2).collect()} == {(1, "b", 1.0), (2, "Other (3 items)", 9.0)}
    tied = rows.where("ord < 3")
    assert layout.mode_first(tied, "entity_id", "caption", "ord").first().caption == "b"


def test_rates_by_priority_and_edits(spark):
    asked = spark.sql("SELECT * FROM VALUES ('A', 1), ('B', 1), ('C', 1) t(code, year)")
    table, manual = (spark.sql(f"SELECT * FROM VALUES {v} t(code, year, rate)") for v in ("('A', 1, 2.0D), ('B', 1, 0.0D)", "('A', 1, 9.0D), ('B', 1, 3.0D)"))
    assert {r.code: (r.rate, r.source) for r in books.rate_chain(asked, [("table", table), ("manual", manual)]).collect()} == {"A": (2.0, "table"), "B": (3.0, "manual"), "C": (None, None)}
    rates = spark.sql("SELECT * FROM VALUES ('A', 'avg', 1, 2.0D), ('B', 'avg', 1, 2.0D) t(code, kind, year, rate)")
    edits = spark.sql("SELECT * FROM VALUES ('A', 'avg', 1, CAST(NULL AS DOUBLE)), ('C', 'avg', 1, 4.0D) t(code, kind, year, rate)")
    assert {r.code: r.rate for r in books.set_fx_overrides(rates, edits).collect()} == {"B": 2.0, "C": 4.0}


def test_pages_are_clamped(spark):
    assert [r.id for r in books.paginate(spark.range(12), ["id"], 9, 5).collect()] == [10, 11]
    assert books.paginate(spark.range(0), ["id"], 1, 5).count() == 0


def test_stream_drops_repeated_events(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01 01:00:00', 7L, 'click', 1.0D, 'x'), (1L, TIMESTAMP'2024-01-01 02:00:00', 7L, 'click', 1.0D, 'x'), (2L, TIMESTAMP'2024-01-01 03:00:00', 7L, 'purchase', 2.0D, NULL), (3L, TIMESTAMP'2024-01-01 04:00:00', 7L, 'view', 2.0D, 'yyy') t(event_id, ts, user_id, event_type, value, props)")
    path = f"file://{tmp_path}/events.parquet"
    rows.write.parquet(path)
    once = live.drain(live.ingest(live.read(spark, path), most_chars=2), "ingested", "append")
    assert sorted((r.event_id, r.props) for r in once.select("event_id", F.coalesce("props", F.lit("-")).alias("props")).collect()) == [(1, "x"), (2, "-"), (3, "yy")]
    assert live.drain(live.advance_tasks(live.read(spark, path)), "tasks", "complete").first().status == "completed"


def test_all_queries_have_sql():
    assert set(layout_books.queries()) == set(layout_books.oracle_sql())


def test_late_and_repeated_deliveries_add_nothing(spark, tmp_path):
    """A key that comes again days later, in another run and twice in one batch stays as it came first."""
    sink, schema = f"file://{tmp_path}/sink", "user_id int, event_id int, ts timestamp, props string"
    for n, rows in enumerate(([(1, 1, "2024-01-01", "first"), (1, 1, "2024-01-02", "twice"), (2, 1, "2024-01-01", "other")], [(1, 1, "2024-03-01", "late"), (1, 2, "2024-03-01", "new"), (2, 1, "2023-01-01", "early")])):
        path = f"file://{tmp_path}/in{n}.parquet"
        spark.createDataFrame([(u, e, t, p) for u, e, t, p in rows], "user_id int, event_id int, ts string, props string").selectExpr("user_id", "event_id", "timestamp(ts) AS ts", "props").coalesce(1).write.parquet(path)
        live.deliver(live.read(spark, path), sink, ["user_id", "event_id"])
    got = sorted((r.user_id, r.event_id, r.props) for r in spark.read.schema(schema).parquet(sink).collect())
    assert got == [(1, 1, "first"), (1, 2, "new"), (2, 1, "other")]


def test_a_delivery_reads_only_the_parts_that_it_touches(spark, tmp_path):
    """A second delivery, of two keys, lists and reads two parts of the sink at most; with offsets it reads only new files."""
    sink, source, offsets = f"file://{tmp_path}/sink", f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/offsets"
    events = lambda ids: spark.createDataFrame([(i, i) for i in ids], "event_id int, n int").selectExpr("event_id", "timestamp_seconds(n) AS ts", "n")
    events(range(500)).coalesce(1).write.parquet(source)
    live.deliver(live.read(spark, source), sink, ["event_id"], offsets=offsets)
    events([7, 1000]).coalesce(1).write.mode("append").parquet(source)
    new = events([7, 1000]).withColumn("key_part", live.key_part(["event_id"]))
    held = live.held_keys(spark.read.parquet(sink), ["event_id"], new)
    assert held.where("event_id = 7").count() == 1 and held.count() < 500 / 4 and len({r.f for r in held.select(F.input_file_name().alias("f")).collect()}) <= 2
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "key_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    live.deliver(live.read(spark, source), sink, ["event_id"], offsets=offsets)
    batches = sorted(p.name for p in (tmp_path / "offsets/commits").iterdir() if not p.name.startswith("."))
    assert batches == ["0", "1"] and sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [*range(500), 1000]
