"""Documents that repeat another's figures: an exact set join, and a choice in the order of the pairs.

Equal sets of figures are one class, so copies are never paired with each other; classes meet by prefixes of their rarest
figures. The choice between alike documents goes in the order of pairs, each pair with documents that are still open; rounds
settle all pairs that no open pair before them touches. Entities of few documents, which are most, need neither: each is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import let
from tallyloom.session import materialize

LEAST_VALUES = 5
JACCARD, CONTAINMENT = 0.8, 0.9
#: Entities of so many documents and values at most are settled a row each, all others in rounds.
FEW_DOCS, FEW_VALUES = 128, 20_000
#: Kinds of documents that can repeat each other.
COMPARED = ["cfc-financial-statements", "cfc-tax-return", "trial-balance", "related-party-ledger"]


def value_sets(values: DataFrame, least: int = LEAST_VALUES) -> DataFrame:
    """(entity_id, doc_id, v, n, set_id) of documents with ``least`` distinct values or more, from (entity_id, doc_id, value).

    ``v`` are the values in order; equal sets of an entity have one set_id, a 64-bit hash of them.
    """
    held = values.where("value is not null").groupBy("entity_id", "doc_id").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return held.withColumn("n", F.size("v")).where(F.col("n") >= least).withColumn("set_id", F.xxhash64("n", "v"))


def _alike(v: Column, w: Column) -> Column:
    """Whether two arrays of distinct values share JACCARD of their union or CONTAINMENT of the smaller one."""
    n, m = F.size(v), F.size(w)
    return let(F.size(F.array_intersect(v, w)), lambda shared: (shared / (n + m - shared) >= JACCARD) | (shared / F.least(n, m) >= CONTAINMENT))


def alike_sets(sets: DataFrame) -> DataFrame:
    """(entity_id, a, b): set_ids of an entity's different ``sets`` that are alike, once with a and b in either order.

    Alike are sets that share JACCARD of their union or CONTAINMENT of the smaller one; both ask for JACCARD of the smaller one
    at least. So of the smaller set's values, the rarest first, one of the first n - ceil(JACCARD n) + 1 lies in the larger set.
    Each set is taken from one of its documents; candidates are confirmed by counting all shared values.
    """
    whole = materialize(sets.groupBy("entity_id", "set_id").agg(F.min_by("v", "doc_id").alias("v")), "value-arrays")
    held = whole.select("entity_id", "set_id", F.size("v").alias("n"), F.explode("v").alias("value"))
    often = held.groupBy("entity_id", "value").agg(F.count("*").alias("often")).where("often > 1")
    rare = held.join(often, ["entity_id", "value"]).groupBy("entity_id", "set_id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("v"))
    # values that no other set has come first; they take up places of the prefix without a partner
    room = F.col("n") - F.ceil(F.lit(JACCARD) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("v"))
    prefix = rare.select("entity_id", "set_id", "n", F.explode(F.slice("v", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))["value"]).alias("value"))
    other = held.select("entity_id", "value", F.col("set_id").alias("b"), F.col("n").alias("m"))
    # every pair is met from its smaller set, of equally large ones from the one of smaller id
    near = prefix.withColumnRenamed("set_id", "a").join(other, ["entity_id", "value"]).where("n < m or (n = m and a < b)").select("entity_id", "a", "b").distinct()
    side = lambda x: whole.select("entity_id", F.col("set_id").alias(x), F.col("v").alias(f"v{x}"))
    met = near.join(side("a"), ["entity_id", "a"]).join(side("b"), ["entity_id", "b"])
    return met.where(_alike(F.col("va"), F.col("vb"))).select("entity_id", "a", "b")


def settle_few(sets: DataFrame) -> DataFrame:
    """(entity_id, doc_id, duplicate_of) of what is marked among ``sets`` (entity_id, doc_id, ord, width, year, v), an entity a
    row: its documents in order, each open one against the open ones behind it. For entities of few documents."""
    docs = F.sort_array(F.collect_list(F.struct("ord", "doc_id", "width", "year", "v")))
    mark = lambda x, of: F.struct(x["doc_id"].alias("doc_id"), of["doc_id"].alias("duplicate_of"))
    same_year = lambda x, y: x["year"].isNull() | y["year"].isNull() | (x["year"] == y["year"])

    def step(marks: Column, x: Column) -> Column:
        open_ = lambda y: ~F.exists(marks, lambda m: m["doc_id"] == y["doc_id"])
        rivals = F.filter("docs", lambda y: (y["ord"] > x["ord"]) & same_year(x, y) & open_(y) & _alike(x["v"], y["v"]))

        def marked(met: Column) -> Column:
            stop = F.get(F.filter(met, lambda y: y["width"] > x["width"]), F.lit(0))
            lost = F.transform(F.filter(met, lambda y: stop.isNull() | (y["ord"] < stop["ord"])), lambda y: mark(y, x))
            return F.concat(marks, lost, F.when(stop.isNull(), F.slice(lost, 1, 0)).otherwise(F.array(mark(x, stop))))

        return F.when(open_(x), let(rivals, marked)).otherwise(marks)

    id_ = sets.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<doc_id:{id_},duplicate_of:{id_}>>")
    return sets.groupBy("entity_id").agg(docs.alias("docs")).select("entity_id", F.inline(F.aggregate("docs", none, step)))


def mark_duplicates(docs: DataFrame, values: DataFrame) -> DataFrame:
    """``docs`` (entity_id, doc_id, kind, year, n_pages, ord, ...) with ``set_id`` (null without enough values) and
    ``duplicate_of``, the document that is kept instead, or null.

    Documents of the COMPARED kinds with LEAST_VALUES values or more are compared within their entity; two whose years are known
    and differ never are. Pairs are taken by the ``ord`` of the earlier and then of the later document; a pair of which one is
    marked already is passed over; of the others the one with fewer pages, or the later one of equally many, is marked. ``ord``
    tells the documents of an entity apart; a document without entity is compared with none. Entities of FEW_DOCS documents and
    FEW_VALUES values at most are settled a row each. In the others, copies, hot entities and hot values make no pairs of
    documents: documents meet in classes of equal sets and years, and each round marks all that its settled documents win.
    """
    class_id = F.xxhash64("set_id", F.coalesce("year", F.lit(-1)))
    compared = docs.where(F.col("kind").isin(COMPARED)).select("entity_id", "doc_id", "ord", F.coalesce("n_pages", F.lit(0)).alias("width"), "year")
    sets = materialize(value_sets(values).join(compared, ["entity_id", "doc_id"]), "sets")
    entities = sets.groupBy("entity_id").agg(F.count("*").alias("docs"), F.sum("n").alias("held"))
    large = materialize(entities.where((F.col("docs") > FEW_DOCS) | (F.col("held") > FEW_VALUES)).select("entity_id"), "large")
    lost = [settle_few(sets.join(large, "entity_id", "left_anti"))]
    if not large.isEmpty():
        lost += settle_many(sets.join(large, "entity_id", "left_semi").withColumn("class", class_id))
    every = lost[0]
    for more in lost[1:]:
        every = every.unionByName(more)
    return docs.join(sets.select("entity_id", "doc_id", "set_id"), ["entity_id", "doc_id"], "left").join(every, ["entity_id", "doc_id"], "left")


def settle_many(sets: DataFrame) -> list[DataFrame]:
    """Parts of (entity_id, doc_id, duplicate_of) of what is marked among ``sets`` with ``class``, in rounds."""
    open_ = materialize(sets.select("entity_id", "doc_id", "ord", "width", "set_id", "year", "class"), "open")
    classes = open_.groupBy("entity_id", "set_id", "year", "class").agg(F.count("*").alias("members"))
    pairs = alike_sets(sets)
    both = pairs.unionByName(pairs.select("entity_id", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select("entity_id", F.col("set_id").alias("a"), F.col("set_id").alias("b")).distinct())
    left = classes.select("entity_id", F.col("set_id").alias("a"), F.col("year").alias("y"), F.col("class").alias("c"), F.col("members"))
    right = classes.select("entity_id", F.col("set_id").alias("b"), F.col("year").alias("z"), F.col("class").alias("d"))
    edges = both.join(left, ["entity_id", "a"]).join(right, ["entity_id", "b"]).where("(y is null or z is null or y = z) and (c <> d or members > 1)").select("entity_id", "c", "d")
    edges = materialize(edges, "alike")
    marks: list[DataFrame] = []
    while True:
        first = open_.groupBy("entity_id", F.col("class").alias("d")).agg(F.min(F.struct("ord", "doc_id", "width")).alias("first"), F.count("*").alias("members"))
        # of each class the first open document that it is alike with; classes without partners are settled
        meets = edges.join(first, ["entity_id", "d"])
        live = meets.where("c <> d or members > 1")
        near = materialize(live.groupBy("entity_id", F.col("c").alias("class")).agg(F.min("first").alias("next")).join(first.select("entity_id", F.col("d").alias("class"), "first", "members"), ["entity_id", "class"]), "near")
        if near.isEmpty():
            break
        # a document is next if it is the first of its class and of all classes that it meets, and no document before it meets those
        by = near.select("entity_id", F.col("class").alias("d"), F.col("next").alias("next_d"), F.col("first").alias("first_d"))
        ready = edges.join(by, ["entity_id", "d"]).join(near.select("entity_id", F.col("class").alias("c"), "first", "members"), ["entity_id", "c"]).where("c <> d or members > 1")
        is_next = F.min(((F.col("first")["ord"] <= F.col("next_d")["ord"]) & (F.col("first")["ord"] <= F.col("first_d")["ord"])).cast("int"))
        ready = ready.groupBy("entity_id", "c").agg(F.min("first").alias("winner"), is_next.alias("ok")).where("ok = 1").select("entity_id", "c", "winner")
        reach = materialize(ready.join(edges, ["entity_id", "c"]).select("entity_id", F.col("d").alias("class"), "winner").distinct(), "reach")
        met = open_.join(reach, ["entity_id", "class"]).where(F.col("ord") > F.col("winner")["ord"])
        wider = met.where(F.col("width") > F.col("winner")["width"]).groupBy("entity_id", "winner").agg(F.min(F.struct("ord", "doc_id")).alias("stop"))
        wider = materialize(wider, "wider")
        lost = met.join(wider, ["entity_id", "winner"], "left").where(F.col("stop").isNull() | (F.col("ord") < F.col("stop")["ord"])).select("entity_id", "doc_id", F.col("winner")["doc_id"].alias("duplicate_of"))
        lost = materialize(lost.unionByName(wider.select("entity_id", F.col("winner")["doc_id"].alias("doc_id"), F.col("stop")["doc_id"].alias("duplicate_of"))), "lost")
        marks.append(lost)
        open_ = materialize(open_.join(lost.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti"), "open")
    return marks
