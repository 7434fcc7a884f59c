"""All captions of all entities booked in one plan, with what became of every row.

The order is fixed: rules, subtotals out, the user's own targets, feeds, related parties, years, pools, once a document, signs.
Rows keep their identity (``row_id``) through all steps, so each input row ends in exactly one fate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import norm
from tallyloom.operators.cases import group_stems, label_words, route_related_party
from tallyloom.operators.mapping import match_rules
from tallyloom.operators.rows import route_years
from tallyloom.session import materialize

#: Numbered lines of each pool, lines that are booked negative, lines of loans, and lines that take a caption as
#: their own (ranges of rows a schedule).
POOLS = {"income:OI": [22, 23, 24], "income:OD": list(range(34, 51)), "balance:OCA": [16, 17, 18], "balance:OCL": [48, 49, 50], "balance:OL": [54, 55, 56]}
TAX_LINES = ["income:54", "income:55"]
LOANS = {"loan-asset": "balance:19", "loan-liability": "balance:52"}
OWN_CAPTION = {"income": [(22, 24), (34, 50)], "balance": [(16, 18), (21, 23), (25, 27), (39, 41), (48, 50), (54, 56)]}

SKIPPED, UNASSIGNED, UNMATCHED, AMBIGUOUS, NO_VALUE, REPEATED, BOOKED = "skipped", "unassigned", "unmatched", "ambiguous", "no value", "counted once", "booked"


class Mapped(NamedTuple):
    """``fates``: every row with ``target``, ``fate``; ``contributions``: what was booked; ``relabels``: captions that lines take;
    ``review``: (entity_id, level, category, target, label, n) for a user to look at."""

    fates: DataFrame
    contributions: DataFrame
    relabels: DataFrame
    review: DataFrame


def decide_targets(rows: DataFrame, rules: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``target``, ``own`` (a user's target) and ``related``; the target of a subtotal is SKIP.

    A user's target (entity_id, label, target) beats rules, feeds and related parties, a null one leaves the row without; the
    label is compared without case and spacing. An income page reaches income lines only, a balance page balance lines only.
    Only rows whose label some user chose a target for, or names some entity's group, go where their entity's answers are.
    """
    matched = match_rules(rows, rules).join(asked_labels(rows, overrides, names), F.lower("label") == F.col("__low"), "left").drop("__low")
    ours = F.col("__asked").isNotNull()
    plain = _scoped(matched.where(~ours).withColumns({"own": F.lit(False), "__to": F.lit(None).cast("string")})).withColumn("related", F.lit(False))
    decided = _decided(matched.where(ours).drop("__asked"), overrides, names)
    return decided.unionByName(plain.select(*decided.columns))


def asked_labels(rows: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """(__low, __asked): labels in lower case that stand in ``overrides`` or share a word with ``names``, of whatever entity."""
    low = rows.select(F.lower("label").alias("__low")).where("__low is not null").distinct()
    chosen = low.join(overrides.select(norm(F.col("label")).alias("__norm")).distinct(), norm(F.col("__low")) == F.col("__norm"), "left_semi")
    words = low.withColumn("word", F.explode(label_words(F.col("__low"))))
    named = words.join(group_stems(names).select("word").distinct(), "word", "left_semi").select("__low")
    return materialize(chosen.unionByName(named).distinct().withColumn("__asked", F.lit(True)), "labels-asked")


def _scoped(met: DataFrame) -> DataFrame:
    """The target of rows with ``own`` and the user's target ``__to``, which is dropped."""
    skip = F.coalesce(F.col("target") == "SKIP", F.lit(False))
    own = F.coalesce(F.col("own"), F.lit(False)) & ~skip
    out_of_feed = ((F.col("feed") == "is") & ~F.col("target").startswith("income")) | ((F.col("feed") == "bs") & ~F.col("target").startswith("balance"))
    target = F.when(skip, F.col("target")).when(own, F.col("__to")).when(F.coalesce(out_of_feed, F.lit(False)), F.lit(None)).otherwise(F.col("target"))
    return met.withColumns({"target": target, "own": own}).drop("__to")


def _decided(matched: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    user = overrides.select(F.col("entity_id").alias("__entity"), norm(F.col("label")).alias("__norm"), F.col("target").alias("__to"), F.lit(True).alias("own"))
    met = matched.withColumn("__key", norm(F.col("label"))).join(user, (F.col("entity_id") == F.col("__entity")) & (F.col("__key") == F.col("__norm")), "left")
    met = _scoped(met.drop("__entity", "__norm", "__key"))
    open_ = F.col("target").isNull() & ~F.col("own") & F.coalesce(F.col("feed") == "bs", F.lit(False))
    asked = met.withColumns({"__feed": F.col("feed"), "feed": F.when(open_, F.lit("bs")), "__open": open_})
    routed = route_related_party(asked, names)
    loan = F.create_map(*(F.lit(x) for pair in LOANS.items() for x in pair))
    related = F.col("__open") & F.col("target").isNotNull()
    return routed.withColumn("related", related).withColumn("target", F.when(F.col("related"), F.try_element_at(loan, F.col("target"))).otherwise(F.col("target"))).withColumn("feed", F.col("__feed")).drop("__feed", "__open")


def place_in_pools(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rows`` (entity_id, target, own, label, ord) with ``slot``, the line, and ``in_last`` where a pool's last line takes it.

    Distinct captions of a pool take its free lines in order of first appearance, but for the last, which takes all further
    ones. Lines that users chose are not free; without any free one the pool's last line takes all. Only so many captions as a
    pool has lines are ranked for an entity.
    """
    held = rows.where(F.col("target").isin(list(POOLS)) & ~F.col("own"))
    captions = held.groupBy("entity_id", F.col("target").alias("pool"), F.trim(F.lower("label")).alias("caption")).agg(F.min("ord").alias("first"))
    most = max(map(len, POOLS.values()))
    ranked = captions.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id", "pool").orderBy("first", "caption"))).where(F.col("rank") < most)
    listed = ranked.groupBy("entity_id", "pool").agg(F.sort_array(F.collect_list(F.struct("rank", "caption")))["caption"].alias("captions"))
    lines = {pool: [f"{pool.split(':')[0]}:{n}" for n in ns] for pool, ns in POOLS.items()}
    taken = overrides.where(F.col("target").isin([x for slots in lines.values() for x in slots])).groupBy("entity_id").agg(F.collect_set("target").alias("taken"))
    all_ = F.create_map(*(x for pool, slots in lines.items() for x in (F.lit(pool), F.array(*map(F.lit, slots)))))
    free = F.array_except(F.try_element_at(all_, F.col("pool")), F.coalesce("taken", F.array().cast("array<string>")))
    # a pool's captions and lines are few, so they come to its rows as two arrays
    places = listed.join(taken, "entity_id", "left").select("entity_id", "pool", "captions", free.alias("free"))
    marked = rows.withColumns({"pool": F.when(~F.col("own") & F.col("target").isin(list(POOLS)), F.col("target")), "caption": F.trim(F.lower("label"))})
    at, n = F.array_position("captions", F.col("caption")).cast("int"), F.size("free")
    met = marked.join(places, ["entity_id", "pool"], "left").withColumns({"own_slot": F.when((at > 0) & (at < n), F.get("free", at - 1)), "last_slot": F.get("free", n - 1)})
    final = F.create_map(*(F.lit(x) for pool, ns in POOLS.items() for x in (pool, f"{pool.split(':')[0]}:{ns[-1]}")))
    slot = F.when(F.col("pool").isNull(), F.col("target")).otherwise(F.coalesce("own_slot", "last_slot", F.try_element_at(final, F.col("pool"))))
    return met.withColumns({"slot": slot, "in_last": F.col("pool").isNotNull() & F.col("own_slot").isNull()}).drop("own_slot", "last_slot", "caption", "captions", "free")


def takes_caption(line: Column) -> Column:
    """Whether a line is one of those that are named by what is booked to them."""
    sheet, n = F.substring_index(line, ":", 1), F.substring_index(line, ":", -1).try_cast("int")
    ok = F.lit(False)
    for name, ranges in OWN_CAPTION.items():
        for a, b in ranges:
            ok = ok | ((sheet == name) & n.between(a, b))
    return F.coalesce(ok, F.lit(False))


def map_captions(rows: DataFrame, rules: DataFrame, overrides: DataFrame, names: DataFrame) -> Mapped:
    """Book ``rows`` (row_id, entity_id, doc_id, page, ord, label, vals, years, cy, py, kind, feed) to lines.

    ``rules`` (rule_ord, kw_ord, kw, target), ``overrides`` (entity_id, label, target; one for a label), ``names`` (entity_id,
    name) of the entity's group. ``row_id`` tells rows apart, ``ord`` is their order within an entity. Fates: skipped subtotals;
    unassigned by a user; unmatched; ambiguous (several numbers without years); no value of the case's years; counted once
    (all its values stand on an earlier page of the document); booked. Equal values are compared before a tax line turns
    their sign. The rows are written once before what reads them, the decided rows once more for all four results.
    """
    rows = materialize(rows, "captions-rows")
    decided = decide_targets(rows, rules, overrides, names)
    routed = route_years(decided.withColumn("is_balance", F.coalesce(F.col("target").startswith("balance"), F.lit(False))))
    fate = (
        F.when(F.col("target") == "SKIP", SKIPPED)
        .when(F.col("target").isNull(), F.when(F.col("own"), UNASSIGNED).otherwise(UNMATCHED))
        .when(F.col("ambiguous"), AMBIGUOUS)
        .when(F.size("routes") == 0, NO_VALUE)
        .otherwise(BOOKED)
    )
    judged = routed.select("row_id", "entity_id", "doc_id", "page", "ord", "label", "feed", "target", "own", "related", "routes", fate.alias("fate"))
    judged = materialize(judged, "captions-judged")
    placed = place_in_pools(judged.where(F.col("fate") == BOOKED), overrides)
    values = placed.select("row_id", "entity_id", "doc_id", "page", "ord", "label", "own", "related", "pool", "in_last", F.col("slot").alias("target"), F.inline("routes"))
    first = F.first("page").over(Window.partitionBy("entity_id", "target", "doc_id", F.lower("label"), "value", "field").orderBy("ord", "row_id"))
    values = values.withColumn("again", F.coalesce(F.col("page") != first, F.lit(False)))
    booked = F.when((F.col("field") == "amount") & F.col("target").isin(TAX_LINES) & (F.col("value") > 0), -F.col("value")).otherwise(F.col("value"))
    values = materialize(values.withColumn("booked", booked), "captions-values")
    once = values.groupBy("row_id").agg(F.min("again").alias("again"), F.min("target").alias("slot"))
    fates = judged.join(once, "row_id", "left").select("row_id", "entity_id", "doc_id", "page", "label", "feed", F.coalesce("slot", "target").alias("target"), F.when(F.col("again"), REPEATED).otherwise(F.col("fate")).alias("fate"))
    contributions = values.where("not again").select("row_id", "entity_id", "doc_id", "page", "ord", "label", "target", "field", F.col("booked").alias("value"), "year")
    # a pool's line is named by its caption, its last line by how many rows it takes; a chosen line by its first caption
    per_row = values.groupBy("entity_id", "target", "row_id").agg(F.min("ord").alias("ord"), F.min("label").alias("label"), F.max("in_last").alias("in_last"), F.max(F.col("pool").isNotNull()).alias("pooled"))
    names_ = per_row.where(F.col("pooled") | takes_caption(F.col("target"))).groupBy("entity_id", "target").agg(F.min(F.when(F.col("pooled"), F.struct("ord", "row_id", "label"))).alias("p"), F.min(F.struct("ord", "row_id", "label")).alias("a"), F.count_if("in_last").alias("k"))
    relabels = names_.select("entity_id", "target", F.when(F.col("k") > 1, F.concat(F.lit("Other ("), F.col("k"), F.lit(" items)"))).otherwise(F.coalesce("p.label", "a.label")).alias("label"), F.col("k").alias("items"))
    item = lambda df, level, category: df.select("entity_id", F.lit(level).alias("level"), F.lit(category).alias("category"), "target", "label", "n")
    rows_of = lambda df: df.select("row_id", "entity_id", "target", "label").distinct().groupBy("entity_id", "target", "label").agg(F.count("*").alias("n"))
    review = (
        item(rows_of(values.where("related")), "warn", "related-party")
        .unionByName(item(rows_of(values.where("again")), "info", "counted-once"))
        .unionByName(item(rows_of(values.where("booked <> value")), "warn", "tax-sign"))
        .unionByName(item(relabels.where("items > 1").withColumn("n", F.col("items")), "info", "pool"))
    )
    return Mapped(fates, contributions, relabels.select("entity_id", "target", "label"), review)
