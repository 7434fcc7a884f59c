"""Ordered logs of users' edits, replayed against stored state: captions moved between lines, review items signed off.

What an edit does depends on those before it, but only on those of the same caption or item, or of the same cell. So each
contribution, item and cell goes through its own part of the log: an array of edits folded on the row, or a window over a cell.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import norm
from tallyloom.operators.mapping import line_edits
from tallyloom.session import materialize

FIELDS = ("amount", "boy", "eoy")
#: Fixed value: cells of figures that a review item can name, with sheet, column and row.
CELL = r"^(income|balance)!([DF])(\d+)$"


class Remapped(NamedTuple):
    """``contributions`` as they are booked now, ``unassigned`` (entity_id, label, seq), ``lines`` with their figures now, ``log``:
    the edits with status and numbers of values moved and dropped, ``overrides``: the standing target of each caption."""

    contributions: DataFrame
    unassigned: DataFrame
    lines: DataFrame
    log: DataFrame
    overrides: DataFrame


def _sheet(target: Column) -> Column:
    return F.substring_index(target, ":", 1)


def remap_contributions(contributions: DataFrame, lines: DataFrame, edits: DataFrame, valid: DataFrame) -> Remapped:
    """Move captions' contributions (entity_id, target, label, field, value, ...) as ``edits`` (entity_id, seq, label,
    from_target, to_target) say, in order of ``seq`` within an entity.

    An edit moves all that its caption has on the line then; a null target takes it off. It does nothing if the line has
    nothing of the caption, if the target isn't ``valid`` (target) or is the line itself, and it is refused if the line was
    edited by hand: its figures differ from its contributions, a missing figure counting as 0. That doesn't change by moves:
    what goes in raises figures and contributions alike, and nothing goes out of an edited line. Values of the year before are
    dropped on the way to an income line, closing values and amounts turn into each other. ``lines`` are (entity_id, target,
    amount, boy, eoy). A null label is a caption like others.
    """
    by_hand = line_edits(lines, contributions).where("edited").select("entity_id", F.col("target").alias("from_target"), F.lit(True).alias("by_hand"))
    by_hand = materialize(by_hand, "by-hand")  # edits and figures both ask for it
    known = valid.select(F.col("target").alias("to_target"), F.lit(True).alias("is_valid")).distinct()
    asked = edits.join(by_hand, ["entity_id", "from_target"], "left").join(known, "to_target", "left")
    refused, wrong = F.coalesce("by_hand", F.lit(False)), (F.col("to_target").isNotNull() & F.col("is_valid").isNull()) | F.coalesce(F.col("to_target") == F.col("from_target"), F.lit(False))
    asked = asked.select("entity_id", "seq", "label", "from_target", "to_target", refused.alias("refused"), wrong.alias("wrong"))
    # edits of one caption are few
    plans = asked.where("not refused and not wrong").groupBy(F.col("entity_id").alias("__e"), F.col("label").alias("__l")).agg(F.sort_array(F.collect_list(F.struct("seq", "from_target", "to_target"))).alias("__plan"))
    met = contributions.join(plans, F.col("entity_id").eqNullSafe(F.col("__e")) & F.col("label").eqNullSafe(F.col("__l")), "left")

    def step(state: Column, e: Column) -> Column:
        here = state["target"] == e["from_target"]
        sheet = _sheet(e["to_target"])
        drop = (sheet == "income") & (state["field"] == "boy")
        field = F.when((sheet == "income") & (state["field"] == "eoy"), "amount").when((sheet == "balance") & (state["field"] == "amount"), "eoy").otherwise(state["field"])
        gone = e["to_target"].isNull() | drop
        move = F.struct(e["seq"].alias("seq"), F.coalesce(drop, F.lit(False)).alias("dropped"), e["to_target"].isNull().alias("off"))
        return F.when(F.coalesce(here, F.lit(False)), F.struct(F.when(~F.coalesce(gone, F.lit(False)), e["to_target"]).alias("target"), field.alias("field"), F.concat(state["moves"], F.array(move)).alias("moves"))).otherwise(state)

    start = F.struct(F.col("target").alias("target"), F.col("field").alias("field"), F.array().cast(f"array<struct<seq:{edits.schema['seq'].dataType.simpleString()},dropped:boolean,off:boolean>>").alias("moves"))
    done = met.withColumn("__s", F.when(F.col("__plan").isNull(), start).otherwise(F.aggregate(F.coalesce("__plan", F.array()), start, step)))
    own = [c for c in contributions.columns if c not in ("target", "field")]
    now = done.select(*own, F.col("__s.target").alias("target"), F.col("__s.field").alias("field")).where("target is not null").select(*contributions.columns)
    moves = done.select("entity_id", "label", F.inline("__s.moves"))
    counts = moves.groupBy(F.col("entity_id").alias("__e"), "seq").agg(F.count_if(~F.col("dropped")).alias("moved"), F.count_if("dropped").alias("dropped"))
    log = asked.join(counts, F.col("entity_id").eqNullSafe(F.col("__e")) & (asked["seq"] == counts["seq"]), "left").drop("__e", counts["seq"])
    empty = F.col("moved").isNull()
    status = F.when(F.col("wrong"), "no such line").when(F.col("refused"), "edited by hand").when(empty, "nothing to move").when(F.col("to_target").isNull(), "unassigned").otherwise("moved")
    log = log.select("entity_id", "seq", "label", "from_target", "to_target", status.alias("status"), F.coalesce("moved", F.lit(0)).alias("moved"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
    applied = log.where(F.col("status").isin("moved", "unassigned"))
    overrides = applied.groupBy("entity_id", norm(F.col("label")).alias("label")).agg(F.max_by("to_target", "seq").alias("target"))
    # figures now: those before, less what was booked, plus what is booked; a line without contributions and typed figures has none
    total = lambda df, sign: df.groupBy("entity_id", "target").agg(*(F.sum(F.when(F.col("field") == f, sign * F.col("value"))).alias(f) for f in FIELDS))
    hand = by_hand.select("entity_id", F.col("from_target").alias("target"), "by_hand")
    typed = lines.select("entity_id", "target", *FIELDS).join(hand, ["entity_id", "target"], "left_semi").unionByName(total(contributions.join(hand, ["entity_id", "target"], "left_semi"), F.lit(-1)))
    booked = typed.unionByName(total(now, F.lit(1))).groupBy("entity_id", "target").agg(*(F.round(F.sum(f), 2).alias(f) for f in FIELDS))
    return Remapped(now, moves.where("off").select("entity_id", "label", "seq").distinct(), booked, log, overrides)


class Resolved(NamedTuple):
    """``items`` with their sign-off now, ``writes`` with their values now, ``cells``: figures that edits staged on lines."""

    items: DataFrame
    writes: DataFrame
    cells: DataFrame


def typed_value(raw: Column) -> Column:
    """What a user typed as text: a number in its shortest form, without separators, if it is one."""
    n = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    plain = F.when(n == n.cast("long"), n.cast("long").cast("string")).otherwise(n.cast("string"))
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e15), plain).otherwise(raw)


def resolve_review_edits(items: DataFrame, writes: DataFrame, lines: DataFrame, log: DataFrame) -> Resolved:
    """Replay sign-offs ``log`` (entity_id, id, seq, action, value, note) on ``items`` (entity_id, id, target, stored) and the
    values that hang on them.

    ``dismiss`` signs an item off. ``edit`` signs it off with a value: its ``writes`` (entity_id, review_id, ord, value) take it;
    an item without writes whose target is a cell stages a number on that line's figure (``lines``: entity_id, target, amount,
    boy, eoy); else the edit is a note. ``restore`` of a stored item takes the sign-off back and gives its writes the value
    that they had before the last edit. The value before an edit is that of the first write, or what the cell held then,
    after edits of any item. ``seq`` orders the log of an entity.
    """
    keys = ["entity_id", "id"]
    linked = writes.groupBy("entity_id", F.col("review_id").alias("id")).agg(F.min(F.struct("ord", "value"))["value"].alias("write"), F.lit(True).alias("linked"))
    known = items.join(linked, keys, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    part = lambda i: F.regexp_extract("target", CELL, i)
    cell = F.when(F.col("target").rlike(CELL) & ~F.col("linked"), F.concat(part(1), F.lit(":"), part(3)))
    field = F.when(part(1) == "income", "amount").when(part(2) == "D", "boy").otherwise("eoy")
    known = known.withColumns({"line": cell, "field": F.when(cell.isNotNull(), field)})
    events = log.join(known.select(*keys, "line", "field", "linked"), keys).withColumn("value", F.when(F.col("action") == "edit", typed_value(F.col("value"))))
    lands = (F.col("action") == "edit") & F.col("line").isNotNull() & F.col("value").try_cast("double").isNotNull()
    figures = lines.select("entity_id", F.col("target").alias("line"), F.stack(F.lit(3), *(x for f in FIELDS for x in (F.lit(f), F.col(f)))).alias("field", "held"))
    staged = events.where(lands).join(figures, ["entity_id", "line", "field"], "left")
    in_cell = Window.partitionBy("entity_id", "line", "field").orderBy("seq")
    held = F.when(F.col("held").isNotNull(), typed_value(F.col("held").cast("string")))
    staged = staged.withColumn("before", F.coalesce(F.lag("value").over(in_cell), held)).withColumn("last", F.row_number().over(Window.partitionBy("entity_id", "line", "field").orderBy(F.col("seq").desc())) == 1)
    cells = staged.where("last").select("entity_id", F.col("line").alias("target"), "field", F.col("value").cast("double").alias("value"))
    events = events.join(staged.select(*keys, "seq", "before"), [*keys, "seq"], "left")
    told = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "action", "value", "note", "before"))).alias("log"))

    def step(s: Column, e: Column) -> Column:
        is_edit, is_off = e["action"] == "edit", e["action"] == "dismiss"
        back = (e["action"] == "restore") & s["stored"]
        prior = F.when(s["linked"], s["write"]).otherwise(e["before"])
        note = F.coalesce(e["note"], F.lit(""))
        none = F.lit(None).cast("string")
        reverts = back & (s["resolution"] == "edited") & s["prior"].isNotNull() & s["linked"]
        pick = lambda edit, off, restored, else_: F.when(is_edit, edit).when(is_off, off).when(back, restored).otherwise(else_)
        return F.struct(
            pick(F.lit(True), F.lit(True), F.lit(False), s["dismissed"]).alias("dismissed"),
            pick(note, note, F.lit(""), s["note"]).alias("note"),
            pick(F.lit("edited"), s["resolution"], none, s["resolution"]).alias("resolution"),
            pick(e["value"], s["edited"], none, s["edited"]).alias("edited"),
            pick(prior, s["prior"], none, s["prior"]).alias("prior"),
            (s["stored"] | is_edit | is_off).alias("stored"),
            s["linked"].alias("linked"),
            F.when(is_edit & s["linked"], e["value"]).when(F.coalesce(reverts, F.lit(False)), s["prior"]).otherwise(s["write"]).alias("write"),
            (s["touched"] | (is_edit & s["linked"])).alias("touched"),
        )

    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit(False).alias("dismissed"), F.lit("").alias("note"), none.alias("resolution"), none.alias("edited"), none.alias("prior"), F.coalesce("stored", F.lit(False)).alias("stored"), F.col("linked").alias("linked"), F.col("write").alias("write"), F.lit(False).alias("touched"),
    )
    done = known.join(told, keys, "left").withColumn("s", F.when(F.col("log").isNull(), start).otherwise(F.aggregate(F.coalesce("log", F.array()), start, step)))
    now = done.select(*keys, "target", "s.dismissed", "s.note", "s.resolution", F.col("s.edited").alias("edited_value"), F.col("s.prior").alias("prior_value"), "s.stored")
    changed = done.where("s.touched").select("entity_id", F.col("id").alias("review_id"), F.col("s.write").alias("__now"), F.lit(True).alias("__set"))
    kept = writes.join(changed, ["entity_id", "review_id"], "left").withColumn("value", F.when(F.col("__set"), F.col("__now")).otherwise(F.col("value"))).drop("__now", "__set")
    return Resolved(now, kept, cells)
