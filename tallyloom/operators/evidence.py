"""Kinds and years of documents, evidence of captions, duplicates within an entity, sign-offs and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import exact_sum


def doc_kind(pages: DataFrame, priority: list[str]) -> DataFrame:
    """The first kind in ``priority`` that any page of a document has, else unknown; confidence is the share of placed pages."""
    has = [F.when(F.bool_or(F.col("kind") == k), k) for k in priority]
    placed = F.coalesce(F.avg((F.col("kind") != "unknown").cast("double")), F.lit(0.0))
    return pages.groupBy("doc_id").agg(F.coalesce(*has, F.lit("unknown")).alias("kind"), F.round(placed, 6).alias("confidence"))


def statement_year(votes: DataFrame, first: int = 2000, last: int = 2035) -> DataFrame:
    """``votes`` (doc_id, year, weight, pos): the year within bounds with most votes; of equal ones the one seen first."""
    sums = votes.where(F.col("year").between(first, last)).groupBy("doc_id", "year").agg(F.sum("weight").alias("votes"), F.min("pos").alias("__pos"))
    return sums.groupBy("doc_id").agg(F.max_by("year", F.struct("votes", -F.col("__pos"))).alias("year"), F.max("votes").alias("votes"))


def caption_evidence(rows: DataFrame) -> DataFrame:
    """Per (entity_id, target, label) the sum of the newest year and all years' sums, newest first, as "v (year) · v (year)"."""
    years = rows.groupBy("entity_id", "target", "label", "year").agg(F.round(exact_sum(F.col("value"))).cast("bigint").alias("v"))
    listed = F.sort_array(F.collect_list(F.struct("year", "v")), asc=False)
    shown = F.array_join(F.transform(listed, lambda x: F.concat(x.v.cast("string"), F.lit(" ("), x.year.cast("string"), F.lit(")"))), " · ")
    return years.groupBy("entity_id", "target", "label").agg(F.max_by("v", "year").alias("current"), shown.alias("display"))


def evidence_stats(rows: DataFrame) -> DataFrame:
    """Per entity: captions, those not in English, those bound, and the share bound in whole percent, halves up."""
    made = rows.groupBy("entity_id").agg(F.count("*").alias("captions"), F.count_if(F.col("lang") != "en").alias("foreign"), F.count_if(F.col("bound")).alias("bound"))
    return made.withColumn("percent", F.floor(100 * F.col("bound") / F.col("captions") + 0.5))


def boy_tie_out(lines: DataFrame, filed: DataFrame, rates: DataFrame) -> DataFrame:
    """Opening balances in USD, rounded, within 1 of what was filed; without a positive rate ``ties`` is null."""
    usd = F.floor(F.when(F.col("rate") > 0, F.col("boy") / F.col("rate")) + 0.5)
    joined = lines.join(filed, ["entity_id", "target"]).join(rates, "entity_id", "left")
    return joined.select("entity_id", "target", usd.alias("usd"), "filed", (F.abs(usd - F.col("filed")) <= 1).alias("ties"))


def duplicate_documents(values: DataFrame, least: int = 5, jaccard: float = 0.8, containment: float = 0.9) -> DataFrame:
    """Pairs of an entity's documents whose distinct values are alike: (entity_id, a, b, shared, a < b).

    ``values`` are (entity_id, doc_id, value). Only documents with ``least`` values take part. Pairs come from shared values
    within one entity; values are never matched across entities. Equal sets are one class (a 64-bit hash of the values in order
    tells them), so shared values are counted once for two classes, and then handed to the pairs of their documents.
    """
    held = values.where("value is not null").groupBy("entity_id", "doc_id").agg(F.sort_array(F.collect_set("value")).alias("v")).where(F.size("v") >= least)
    docs = held.withColumn("class", F.xxhash64(F.size("v"), "v"))
    classes = docs.groupBy("entity_id", "class").agg(F.min_by("v", "doc_id").alias("v"))
    each = classes.select("entity_id", F.col("class").alias("c"), F.size("v").alias("n"), F.explode("v").alias("value"))
    other = each.select("entity_id", "value", F.col("c").alias("d"), F.col("n").alias("m"))
    met = each.join(other, ["entity_id", "value"]).where("c < d").groupBy("entity_id", "c", "d", "n", "m").agg(F.count("*").alias("shared"))
    alike = (F.col("shared") >= jaccard * (F.col("n") + F.col("m") - F.col("shared"))) | (F.col("shared") >= containment * F.least("n", "m"))
    # a class is like itself, whatever is asked for up to the whole
    equal = classes.select("entity_id", F.col("class").alias("c"), F.col("class").alias("d"), F.size("v").cast("long").alias("shared"))
    equal = equal.where((F.col("shared") >= jaccard * F.col("shared")) | (F.col("shared") >= containment * F.col("shared")))
    pairs = met.where(alike).select("entity_id", "c", "d", "shared").unionByName(equal)
    side = lambda x, of: docs.select("entity_id", F.col("class").alias(of), F.col("doc_id").alias(x))
    found = pairs.join(side("x", "c"), ["entity_id", "c"]).join(side("y", "d"), ["entity_id", "d"]).where((F.col("c") < F.col("d")) | (F.col("x") < F.col("y")))
    return found.select("entity_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def carry_sign_offs(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """Items of a new run with the dismissals and edited values of the earlier one, by entity and id."""
    before = earlier.select("entity_id", "id", F.col("dismissed").alias("__d"), F.col("edited").alias("__e"))
    joined = items.join(before, ["entity_id", "id"], "left")
    return joined.withColumn("dismissed", F.coalesce("__d", F.lit(False))).withColumn("value", F.coalesce("__e", "value")).drop("__d", "__e")


def unpivot_rate_sheet(sheet: DataFrame, code: str, years: dict[str, int]) -> DataFrame:
    """A sheet with a column a year as (code, year, rate); rates that are not positive are left out."""
    cells = F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.col(c).cast("double").alias("rate")) for c, y in years.items())))
    return sheet.select(F.col(code).alias("code"), cells.alias("c")).select("code", "c.year", "c.rate").where("rate > 0")


def build_writes(facts: DataFrame, schedules: DataFrame) -> DataFrame:
    """Writes (sheet, ref, value): the last fact by ``ord`` for each cell; a schedule fills only cells that are blank or missing."""
    cells = facts.groupBy("sheet", "ref").agg(F.max_by("value", "ord").alias("value"))
    added = schedules.groupBy("sheet", "ref").agg(F.min_by("value", "ord").alias("add"))
    return cells.join(added, ["sheet", "ref"], "full").select("sheet", "ref", F.coalesce(F.when(F.trim("value") != "", F.col("value")), "add", "value").alias("value"))
