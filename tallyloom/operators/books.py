"""Rates by priority, edits of rates, ties between books, cascades and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import norm


def rate_chain(asked: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """``asked`` (code, year) with rate and source of the first source (code, year, rate) that has a rate; else both null."""
    named = [df.select("code", "year", "rate", F.lit(i).alias("p"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, named).where("rate > 0").groupBy("code", "year").agg(F.min_by(F.struct("rate", "source"), "p").alias("b"))
    return asked.join(best, ["code", "year"], "left").select(*asked.columns, "b.rate", "b.source")


def set_fx_overrides(rates: DataFrame, edits: DataFrame) -> DataFrame:
    """Rates (code, kind, year, rate) under edits of the same columns; a null or non-positive edit deletes its rate."""
    keys = ["code", "kind", "year"]
    laid = rates.join(edits.select(*keys, F.col("rate").alias("edit"), F.lit(True).alias("edited")), keys, "full")
    return laid.select(*keys, F.when(F.col("edited"), F.col("edit")).otherwise(F.col("rate")).alias("rate")).where("rate > 0")


def cash_paid_total(ledger: DataFrame) -> DataFrame:
    return ledger.where("details = 'cash paid'").groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum("source"), 2).alias("total"))


def ledger_tie_out(ledger: DataFrame, booked: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Per entity whether the ledger's invoices and credit notes agree with what is booked (entity_id, booked); null books count as 0."""
    sums = ledger.where("details <> 'cash paid'").groupBy("entity_id").agg(F.round(F.sum("source"), 2).alias("ledger"))
    both = sums.join(booked, "entity_id", "full").select("entity_id", F.coalesce("ledger", F.lit(0.0)).alias("ledger"), F.coalesce("booked", F.lit(0.0)).alias("booked"))
    return both.withColumn("ties", F.abs(F.col("ledger") - F.col("booked")) <= tolerance)


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not among ``deleted``."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def delete_set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """All children; a reference to a deleted parent becomes null."""
    gone = deleted.select(F.col(key).alias("__gone")).distinct()
    return children.join(gone, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def filter_supported(docs: DataFrame, extensions: list[str], most_bytes: int) -> DataFrame:
    """``docs`` (name, bytes) with status: accepted, unsupported or too large; nothing vanishes."""
    known = F.coalesce(F.lower(F.substring_index("name", ".", -1)).isin(extensions), F.lit(False))
    return docs.withColumn("status", F.when(~known, "unsupported").when(F.col("bytes") > most_bytes, "too large").otherwise("accepted"))


def learn_rules(rules: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rules (kw, target) with assigned captions of three letters or more that no rule has yet; the smallest target wins."""
    new = assigned.select(norm(F.col("kw")).alias("kw"), "target").where("length(kw) >= 3").groupBy("kw").agg(F.min("target").alias("target"))
    known = rules.select(norm(F.col("kw")).alias("kw")).distinct()
    return rules.select("kw", "target").unionByName(new.join(known, "kw", "left_anti"))


def portfolio_rollup(entities: DataFrame, orders: DataFrame) -> DataFrame:
    """Entities and documents of each portfolio and in all; orders are counted per entity before they are joined."""
    counts = orders.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("open")).alias("o"))
    joined = entities.join(counts, "entity_id", "left")
    return joined.rollup("portfolio").agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("o"), F.lit(0)).alias("open"))


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows of one page, with its number within 1 and the last page; a top-k, not a sort of everything, for early pages."""
    pages = max(1, -(-rows.count() // size))
    page = min(max(page, 1), pages)
    return rows.orderBy(*order).limit(page * size).offset((page - 1) * size).withColumns({"page": F.lit(page), "pages": F.lit(pages)})


def validate_entities(facts: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(entity_id, check) for every SQL condition in ``checks`` that holds for an entity; null conditions don't."""
    hits = F.array(*(F.when(F.expr(sql), name) for name, sql in checks.items()))
    return facts.select("entity_id", F.explode(F.array_compact(hits)).alias("check"))
