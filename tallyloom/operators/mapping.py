"""Captions to statement lines: rules, feeds, counting once, sums and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import js_round, norm
from tallyloom.session import materialize

#: Keywords of at least so many letters also match with up to three more letters behind them.
STEM_LETTERS = 5
STEM_TAIL = 3
#: Keywords with a character beyond this one match wherever they stand.
LAST_LATIN = "\u024f"


def rule_patterns(rules: DataFrame) -> DataFrame:
    """Rules (rule_ord, kw_ord, kw, target) with ``low``, ``pattern`` (null where the keyword has only to be contained) and
    ``key``: the keyword's first word with a "w" before, or its first character with a "c" before."""
    low = F.lower("kw")
    escaped = F.regexp_replace(low, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    tail = F.when(F.length(low) >= STEM_LETTERS, F.lit(rf"\p{{L}}{{0,{STEM_TAIL}}}")).otherwise(F.lit(""))
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}])"), escaped, tail, F.lit(r"($|[^\p{L}\p{N}])"))
    within = low.rlike(f"[^\\x00-{LAST_LATIN}]")
    word = F.regexp_extract(low, r"^[\p{L}\p{N}]+", 0)
    key = F.when(within | (word == ""), F.concat(F.lit("c"), F.substring(low, 1, 1))).otherwise(F.concat(F.lit("w"), word))
    return rules.where(low != "").select("rule_ord", "kw_ord", "target", low.alias("low"), F.when(~within, pattern).alias("pattern"), key.alias("key"))


def match_rules(captions: DataFrame, rules: DataFrame) -> DataFrame:
    """``captions`` with ``target`` of the longest keyword in the label; ties go to the first rule and keyword.

    Keywords stand between characters that are neither letters nor digits, those of STEM_LETTERS or more with up to STEM_TAIL
    letters more; keywords in other scripts than Latin match wherever they stand. Distinct labels meet rules in an equi-join
    on the keyword's first word (or, without one, character); only what meets is tested. The answers are written once and join
    back by label: their size is known then, so that few labels are broadcast and a common label's captions stay where they are.
    """
    labels = captions.select(F.lower("label").alias("label")).where("label is not null").distinct()
    words = F.array_distinct(F.regexp_extract_all("label", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.least(F.lit(STEM_TAIL), F.length(w) - 1)), lambda i: F.concat(F.lit("w"), F.left(w, F.length(w) - i)))))
    chars = F.transform(F.array_distinct(F.filter(F.split("label", ""), lambda x: x != "")), lambda x: F.concat(F.lit("c"), x))
    asked = labels.withColumn("key", F.explode(F.array_distinct(F.concat(stems, chars))))
    hits = asked.join(rule_patterns(rules), "key").where(F.when(F.col("pattern").isNull(), F.contains("label", "low")).otherwise(F.regexp_like("label", F.col("pattern"))))
    best = hits.groupBy("label").agg(F.max_by("target", F.struct(F.length("low"), -F.col("rule_ord"), -F.col("kw_ord"))).alias("target"))
    best = materialize(best.withColumnRenamed("label", "__label"), "labels-matched")
    return captions.join(best, F.lower(captions["label"]) == F.col("__label"), "left").drop("__label")


def skip_subtotals(matched: DataFrame) -> DataFrame:
    return matched.where("target is null or target <> 'SKIP'")


def apply_overrides(matched: DataFrame, overrides: DataFrame) -> DataFrame:
    """A user's target for a caption beats the rule; a null target unassigns it."""
    own = overrides.select("entity_id", norm(F.col("label")).alias("__low"), F.col("target").alias("__own"), F.lit(True).alias("__has"))
    joined = matched.withColumn("__key", norm(F.col("label"))).join(own.withColumnRenamed("entity_id", "__entity"), (F.col("entity_id") == F.col("__entity")) & (F.col("__key") == F.col("__low")), "left")
    return joined.withColumn("target", F.when(F.col("__has"), F.col("__own")).otherwise(F.col("target"))).drop("__key", "__low", "__own", "__has", "__entity")


def feed_scope(matched: DataFrame) -> DataFrame:
    """Income pages reach income lines only, balance pages balance lines only; other targets become null."""
    ok = ((F.col("feed") == "is") & F.col("target").startswith("income")) | ((F.col("feed") == "bs") & F.col("target").startswith("balance"))
    return matched.withColumn("target", F.when(ok, F.col("target")))


def count_once(routed: DataFrame) -> DataFrame:
    """Rows of the same caption, value and field on another page of a document than the first are dropped."""
    key = Window.partitionBy("entity_id", "target", "doc_id", F.lower("label"), "value", "field").orderBy("ord")
    return routed.withColumn("__first", F.first("page").over(key)).where(F.col("page").isNull() | (F.col("page") == F.col("__first"))).drop("__first")


def sum_lines(contributions: DataFrame) -> DataFrame:
    """(entity_id, target, amount, boy, eoy); a field without contributions is NULL."""
    total = lambda f: F.round(F.sum(F.when(F.col("field") == f, F.col("value"))), 2).alias(f)
    return contributions.groupBy("entity_id", "target").agg(*(total(f) for f in ("amount", "boy", "eoy")))


def multi_source(contributions: DataFrame) -> DataFrame:
    """(entity_id, target, captions, multi): lines fed by more than one caption."""
    return contributions.groupBy("entity_id", "target").agg(F.count_distinct(F.lower("label")).alias("captions")).withColumn("multi", F.col("captions") > 1)


def line_edits(lines: DataFrame, contributions: DataFrame) -> DataFrame:
    """(entity_id, target, edited): the line differs from its contributions by more than 0.01 on a field."""
    sums = sum_lines(contributions).select("entity_id", "target", *(F.col(f).alias(f"s_{f}") for f in ("amount", "boy", "eoy")))
    both = lines.join(sums, ["entity_id", "target"], "full")
    off = [F.abs(F.coalesce(F.col(f), F.lit(0.0)) - F.coalesce(F.col(f"s_{f}"), F.lit(0.0))) > 0.01 for f in ("amount", "boy", "eoy")]
    return both.select("entity_id", "target", (off[0] | off[1] | off[2]).alias("edited"))


def translate_usd(lines: DataFrame, fx: DataFrame) -> DataFrame:
    """Income by the average rate, closing by this year's spot, opening by last year's; missing or zero rates give NULL."""
    rate = lambda v, r: F.when(F.col(r) > 0, js_round(F.col(v) / F.col(r), 2))
    return lines.join(fx, "entity_id", "left").select("entity_id", "target", rate("amount", "avg_rate").alias("amount_usd"), rate("boy", "py_rate").alias("boy_usd"), rate("eoy", "cy_rate").alias("eoy_usd"))


def schedule_subtotals(lines: DataFrame) -> DataFrame:
    """Lines and total amount a schedule, with a grand total under a null schedule."""
    return lines.withColumn("schedule", F.substring_index("target", ":", 1)).rollup("schedule").agg(F.count("*").alias("n_lines"), F.round(F.sum("amount"), 2).alias("amount"))
