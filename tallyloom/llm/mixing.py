"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

MAX_EPOCHS = 3
BUCKET_DOCS = 4096
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, seed: int) -> Column:
    """The seeded order of a source's documents: a hex digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, ...) with weights 1, 2, 3, 1, ... by source and targets that share the total size.

    A target stops at max_epochs times its source's size; what is above goes to the others by weight until none is above.
    In closed form: by rising cap per weight, the sources before the first whose share of the rest is under its cap are capped.
    A row here is a source, so the windows without a key see as many rows as there are sources.
    """
    ordered = sources.withColumn("weight", F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(3)) + 1)
    capped = ordered.withColumn("cap", F.col("size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = capped.withColumns({
        "left": F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "place": F.row_number().over(fill),
    })
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("open")
    level = state.withColumns({"at": F.min(F.when(fits, F.col("place"))).over(whole)}).withColumns({
        "rest": F.max(F.when(F.col("place") == F.col("at"), F.col("left"))).over(whole),
        "sum_open": F.max(F.when(F.col("place") == F.col("at"), F.col("open"))).over(whole),
    })
    share = (F.col("rest") * F.col("weight")).cast("double") / F.col("sum_open").cast("double")
    return level.withColumn("target", F.when(F.col("place") < F.col("at"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))).select(*sources.columns, "weight", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken`` (size times repeats).

    Each document of a source is taken floor(target / source size) times; in seeded order, documents are taken once more
    while the middle of the document lies within what is still missing, so a source misses its target by at most half of one
    document. A source larger than one task is split into buckets of the seeded order; sums of whole buckets come first.
    Results by case: null or empty texts have size 0 and count for nothing; a null source is a source, ordered last; sources
    without words have target 0; ids that repeat are told apart by size and text, equal rows are interchangeable. Columns
    of these names in the input are replaced.
    """
    spark = docs.sparkSession
    made = ("size", "source_size", "target", "repeats", "taken")
    base = docs.drop(*made)
    sized = base.withColumns({"__mx_size": word_count(F.col(text_col)), "__mx_draw": draw(id_col, seed), "__mx_tie": F.xxhash64(text_col)})
    slim = materialize(sized.select(F.col(source_col).alias("source"), F.col("__mx_size").alias("size"), F.col("__mx_draw").alias("draw")), "mix-sizes")
    sources = water_fill(slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), max_epochs)
    sources = sources.withColumns({
        "whole": F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs))).otherwise(0).cast("long"),
        "buckets": F.ceil(F.col("docs") / BUCKET_DOCS).cast("long"),
    }).withColumn("missing", F.col("target") - F.col("whole") * F.col("size"))
    sources = materialize(sources, "mix-sources")
    small = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)

    def bucket(hexed: str) -> Column:
        return F.floor(F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("buckets")).cast("long")

    joined = slim.join(small(sources.select(F.col("source").alias("name"), "buckets")), F.col("source").eqNullSafe(F.col("name")))
    sums = joined.groupBy("source", bucket("draw").alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("__mx_of"), F.col("bucket").alias("__mx_at"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("__mx_ahead"))
    plan = sources.select(F.col("source").alias("__mx_source"), F.col("size").alias("source_size"), "target", "whole", "buckets", "missing")
    rows = sized.join(small(plan), F.col(source_col).eqNullSafe(F.col("__mx_source"))).withColumn("__mx_bucket", bucket("__mx_draw"))
    rows = rows.join(offsets, F.col(source_col).eqNullSafe(F.col("__mx_of")) & (F.col("__mx_bucket") == F.col("__mx_at")))
    order = Window.partitionBy("__mx_of", "__mx_bucket").orderBy("__mx_draw", "__mx_size", "__mx_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__mx_ahead") + F.coalesce(F.sum("__mx_size").over(order), F.lit(0))
    more = (2 * before + F.col("__mx_size")).cast("double") <= 2 * F.col("missing")
    repeats = F.least(F.col("whole") + more.cast("long"), F.lit(max_epochs).cast("long"))
    out = rows.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("__mx_size"))
    return out.select(*(f"`{c}`" for c in base.columns), F.col("__mx_size").alias("size"), "source_size", "target", "repeats", "taken")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``repeats`` says."""
    return mixed.where("repeats > 0").withColumn("__mx_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).drop("__mx_copy")
