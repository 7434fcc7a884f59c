"""Facts that were read from documents that an entity no longer has."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes a label the name of a document, and the key of categories that were ticked.
DOCUMENT = r"(?i)\.(pdf|xlsx|xlsm|xls|csv)"
CATEGORY = "cat:"


class Pruned(NamedTuple):
    """``detected`` and ``holders`` that stay, ``profile`` with blanks where a value was only detected, ``tombstones`` (entity_id,
    key) of what went, ``reset`` (entity_id): entities whose currency has to be confirmed and rates looked up again."""

    detected: DataFrame
    profile: DataFrame
    holders: DataFrame
    tombstones: DataFrame
    reset: DataFrame


def _begun_by(rows: DataFrame, label: str, files: DataFrame) -> DataFrame:
    """(entity_id, label): distinct labels of ``rows`` that begin with the name of one of their entity's files.

    A label's beginnings meet names in an equi-join; a label has as many of them as characters, and each is asked once.
    """
    labels = rows.select("entity_id", label).where(F.col(label).isNotNull()).distinct()
    begins = labels.select("entity_id", label, F.explode(F.transform(F.sequence(F.lit(0), F.length(label)), lambda n: F.left(F.col(label), n))).alias("name"))
    return begins.join(files.select("entity_id", "name").distinct(), ["entity_id", "name"], "left_semi").select("entity_id", label).distinct()


def _marked(rows: DataFrame, label: Column, doc: Column, files: DataFrame) -> DataFrame:
    """``rows`` with ``__kept``: they cite no document, or one that is still there (``doc`` by its name, else ``label``)."""
    asked = rows.withColumns({"__doc": doc, "__label": F.when(doc.isNull() & label.rlike(DOCUMENT), label)})
    there = files.select("entity_id", F.col("name").alias("__doc"), F.lit(True).alias("__has")).distinct()
    begun = _begun_by(asked, "__label", files).withColumn("__begins", F.lit(True))
    met = asked.join(there, ["entity_id", "__doc"], "left").join(begun, ["entity_id", "__label"], "left")
    kept = F.when(F.col("__doc").isNotNull(), F.coalesce("__has", F.lit(False))).when(F.col("__label").isNotNull(), F.coalesce("__begins", F.lit(False))).otherwise(True)
    return met.withColumn("__kept", kept).select(*(F.col(c) for c in rows.columns), "__kept")


def prune_stale(detected: DataFrame, files: DataFrame, profile: DataFrame, holders: DataFrame) -> Pruned:
    """Drop what was detected in documents that are gone, and blank the values that rest on it.

    ``detected`` (entity_id, key, value, label, doc) says where a value was found: in the document ``doc``, else as its label
    says, which names a document if it looks like one and cites it if it begins with the name; what cites no document stays.
    ``files`` are (entity_id, name), ``profile`` (entity_id, bucket, key, value) holds the profile, the ownership and, under
    the bucket category, ticked categories ("Yes"). A value goes only where it equals the detected one, so typed values stay, and of a
    key in both the profile has precedence; a category is unticked in any case. ``holders`` (entity_id, source, ...) go with their source.
    """
    marked = _marked(detected, F.col("label"), F.col("doc"), files)
    gone = marked.where("not __kept").select("entity_id", "key", "value")
    is_category = F.col("key").startswith(CATEGORY)
    names = F.when(is_category, F.substring("key", len(CATEGORY) + 1, 1 << 20)).otherwise(F.col("key"))
    stale = gone.select("entity_id", names.alias("key"), is_category.alias("__cat"), F.col("value").alias("__was"), F.lit(True).alias("__gone"))
    asked = profile.withColumn("__cat", F.col("bucket") == "category")
    met = asked.join(stale, ["entity_id", "key", "__cat"], "left")
    equal = F.coalesce(F.col("__gone"), F.lit(False)) & (F.col("__cat") | F.coalesce(F.col("value") == F.col("__was"), F.lit(False)))
    first = met.where(equal & (F.col("bucket") == "profile")).select("entity_id", "key", F.lit(True).alias("__first"))
    met = met.withColumn("__blank", equal).join(first, ["entity_id", "key"], "left")
    blank = F.col("__blank") & ((F.col("bucket") != "ownership") | F.col("__first").isNull())
    now = met.select("entity_id", "bucket", "key", F.when(blank, F.lit("")).otherwise(F.col("value")).alias("value"), blank.alias("__blank"))
    reset = now.where("__blank and bucket = 'profile' and key = 'currency'").select("entity_id").distinct()
    begun = _begun_by(holders, "source", files).withColumn("__begins", F.lit(True))
    staying = holders.join(begun, ["entity_id", "source"], "left").where("coalesce(source, '') = '' or __begins").select(*holders.columns)
    return Pruned(marked.where("__kept").drop("__kept"), now.drop("__blank"), staying, gone.select("entity_id", "key"), reset)
