"""Delimited text files as cells, however many splits a file is read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

SUFFIXES = ("csv", "tsv", "txt")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, line): every line with the split that it comes from and a number that grows within it."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for s in SUFFIXES for x in (s, s.upper())) + "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line"))


def cell_text(c: Column) -> Column:
    """A cell without one quotation mark at each end and without blanks around."""
    return F.trim(F.regexp_replace(c, '^"|"$', ""))


def read_delimited_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of all .csv, .tsv and .txt files under ``path``: the texts of a row's cells; rows are numbered from 0.

    A .tsv file is parted at tabs; another one at semicolons if its first line has more of them than commas, else at commas.
    Empty lines are no rows. Separators within quotation marks part cells too. Lines are read in splits, written once, and
    numbered by the rows that the splits before have; only the splits' counts and first lines are brought together by file.
    """
    lines = _lines(spark, path)
    # the number is given after empty lines are gone, so it is dense within a split
    kept = materialize(lines.where("line <> ''").select("*", F.monotonically_increasing_id().alias("at")), "delimited-lines")
    first = lines.where("block = 0").select("path", "line", F.monotonically_increasing_id().alias("at")).groupBy("path").agg(F.min_by("line", "at").alias("first"))
    count = lambda sep: F.size(F.split("first", sep, -1))
    sep = F.when(F.lower("path").endswith(".tsv"), "\t").when(count(";") > count(","), ";").otherwise(",")
    blocks = kept.groupBy("path", "block").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).join(first.select("path", sep.alias("sep")), "path", "left").select("path", "block", "low", "before", F.coalesce("sep", F.lit(",")).alias("sep"))
    met = kept.join(blocks, ["path", "block"])
    parts = F.when(F.col("sep") == "\t", F.split("line", "\t", -1)).when(F.col("sep") == ";", F.split("line", ";", -1)).otherwise(F.split("line", ",", -1))
    return met.select("path", (F.col("at") - F.col("low") + F.col("before")).alias("row"), F.transform(parts, cell_text).alias("cells"))


def read_delimited_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, text) of the files' cells; columns are numbered from 0."""
    return read_delimited_rows(spark, path).select("path", "row", F.posexplode("cells").alias("col", "text"))
