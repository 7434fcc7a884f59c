"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, line_dedup, mixing, near_dup, toxicity
from tallyloom.llm.queries import vocabulary
from tallyloom.session import materialize, table

#: The stage links texts at a similarity of 0.8 or more; op4_near_dup has its own, near_dup.PERCENT.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``docs`` with all other columns than COLUMNS renamed meanwhile, so that none clashes with a new one."""
    own = {c: c if c in COLUMNS else f"__cp_{i}" for i, c in enumerate(docs.columns)}
    done = run(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())))
    return done.select(*(F.col(x).alias(c) for c, x in own.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled documents here, doesn't reject.

    Null and empty texts are scored as empty ones; equal rows have one fate; without labels of both kinds all stay; an empty
    table stays empty. As in all stages but the last, columns of any name are those of ``docs``.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return beside(docs, lambda d: toxicity.score(d, model, d.columns).where("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows a text that changed.

    Null texts and texts under three lines stay as they are; equal rows are one document; every document stays, if without
    text.
    """

    def run(d: DataFrame) -> DataFrame:
        done = line_dedup.dedup_lines(d)
        return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return beside(docs, run)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Documents without words all stay, as do all rows of the smallest id, equal ones too; a null id goes if its group has
    another.
    """
    return beside(docs, lambda d: near_dup.near_duplicates(d, keep=d.columns, percent=NEAR_PERCENT).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; those without words never are. A null source is a source."""
    return beside(docs, lambda d: mixing.repeated(mixing.mix_sources(d)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of the text decoded from them, a row a document of the mix.

    A null or empty text has no tokens and the digests of nothing; equal rows give equal rows.
    """
    return bpe.round_trip(docs, vocabulary(), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Trees and MinHash can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
