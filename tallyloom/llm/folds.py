"""The held-out fold of labelled documents, and bounded samples of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
SALTS = 32


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 by FOLDS; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def sample_by_hash(rows: DataFrame, keys: list[str], n: int, seed: int = 5) -> DataFrame:
    """The ``n`` rows of smallest hash of ``keys``. Only rows under a bound that about 2n rows meet are sorted, so what reaches
    the driver does not grow with the number of partitions."""
    h = F.xxhash64(F.lit(seed), *keys)
    share = min(1.0, (2 * n + 200) / max(rows.count(), 1))
    near = rows.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return near.orderBy(F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def sample_by_class(rows: DataFrame, class_col: str, per_class: int, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """Ids of about ``per_class`` rows of each class, chosen by hash; a class is dealt over SALTS groups, so none is hot."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    keyed = rows.select(F.col(id_col).alias("__sample_id"), F.col(class_col).alias("__class"), key.alias("__key")).withColumn("__salt", F.pmod("__key", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("__class", "__salt").orderBy("__key", "__sample_id"))
    return keyed.withColumn("__rank", rank).where(F.col("__rank") <= -(-per_class // SALTS)).select("__sample_id", "__class")
