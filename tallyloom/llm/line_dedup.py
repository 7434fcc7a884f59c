"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed; a window that repeats anywhere in the corpus stays at its first place
(smallest doc_id, then position) and is removed everywhere later. Overlapping covered positions are merged per document.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

WINDOW_LINES = 3


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", skip_blank: bool = False) -> DataFrame:
    """(doc, digest, first, last): merged 0-based line spans of each document that repeat an earlier window.

    The first places of repeated windows are written before they are met again, so that both sides of that join are plain
    shuffles and adaptive execution can split a window that very many documents share.
    """
    lines = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("digest"),
        F.split(F.col(text_col), "\n", -1).alias("lines"),
    ).where(F.size("lines") >= WINDOW_LINES)
    hashed = lines.select("doc", "digest", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), ((F.trim(x) != "") | (not skip_blank)).alias("full"))).alias("h"))

    def window(i: Column) -> Column:
        part = [F.col("h")[i + j] for j in range(WINDOW_LINES)]
        full = part[0]["full"] | part[1]["full"] | part[2]["full"]
        return F.when(full, F.struct(i.cast("int").alias("pos"), F.xxhash64(*(p["a"] for p in part)).alias("k1"), F.xxhash64(*(p["b"] for p in part)).alias("k2")))

    at = F.sequence(F.lit(0), F.size("h") - WINDOW_LINES)
    windows = hashed.select("doc", "digest", F.explode(F.transform(at, window)).alias("w")).where("w is not null").select("doc", "digest", "w.*")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "digest", "pos")
    firsts = windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("k1", "k2", "first"), "first-windows")
    later = windows.join(firsts, ["k1", "k2"]).where(place > F.col("first")).select("doc", "digest", "pos").distinct()
    by_doc = Window.partitionBy("doc", "digest").orderBy("pos")
    islands = later.withColumn("new", (F.col("pos") > F.coalesce(F.lag("pos").over(by_doc), F.lit(-10)) + WINDOW_LINES).cast("int")).withColumn("island", F.sum("new").over(by_doc))
    return islands.groupBy("doc", "digest", "island").agg(F.min("pos").alias("first"), (F.max("pos") + (WINDOW_LINES - 1)).alias("last")).select("doc", "digest", "first", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", skip_blank: bool = False) -> DataFrame:
    """``docs`` with the text's repeated windows removed, and ``n_lines``, ``n_removed``.

    Lines are split at U+000A. Two windows are equal if their lines' two 64-bit hashes are. Results by case: a null text
    stays null with 0 lines; an empty text is one empty line; under three lines nothing is removed; windows of blank lines
    are windows like others unless ``skip_blank``; rows with equal id and text are one document and get the same result; under one id, different
    texts are ordered by hash; null ids come last. Every distinct line keeps its first occurrence. Other columns pass
    through; existing columns called n_lines or n_removed are replaced.
    """
    found = duplicate_spans(docs, id_col, text_col, skip_blank).groupBy("doc", "digest").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__ld_spans"))
    found = found.select(F.col("doc").alias("__ld_doc"), F.col("digest").alias("__ld_digest"), "__ld_spans")
    base = docs.drop("n_lines", "n_removed").withColumn("__ld_key", F.xxhash64(text_col))
    joined = base.join(found, base[id_col].eqNullSafe(F.col("__ld_doc")) & (F.col("__ld_key") == F.col("__ld_digest")), "left")
    lines, cut = F.split(F.col(text_col), "\n", -1), F.col("__ld_spans")
    gaps = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.struct(F.when(i > 0, F.get(cut, i - 1)["last"] + 1).otherwise(0).alias("start"), F.when(i < F.size(cut), F.get(cut, i)["first"]).otherwise(F.size("__ld_lines")).alias("stop")))
    kept = F.flatten(F.transform("__ld_gaps", lambda g: F.slice(F.col("__ld_lines"), g["start"] + 1, F.greatest(g["stop"] - g["start"], F.lit(0)))))
    removed = F.aggregate(cut, F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    out = joined.withColumn("__ld_lines", F.when(cut.isNotNull(), lines)).withColumn("__ld_gaps", F.when(cut.isNotNull(), gaps))
    columns = [F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    count = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select(*columns, count.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))
