"""What filters remove alone, together and in any order, and how the removals are shared between them.

Every document's failed filters are a bit mask. For each part the removals of all coalitions of filters follow from the counts
by mask; a filter's step in an order is a difference of two coalitions. Shapley values solve the kernel-weighted least squares
of the coalition removals under the constraint that they sum to what all filters remove, in rational numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import ship_package

FILTERS = "ABCDE"
LEAST_WORDS = 50
BLANK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """Conditions A to D over a text that isn't null: too few words, too few distinct words, many capitals, signs."""
    # what is between blanks; a text that begins or ends with blanks has an empty string there
    words = F.array_remove(F.split(text, BLANK, -1), "")
    few = F.size(words) < LEAST_WORDS
    alike = F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * F.size(words)
    loud = F.lit(100).cast("long") * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(5) * F.length(text)
    return [few, alike, loud, text.rlike(r"[#$%&*|]")]


def tally(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail.

    Copies of a text and repeated rows are counted before they are dealt by text, so a text that very many rows share is a
    few rows of counts; from the first row on, only ids, digests and masks are shuffled. Of equal texts, those with the
    smallest id pass E; rows without id pass it as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(failures(text))), F.lit(0))
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), bits.alias("fails"))
    given = given.groupBy("id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    kinds = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    marked = given.join(kinds, "id", "left").fillna(0, ["good", "toxic"])
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = marked.groupBy("digest", "fails", "part", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    texts = texts.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    unique = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    sides = F.array(F.struct(F.col("fails").alias("mask"), unique.alias("m")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - unique).alias("m")))
    counts = texts.select("part", "good", "toxic", F.inline(sides))
    return counts.groupBy("part", "mask").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic"))


def coalitions(by_mask: list[int]) -> list[int]:
    """For each set of filters the number of documents that fail one of them at least, from the counts by failed filters."""
    total, n = sum(by_mask), len(by_mask)
    within = list(by_mask)
    for bit in (1 << i for i in range(n.bit_length() - 1)):
        for s in range(n):
            if s & bit:
                within[s] += within[s ^ bit]
    return [total - within[n - 1 - s] for s in range(n)]  # all but those that fail filters outside the set only


@lru_cache(maxsize=4)
def solved(n: int) -> list[list[Fraction]]:
    """The inverse of the normal equations with their constraint (a row and column of ones) for ``n`` filters."""
    rows = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    for s in range(1, (1 << n) - 1):
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            for j in members:
                rows[i][j] += weight(n, len(members))
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    work = [r + [Fraction(int(i == k)) for k in range(n + 1)] for i, r in enumerate(rows)]
    for c in range(n + 1):
        p = next(r for r in range(c, n + 1) if work[r][c])
        work[c], work[p] = work[p], work[c]
        work[c] = [x / work[c][c] for x in work[c]]
        for r in range(n + 1):
            if r != c and work[r][c]:
                work[r] = [x - work[r][c] * y for x, y in zip(work[r], work[c], strict=True)]
    return [r[n + 1 :] for r in work]


def weight(n: int, size: int) -> Fraction:
    return Fraction(n - 1, comb(n, size) * size * (n - size))


def shapley(removed: list[int]) -> list[Fraction]:
    """The shares of the filters in what all remove: least squares over all coalitions, weighted by their sizes."""
    n = len(removed).bit_length() - 1
    right = [sum((weight(n, s.bit_count()) * removed[s] for s in range(1, (1 << n) - 1) if s >> i & 1), Fraction(0)) for i in range(n)]
    right.append(Fraction(removed[-1]))
    return [sum((a * b for a, b in zip(row, right, strict=True)), Fraction(0)) for row in solved(n)[:n]]


def steps(part: str, counts: list[dict[str, int]], filters: str = FILTERS) -> dict[str, list]:
    """The rows of all orders of a part from its counts by mask."""
    n = len(filters)
    by = {k: [0] * (1 << n) for k in ("n", "good", "toxic")}
    for c in counts:
        for k in by:
            by[k][c["mask"]] += c[k]
    removed, good, toxic = (coalitions(by[k]) for k in ("n", "good", "toxic"))
    total, whole = sum(by["n"]), (1 << n) - 1
    shares = [x * factorial(n) for x in shapley(removed)]
    rows: dict[str, list] = {k: [] for k in COLUMNS}
    for order in permutations(range(n)):
        before = 0
        for k, i in enumerate(order):
            after = before | 1 << i
            gone = removed[after] - removed[before]
            row = (part, "".join(filters[j] for j in order), k + 1, total - removed[after], gone, removed[1 << i] - gone, removed[whole] - removed[whole ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(shares[i]))
            for name, x in zip(COLUMNS, row, strict=True):
                rows[name].append(x)
            before = after
    return rows


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
ARROW = pa.schema([(c, pa.string() if i < 2 else pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(COLUMNS)])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for every part, order of the five filters and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley); shapley is the sum over all orders.

    A part reaches one task as 32 counts at most. Results by case: a null text is an empty one and fails A, and E behind a
    smaller id without text; a null part is the part of the empty string; equal rows count each for itself and no row is a
    copy of a row of its own id; rows without id never fail E; a document is good or toxic if one of its labels says so, null
    labels say nothing; an empty table gives no rows; other columns take no part.
    """
    counts = tally(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict(steps(part, given), schema=ARROW)

    return parts.mapInArrow(run, SCHEMA)
