"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is an array of longs, cut into segments; the index lists every distinct code under each of its segments. Queries probe
all segments with the values at radius 0, 1, 2, ... until the k-th verified distance is provably covered: once every segment
has been probed up to radius r, all codes within segments * (r + 1) - 1 bits have been seen. Only unfinished queries go on.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

BUCKET_CODES = 4
WORD = 64
KEY = ["query_id", "query_code"]
_EMPTY = "query_id bigint, query_code array<bigint>, rank int, id bigint, distance int"


def dimension(vectors: DataFrame, col: str = "embedding") -> int:
    """The number of components of the longest vector; 0 without any."""
    return vectors.agg(F.coalesce(F.max(F.size(col)), F.lit(0))).first()[0]


def sign_code(embedding: Column, bits: int) -> Column:
    """``bits`` flags as an array of longs, the first component in the highest bit of the first: 1 where a component is
    positive, 0 where it isn't, is null or is missing. A null vector has no code."""

    def word(w: int) -> Column:
        flags = F.transform(F.sequence(F.lit(WORD * w), F.lit(WORD * w + WORD - 1)), lambda i: F.when((F.coalesce(F.get(embedding, i), F.lit(0.0)) > 0) & (i < bits), F.lit("1")).otherwise(F.lit("0")))
        return F.conv(F.array_join(flags, ""), 2, -10).cast("long")

    return F.when(embedding.isNotNull(), F.array(*(word(w) for w in range(max(1, -(-bits // WORD))))))


def segments(bits: int, rows: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of the segments, between 6 and 24 bits wide, for about BUCKET_CODES codes a bucket.

    A probe is a row that is shuffled, while the codes of a bucket are verified within the join; so buckets of a few codes,
    which wider radii of longer segments would need many more probes to meet, cost less than buckets of one.
    """
    width = min(24, max(6, round(math.log2(max(rows / BUCKET_CODES, 2)))))
    out = []
    for w in range(max(1, -(-bits // WORD))):
        own = min(WORD, max(1, bits - WORD * w))
        n, shift = max(1, round(own / width)), WORD - own
        for i in range(n):
            size = own // n + (i < own % n)
            out.append((w, shift, size))
            shift += size
    return out


def _part(word: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = WORD) -> DataFrame:
    """(query_id, query_code, rank, id, distance): the k codes nearest to each query, ties by id; fewer if there are fewer.

    ``codes`` and ``queries`` have columns id and code (arrays of longs for ``bits`` flags, see sign_code); other columns,
    whatever their names, aren't read. Null ids or codes aren't searched. Equal codes share an index entry that keeps their
    k smallest ids, which is all that any answer can need; repeated (id, code) rows count once; repeated query ids with
    different codes are told apart by code. Without codes or queries there are no rows. Both sides of the join on a bucket
    are plain shuffles, so adaptive execution can split a bucket with many codes.
    """
    spark = codes.sparkSession
    clean = codes.where("id is not null and code is not null").select("id", "code").distinct()
    ranked = clean.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    listed = materialize(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    rows = listed.count()
    if not rows:
        return spark.createDataFrame([], _EMPTY)
    cut = segments(bits, rows)
    m, words = len(cut), range(max(w for w, _, _ in cut) + 1)
    widest = max(width for _, _, width in cut)
    entries = F.explode(F.array(*(F.struct(F.lit(j).alias("segment"), _part(F.get("code", F.lit(w)), shift, width).alias("value")) for j, (w, shift, width) in enumerate(cut))))
    index = materialize(listed.select("code", F.size("ids").alias("size"), entries.alias("e")).select("e.segment", "e.value", "code", "size"), "code-index")
    asked = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    open_queries = materialize(asked.distinct().withColumn("bound", F.lit(bits)), "queries")
    done, held = [], spark.createDataFrame([], "query_id bigint, query_code array<bigint>, code array<bigint>, size int, distance int")
    for radius in range(widest + 1):
        if open_queries.isEmpty():
            break
        options = F.array(*(F.struct(F.lit(j).alias("segment"), F.array(*(F.lit(x).cast("long") for x in _masks(width, radius))).alias("masks")) for j, (_, _, width) in enumerate(cut) if width >= radius))
        probes = open_queries.select(*KEY, "bound", F.explode(options).alias("o")).select(*KEY, "bound", "o.segment", F.explode("o.masks").alias("mask"))
        own = reduce(lambda c, x: c.when(F.col("segment") == x[0], _part(F.get("query_code", F.lit(x[1][0])), *x[1][1:])), list(enumerate(cut))[1:], F.when(F.col("segment") == 0, _part(F.get("query_code", F.lit(cut[0][0])), *cut[0][1:])))
        probes = probes.withColumn("value", own.bitwiseXOR(F.col("mask"))).drop("mask")
        hits = probes.hint("merge").join(index, ["segment", "value"])
        hits = hits.withColumns({f"x{w}": F.get("query_code", F.lit(w)).bitwiseXOR(F.get("code", F.lit(w))) for w in words})
        distance = reduce(add, (F.bit_count(f"x{w}") for w in words)).cast("int")
        # A code counts only where it is met first: in no earlier segment within this radius, in no later one within less.
        first = F.lit(True)
        for j, (w, shift, width) in enumerate(cut):
            off = F.bit_count(_part(F.col(f"x{w}"), shift, width))
            first = first & F.when(F.col("segment") > j, off > radius).when(F.col("segment") < j, off >= radius).otherwise(F.lit(True))
        found = hits.where((distance <= F.col("bound")) & first).select(*KEY, "code", "size", distance.alias("distance"))
        pool = held.join(open_queries.select(*KEY), KEY, "left_semi").unionByName(found)
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*KEY).orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = materialize(pool.withColumn("before", before).where(F.col("before") < k).drop("before"), "nearest")
        covered = m * (radius + 1) - 1
        kth = held.groupBy(*KEY).agg(F.max("distance").alias("kth"), F.sum("size").alias("n"))
        state = open_queries.join(kth, KEY, "left")
        end = (F.coalesce("n", F.lit(0)) >= k) & (F.col("kth") <= covered) if radius < widest else F.lit(True)
        state = materialize(state.withColumn("end", end), "query-state")
        done.append(held.join(state.where("end").select(*KEY), KEY, "left_semi"))
        open_queries = state.where("not end").select(*KEY, F.when(F.col("n") >= k, F.least("bound", "kth")).otherwise(F.col("bound")).alias("bound"))
    if not done:
        return spark.createDataFrame([], _EMPTY)
    rows = reduce(DataFrame.unionByName, done).join(listed, "code").select(*KEY, "distance", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("distance", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(*KEY, "rank", "id", "distance")
