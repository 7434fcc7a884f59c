"""Near-duplicate documents by the chosen-path set similarity join.

Documents are sets of five-word shingles; equal sets form classes. Each tree branches the classes by selected coordinates of
their MinHash signatures: all classes that share a coordinate's value go to one child. Children of at most NODE_CLASSES
classes are compared exhaustively on their signatures; larger ones branch again without the classes that are alike with one of
them, until none is large.
Trees are repeated until a pair at the threshold is met with the target recall at any depth. Candidates are gathered in
clusters, in which full sets decide; see exact_links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tallyloom.llm import textbytes as T
from tallyloom.llm.components import components
from tallyloom.session import materialize, ship_package

SHINGLE_WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES = 128
#: Chance that the trees meet a pair at the threshold, however deep its nodes lie; pairs in small nodes miss by far less.
TARGET_RECALL = 0.999999
NODE_CLASSES = 128
MOST_LEVELS = 32
#: Share of a large node's listed classes that must look like one of them to make it the node's pivot.
PIVOT_SHARE = 1 / 16
#: Shingles that one task compares on one side, and classes: an eighth of a cluster within these bounds.
BLOCK_SHINGLES = 200_000
BLOCK_CLASSES = (256, 4096)
PIVOTS = 4
#: Bits of the filter on texts: at most 4,097 bitmaps of 4 KB are broadcast, 16 MB at every size of the input.
FILTER_BITS = 1 << 27
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def second_branch(percent: int) -> float:
    """Chance of a second coordinate below the root. A pair at the threshold so stays together with a chance that doesn't
    fall with depth, while rows of nodes whose classes are less alike get fewer from level to level."""
    return min(1.0, 2 * (100 / percent - 1))


def miss(percent: int) -> float:
    """Chance that a tree of any depth parts a pair at the threshold; the root takes two coordinates."""
    p, s = second_branch(percent), percent / 100
    fail = 0.0
    for _ in range(200):
        x = 1 - s * (1 - fail)
        fail = (1 - p) * x + p * x * x
    return (1 - s * (1 - fail)) ** 2


def trees_for(recall: float, percent: int) -> int:
    """Trees after which a pair at the threshold is missed with at most 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(miss(percent)))


def least_agreement(percent: int) -> int:
    """Equal coordinates, five standard deviations under what a pair at the threshold has on average."""
    s = percent / 100
    return math.floor(COORDINATES * s - 5 * math.sqrt(COORDINATES * s * (1 - s)))


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words each, or all words if there are fewer."""
    low = T.LOWER[raw]
    starts, ends, doc = T.runs(T.NOT_SPACE[low], off)
    words = T.run_hashes(low, starts, ends)
    at = np.searchsorted(doc, np.arange(len(off)))
    rolled = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE_WORDS):
            rolled[: max(len(words) - j, 0)] += T.mix64(words[j:] + np.uint64(j + 1))
        rolled = T.mix64(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            yield np.unique(rolled[a : b - SHINGLE_WORDS + 1])
        elif b > a:
            yield T.mix64(np.array([hash_of_short(words[a:b])], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def hash_of_short(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def signature(shingles: np.ndarray) -> bytes:
    """MinHash values of a set, each as 32 bits of a hash of the minimum."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[i : i + 512, None] * _MULTIPLIERS).min(0))
    return (T.mix64(least) >> np.uint64(32)).astype("<u4").tobytes()


def tag(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, n_shingles, and for non-empty sets their class (a 128-bit digest) and signature."""
    ship_package(docs.sparkSession)
    schema = type(docs.schema)([docs.schema[c] for c in keep]).add("n_shingles", "long").add("__nd_class", "binary").add("__nd_sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "__nd_text"):
            size, kind, sig = [], [], []
            for s in shingle_sets(*T.utf8(batch.column(batch.schema.get_field_index("__nd_text")))):
                size.append(len(s))
                kind.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(kind, pa.binary()), pa.array(sig, pa.binary())], names=[*keep, "n_shingles", "__nd_class", "__nd_sig"])

    return docs.select(*(f"`{c}`" for c in keep), F.col(text_col).alias("__nd_text")).mapInArrow(run, schema)


def branch(rows: DataFrame, percent: int, root: bool) -> DataFrame:
    """The children of each (node, cid, sig), chosen by the node's hash; the root's come without signatures."""
    two = F.lit(True) if root else F.pmod(F.xxhash64("node", F.lit(7)), F.lit(10_000)) < round(10_000 * second_branch(percent))
    picks = F.explode(F.when(two, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    place = F.pmod(F.xxhash64("node", "pick", F.lit(11)), F.lit(COORDINATES)).cast("int")
    value = F.substring(F.col("sig"), place * 4 + 1, F.lit(4))
    return rows.select("node", "cid", "sig", picks.alias("pick")).select(F.xxhash64("node", "pick", value).alias("node"), "cid", *([] if root else ["sig"]))


def first_members(keys: DataFrame) -> DataFrame:
    """(node, cids): NODE_CLASSES + 1 cids of each node (node, cid) that has more than one; of more, those of smallest hash.

    Ranks are limited in each task before rows are dealt by node, so a node of any size brings few rows.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("cid")))
    some = keys.select("node", "cid").withColumn("n", rank).where(F.col("n") <= NODE_CLASSES + 1)
    return some.groupBy("node").agg(F.sort_array(F.collect_list("cid")).alias("cids")).where(F.size("cids") > 1)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, for input in which equal keys stand together; one group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows; the low byte of each coordinate is enough to compare."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint8)


def agreements(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that agree in ``least`` coordinates or more, with the number of equal coordinates."""
    x, y, n = ([np.zeros(0, np.int64)] for _ in range(3))
    step = max(1, (1 << 22) // max(1, len(b) * COORDINATES))
    for i in range(0, len(a), step):
        same = (a[i : i + step, None, :] == b[None, :, :]).sum(2)
        p, q = np.nonzero(same >= least)
        x.append(p + i)
        y.append(q)
        n.append(same[p, q])
    return np.concatenate(x), np.concatenate(y), np.concatenate(n)


class Forest:
    """Disjoint sets of 0 .. n - 1; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def candidate_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the classes of each small node that look alike, each linked to the first of its group."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches, ["node"]):
            cid, sig = group.column("cid").to_numpy(), matrix(group.column("sig"))
            forest = Forest(len(cid))
            x, y, _ = agreements(sig, sig, least)
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if i < j:
                    forest.join(i, j)
            for i in range(len(cid)):
                if (r := forest.root(i)) != i:
                    a.append(int(cid[i]))
                    b.append(int(cid[r]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return nodes.select("node", "cid", "sig").repartition("node").sortWithinPartitions("node", "cid").mapInArrow(run, "a bigint, b bigint")


def with_pivots(wide: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, pivot, pivot_sig) of large nodes (node, cids): the listed class that most listed ones look like, null unless
    they are a PIVOT_SHARE of all."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["node"]):
            sig = matrix(group.column("sig"))
            inside = np.bincount(agreements(sig, sig, least)[0], minlength=len(sig))
            i = int(inside.argmax())
            found = group.slice(i, 1).select(["node", "cid", "sig"]).to_batches()[0]
            if inside[i] < max(2, PIVOT_SHARE * len(sig)):
                found = pa.RecordBatch.from_arrays([found.column(0), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=["node", "cid", "sig"])
            yield found.rename_columns(["node", "pivot", "pivot_sig"])

    rows = wide.select("node", F.explode("cids").alias("cid")).join(classes.select("cid", "sig"), "cid").select("node", "cid", "sig")
    return rows.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(run, "node bigint, pivot bigint, pivot_sig binary")


def held_to_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """(node, cid, sig, pivot) of (node, cid, sig, pivot, pivot_sig): the signature stays with classes that branch on, the pivot
    with those linked to it.

    A class that looks like the pivot is linked to it and goes no further. What looks like such a class differs from the pivot in
    at most twice the coordinates in which two alike ones may differ, and is linked to it as well.
    """
    least = least_agreement(percent)
    ring = 2 * least - COORDINATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, cid, sig, pivot, pivot_sig = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "cid", "sig", "pivot", "pivot_sig"))
            known = np.asarray(pivot.is_valid())
            same = np.zeros(batch.num_rows, np.int64)
            same[known] = (matrix(pc.drop_null(pivot_sig)) == matrix(sig.filter(pa.array(known)))).sum(1)
            on, near = pa.array(same < least), pa.array(known & (same >= ring))
            yield pa.RecordBatch.from_arrays([node, cid, pc.if_else(on, sig, None), pc.if_else(near, pivot, None)], names=["node", "cid", "sig", "pivot"])

    return rows.select("node", "cid", "sig", "pivot", "pivot_sig").mapInArrow(run, "node bigint, cid bigint, sig binary, pivot bigint")


def chosen_path_candidates(classes: DataFrame, percent: int, recall: float) -> DataFrame:
    """(a, b) candidate links between classes (cid, sig), from all trees.

    Small nodes come from an aggregate that stops at NODE_CLASSES + 1 members; only rows of larger nodes are met again, once a
    level. Of a larger node, the classes that look like its pivot are linked to it and leave, with all that could be linked with
    them, so copies don't branch further however many there are and whatever else is in their node; the full sets decide later.
    What is still larger after MOST_LEVELS levels is linked to its first class, and no class is left out either way.
    """
    trees = trees_for(recall, percent)
    rows = classes.select(F.explode(F.array(*(F.lit(t).cast("long") for t in range(trees)))).alias("node"), "cid", "sig")
    smalls, edges = [], []
    for level in range(MOST_LEVELS):
        keys = branch(rows, percent, root=level == 0)
        if level:
            keys = materialize(keys, "children")  # few, and read twice
        shared = materialize(first_members(keys), "nodes")
        smalls.append(shared.where(F.size("cids") <= NODE_CLASSES).select("cids"))
        wide = shared.where(F.size("cids") > NODE_CLASSES)
        if wide.isEmpty():
            break
        if level == MOST_LEVELS - 1:
            edges.append(keys.join(wide.select("node", F.col("cids")[0].alias("b")), "node").select(F.col("cid").alias("a"), "b"))
            break
        pivots = materialize(with_pivots(wide, classes, percent), "pivots-of-nodes")
        large = passing(keys, pivots.select("node"), ["node"]).join(pivots, "node")
        if level == 0:
            large = large.join(classes.select("cid", "sig"), "cid")
        large = materialize(held_to_pivots(large, percent), "large-nodes")
        edges.append(large.where("pivot is not null").select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
        rows = large.where("sig is not null").select("node", "cid", "sig")
    small = reduce(DataFrame.unionByName, smalls)
    once = small.groupBy(F.xxhash64("cids").alias("node")).agg(F.first("cids").alias("cids"))
    members = once.select("node", F.explode("cids").alias("cid")).join(classes.select("cid", "sig"), "cid")
    return reduce(DataFrame.unionByName, edges, candidate_edges(members, percent)).where("a <> b").distinct()


def passing(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, and few others, found without a shuffle of ``rows``; an exact join follows.

    Hashes of the wanted keys set bits of bitmaps, whose number and size are fixed; no wanted row is ever left out.
    """
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    bits = wanted.select(F.bitmap_bucket_number(bit).alias("__map"), F.bitmap_bit_position(bit).alias("__at")).distinct().repartition("__map")
    maps = bits.groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("__map", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "__map")
    return held.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def sets_of(members: DataFrame, text_col: str = "text") -> DataFrame:
    """``members`` without the text, with ``shingles``: the sorted shingle hashes of its text as an array of longs."""
    keep = [c for c in members.columns if c != text_col]
    schema = type(members.schema)([members.schema[c] for c in keep]).add("found", "binary").add("shingles", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, text_col):
            sets = list(shingle_sets(*T.utf8(batch.column(batch.schema.get_field_index(text_col)))))
            to = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(sets).view(np.int64)))
            kind = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), kind, lists], names=[*keep, "found", "shingles"])

    return members.select(*keep, text_col).mapInArrow(run, schema)


def verified_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links from the classes of each block to the first of those they are linked with, decided on full sets.

    Rows are (cluster, x, y, ask, joined, cid, sig, shingles): those with ``ask`` are compared with all rows of their block,
    in falling order of agreement; pairs that are connected already are passed over. Rows that are ``joined`` are linked
    with each other beforehand.
    """
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cluster", "x", "y"]):
            cid, sig = group.column("cid").to_numpy(), matrix(group.column("sig"))
            ask, joined = (np.asarray(group.column(c)) for c in ("ask", "joined"))
            lists = group.column("shingles").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            size = np.diff(at)
            forest = Forest(len(cid))
            together = np.flatnonzero(joined)
            for i in together[1:].tolist():
                forest.join(int(together[0]), i)
            asked = np.flatnonzero(ask)
            x, y, n = agreements(sig[asked], sig, least)
            x = asked[x]
            fits = (cid[x] != cid[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y, n = x[fits], y[fits], n[fits]
            order = np.argsort(-n, kind="stable")
            for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                if forest.root(i) != forest.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (int(size[i]) + int(size[j]) - both):
                        forest.join(i, j)
            root = np.array([forest.root(i) for i in range(len(cid))])
            passed = np.zeros(len(cid), bool)
            passed[together[1:]] = True  # linked beforehand
            linked = np.flatnonzero((cid[root] != cid) & ~passed)
            yield pa.RecordBatch.from_pydict({"a": pa.array(cid[linked], pa.int64()), "b": pa.array(cid[root[linked]], pa.int64())})

    keyed = blocks.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "cid")
    return keyed.select("cluster", "x", "y", "ask", "joined", "cid", "sig", "shingles").mapInArrow(run, "a bigint, b bigint")


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect exactly what is linked within each cluster of ``members`` (cluster, cid, sig, shingles).

    A cluster of few classes with up to BLOCK_SHINGLES shingles is one block. In a larger one, all classes are held against PIVOTS of them;
    those linked to the best pivot are one component, and only the rest asks, in blocks, against all blocks of the cluster.
    No task holds more than two blocks, and no pair is left out.
    """
    totals = members.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("total"), F.count("*").alias("classes"), *(F.min(F.struct(F.xxhash64("cid", F.lit(i)), "cid")).alias(f"p{i}") for i in range(PIVOTS)))
    side = F.least(F.greatest(F.col("classes") / 8, F.lit(BLOCK_CLASSES[0])), F.lit(BLOCK_CLASSES[1]))
    totals = totals.withColumns({"side": side, "blocks": F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("classes") / side)).cast("int")})
    totals = materialize(totals, "clusters")
    known = members.join(totals.select("cluster", "blocks", "side"), "cluster")
    zero = F.lit(0)
    alone = known.where("blocks <= 1").select("cluster", zero.alias("x"), zero.alias("y"), F.lit(True).alias("ask"), F.lit(False).alias("joined"), "cid", "sig", "shingles")
    wide = totals.where("blocks > 1")
    if wide.isEmpty():
        return verified_links(alone, percent)
    many = known.where("blocks > 1")
    chosen = wide.select("cluster", F.explode(F.array_distinct(F.array(*(F.col(f"p{i}.cid") for i in range(PIVOTS))))).alias("pivot"))
    pivots = chosen.join(members.select(F.col("cluster").alias("c"), F.col("cid").alias("i"), F.col("shingles").alias("own")), (F.col("cluster") == F.col("c")) & (F.col("pivot") == F.col("i"))).select("cluster", "pivot", "own")
    both = F.size(F.array_intersect("shingles", "own"))
    linked = 100 * both >= percent * (F.size("shingles") + F.size("own") - both)
    tests = materialize(many.join(pivots, "cluster").select("cluster", "cid", "pivot", linked.alias("linked")), "pivots").where("linked")
    best = tests.groupBy("cluster", "pivot").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("best"))
    star = materialize(tests.join(best, "cluster").where("pivot = best").select("cluster", "cid", "best"), "stars")
    marked = many.join(star.select("cluster", "cid", "best"), ["cluster", "cid"], "left").withColumn("joined", F.col("best").isNotNull())
    marked = materialize(marked.select("cluster", "cid", "sig", "shingles", "blocks", "side", "joined"), "large-clusters")
    asking = F.greatest(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES), F.ceil(F.count("*") / F.first("side"))).cast("int")
    rest = materialize(marked.where("not joined").groupBy("cluster").agg(asking.alias("asking")), "asking")
    held = marked.join(rest, "cluster")
    row, column = F.pmod(F.xxhash64("cid", F.lit(21)), F.col("asking")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(22)), F.col("blocks")).cast("int")
    asks = held.where("not joined").select("cluster", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("x"), row.alias("y"), F.lit(True).alias("ask"), "joined", "cid", "sig", "shingles")
    rows = held.select("cluster", column.alias("x"), F.explode(F.sequence(zero, F.col("asking") - 1)).alias("y"), F.lit(False).alias("ask"), "joined", "cid", "sig", "shingles")
    links = verified_links(alone.unionByName(asks).unionByName(rows), percent)
    return links.unionByName(star.select(F.col("cid").alias("a"), F.col("best").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, percent: int = PERCENT, recall: float = TARGET_RECALL) -> DataFrame:
    """Columns ``keep`` (the id unless given), n_shingles, component_id and kept for every row of ``docs``.

    Words are runs of bytes other than U+0020 and U+0009 to U+000D, with A-Z in lower case. Two texts are linked if
    100 * intersection >= percent * union of their shingle sets; component_id is the smallest id that links reach.
    Cases: null texts and texts without words have an empty set, reach only themselves and are kept; under five words all
    words are one shingle; equal rows and rows of one id with different texts are all answered; a null id is never a
    component's id unless all its ids are null, and then all its rows are kept. Input columns of the three names are
    replaced.
    """
    made = ("n_shingles", "component_id", "kept")
    keep = [c for c in ([id_col] if keep is None else keep) if c not in made]
    own = [c for c in dict.fromkeys([*keep, id_col])]
    tagged = materialize(tag(docs.withColumn("__nd_key", F.xxhash64(text_col)), [*own, "__nd_key"], text_col), "tagged")
    full = tagged.where("__nd_class is not null")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("__nd_key").alias("key")))
    firsts = full.groupBy("__nd_class").agg(first.alias("f"), F.first("__nd_sig").alias("sig"))
    firsts = firsts.select("__nd_class", F.col("f.id").alias("first_id"), F.col("f.key").alias("first_key"), "sig")
    classes = materialize(firsts.withColumn("cid", F.monotonically_increasing_id()), "classes")
    candidates = components(chosen_path_candidates(classes, percent, recall))
    clusters = materialize(candidates.select(F.col("node").alias("cid"), F.col("root").alias("cluster")).join(classes, "cid"), "clustered")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    texts = passing(texts, clusters.select(F.col("first_id").alias("doc"), F.col("first_key").alias("key")), ["doc", "key"])
    members = sets_of(texts.join(clusters, F.col("doc").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))).select("cluster", "cid", "sig", "__nd_class", "text"))
    members = materialize(members.where("found = __nd_class").dropDuplicates(["cid"]).select("cluster", "cid", "sig", "shingles"), "members")
    roots = components(exact_links(members, percent))
    named = classes.select("cid", "__nd_class", "first_id").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named.select("__nd_class", "first_id", "root"), "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = named.join(least, "root").select(F.col("__nd_class").alias("__nd_of"), "component_id")
    out = tagged.join(answer, F.col("__nd_class") == F.col("__nd_of"), "left")
    component = F.when(F.col("__nd_class").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(*(f"`{c}`" for c in keep), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))
