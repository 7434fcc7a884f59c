"""Runs of repeated word sequences, by enumerating maximal pairs in the tree of LCP intervals.

A pair of places of one text is maximal if the words behind them agree for exactly ``l`` words and the words before them
differ. A pair of neighbouring places of such a sequence, ``d <= l`` apart, is a run of period ``d`` and length ``l + d``; every
run is one such pair, so nothing is extended or checked again. Suffixes of all texts of a chunk are sorted by prefix doubling
in numpy; only those that share enough words with a neighbour enter the tree.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyloom.llm import textbytes as T
from tallyloom.session import ship_package

#: Words that a run has at least.
LEAST_WORDS = 12
RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words: by 64-bit hashes, confirmed by the words' bytes."""
    hashes = T.run_hashes(raw, starts, ends)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    odd = T.unlike(raw, starts, size, raw, starts[first][back], size[first][back])
    if len(odd):  # words of equal hash and other bytes
        known: dict[bytes, int] = {}
        for i in odd:
            back[i] = len(first) + known.setdefault(raw[starts[i] : ends[i]].tobytes(), len(known))
    return back.astype(np.int64)


def sorted_suffixes(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``least`` words or more with another of their document, in order, and the number of words that
    each shares with the one before it (0 where it shares fewer).

    Ranks by 2h words refine those by h. A rank is the place of its group's first suffix, so it stays once it is unique, and
    only suffixes of larger groups are sorted again. Shared words are summed up from the ranks of all levels, largest first.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.searchsorted(doc, doc, "right")
    active, first, second = np.arange(n), doc * (int(words.max()) + 1) + words, np.zeros(n, np.int64)
    group, rank, levels = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    while len(active):
        order = np.lexsort((second, first))
        active, first, second, group = active[order], first[order], second[order], group[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        old = np.append(True, group[1:] != group[:-1])
        heads = np.flatnonzero(new)
        mine = group + (heads - np.flatnonzero(old)[np.cumsum(old)[heads] - 1])[np.cumsum(new) - 1]
        rank = rank.copy()
        rank[active] = mine
        levels.append(rank)
        keep = np.diff(np.append(heads, len(active)))[np.cumsum(new) - 1] > 1
        active, group = active[keep], mine[keep]
        ahead = active + (1 << len(levels) - 1)
        first, second = group, np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    top = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[top][order[1:]] == levels[top][order[:-1]])
    a, b = order[near], order[near + 1]
    shared = np.zeros(len(near), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + shared, b + shared
        inside = (x < last[a]) & (y < last[b])
        shared += (inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])) * (1 << k)
    lcp[near + 1] = np.where(shared < least, 0, shared)
    inner = (lcp[:-1] > 0) | (lcp[1:] > 0)
    return order[inner], lcp[:-1][inner]


def merge(children: list[list[int]], shared: int, left: list[int], least: int, found: list[tuple[int, int, int]]) -> list[int]:
    """The places of an LCP interval from those of its children, in order, reporting the runs among them.

    The largest child's list takes the places of the others; only neighbours of what comes in are looked at. Places of one
    child share more words than the interval does, and places of one left-word class are no maximal pair.
    """
    children.sort(key=len)
    whole = children.pop()
    of = {p: k for k, c in enumerate(children) for p in c}
    if len(of) * 8 < len(whole):
        for p in of:
            insort(whole, p)
    else:
        whole = sorted([*whole, *of])
    for p, k in of.items():
        at = bisect_left(whole, p)
        for a, b, other in ((at - 1, at, at - 1), (at, at + 1, at + 1)):
            if a < 0 or b >= len(whole):
                continue
            i, j = whole[a], whole[b]
            kin = of.get(whole[other], -1)
            if kin == k or (kin >= 0 and other < at):  # a pair of two newcomers is looked at from its left one
                continue
            if j - i <= shared and shared + j - i >= least and left[i] != left[j]:
                found.append((i, shared + j - i, j - i))
    return whole


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, period) of every run of all documents, places counted over all words, in order."""
    suffixes, lcp = sorted_suffixes(words, doc, -(-least // 2))
    # the left-word class of a place is the word before it; the first word of a document has a class of its own
    before = np.append(-1, words[:-1])
    before[np.append(True, doc[1:] != doc[:-1])[: len(before)]] = -1
    left = before.tolist()
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[list[int]]]] = []  # intervals that aren't complete: shared words, children so far
    carried: list[int] = []
    for place, shared in zip([*suffixes.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while open_ and open_[-1][0] > shared:
            depth, children = open_.pop()
            carried = merge([*children, carried], depth, left, least, found)
        if shared and open_ and open_[-1][0] == shared:
            open_[-1][1].append(carried)
        elif shared:
            open_.append((shared, [carried]))
        carried = [place]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def collapse_chunk(raw: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start within the document), each row's number of them, and the rows' kept words joined by blanks: bytes, offsets."""
    starts, ends, doc = T.runs(T.NOT_SPACE[raw], off)
    n_docs = len(off) - 1
    found = runs_of(word_ids(raw, starts, ends), doc, least) if len(starts) else np.zeros((0, 3), np.int64)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(depth[:-1]) == 0
    in_doc = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    first_word = np.searchsorted(doc, np.arange(n_docs))
    found = found.copy()
    found[:, 0] -= first_word[in_doc]
    starts, size, doc = starts[keep], (ends - starts)[keep], doc[keep]
    at = np.cumsum(size + 1) - size - 1  # each word and a blank
    text = np.full(int((size + 1).sum()), 0x20, np.uint8)
    text[T.spans(at, size)] = raw[T.spans(starts, size)]
    kept = np.bincount(doc, weights=size + 1, minlength=n_docs).astype(np.int64)
    to = np.cumsum(kept)
    drop = to[kept > 0] - 1  # the blank behind a document's last word
    text = np.delete(text, drop)
    return found, np.bincount(in_doc, minlength=n_docs), text, np.append(0, to - np.cumsum(kept > 0))


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """Columns ``keep`` (all but the text unless given), ``runs`` (array of start, length, period, in order) and ``collapsed``,
    the text's words without the repetitions of its runs, joined by one blank.

    A run is a stretch of ``least`` words or more that has a smallest period of at most half its length and that no word
    beside it extends. Results by case: a null or empty text, or one of blanks, has no runs and collapses to the empty text;
    equal rows give equal rows; an empty table gives no rows; columns called runs or collapsed are replaced. Runs of a text of
    any length are found; a task holds one chunk of texts with its suffixes.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed") and (keep or c != text_col)]
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
        for batch in T.chunks(batches, "__pr_text"):
            raw, off = T.utf8(batch.column(batch.schema.get_field_index("__pr_text")))
            found, count, text, to = collapse_chunk(raw, off, least)
            items = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), items)
            texts = pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists, texts], names=[*keep, "runs", "collapsed"])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("__pr_text"))
    fields = [docs.schema[c] for c in keep]
    schema = StructType([*fields, StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())])
    return given.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """Of an array of runs the longest: (length, start, period); of equal ones the first, then the one of smaller period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))


def listing(runs: Column) -> Column:
    """All runs as text: a line of start, length and period each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
