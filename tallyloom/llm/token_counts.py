"""Edit-aware token counts: a segment tree over the pre-tokens of each document, and local re-encoding after edits.

A pre-token depends on the text from its start to a few characters behind its end (two, or an added token's length). After
an edit, splitting starts again at a pre-token that far before the edit and stops at the first old boundary behind it; all
other pre-tokens and their counts stay, and only the sums above the changed leaves are renewed. The trees of a chunk of
documents lie in shared arrays, and the n-th edits of all its documents are made at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyloom.llm import bpe
from tallyloom.llm import textbytes as T
from tallyloom.session import ship_package

LEAF = 64
WINDOW = 48
EDIT_TYPE = "array<struct<start:int,drop:int,put:string>>"


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


class Forest:
    """One segment tree a document: sums of characters and tokens over leaves of LEAF pre-tokens (others after edits).

    Node i of document d is row base[d] + i of ``sums``; its children are 2i and 2i + 1, and leaf j is node width[d] + j.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, at: np.ndarray) -> None:
        words = np.diff(at)
        self.sizes, self.counts = sizes.astype(np.int64), counts.astype(np.int64)
        self.leaves = np.maximum(-(-words // LEAF), 1)
        self.leaf_of = offsets(self.leaves)  # first leaf of each document
        place = np.arange(self.leaf_of[-1]) - np.repeat(self.leaf_of[:-1], self.leaves)
        self.held = np.clip(np.repeat(words, self.leaves) - place * LEAF, 0, LEAF)  # pre-tokens of each leaf
        self.width = np.left_shift(1, np.ceil(np.log2(self.leaves)).astype(np.int64))
        self.base = offsets(2 * self.width)
        self.sums = np.zeros((self.base[-1], 2), np.int64)
        for column, x in enumerate((self.sizes, self.counts)):
            total = offsets(x)
            cut = offsets(self.held)
            self.sums[np.repeat(self.base[:-1] + self.width, self.leaves) + place, column] = total[cut[1:]] - total[cut[:-1]]
        low = self.width
        while (low > 1).any():
            low = low // 2
            node = T.spans(low, low)
            base = np.repeat(self.base[:-1], low)
            self.sums[base + node] = self.sums[base + 2 * node] + self.sums[base + 2 * node + 1]

    @property
    def tokens(self) -> np.ndarray:
        return self.sums[self.base[:-1] + 1, 1]

    @property
    def at(self) -> np.ndarray:
        """Offsets of the documents into the pre-tokens."""
        return offsets(self.held)[self.leaf_of]

    def find(self, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the leaf that holds character ``pos`` and the position at which the leaf begins."""
        node, before = np.ones(len(doc), np.int64), np.zeros(len(doc), np.int64)
        open_ = np.flatnonzero(node < self.width[doc])
        while len(open_):
            node[open_] *= 2
            left = self.sums[self.base[doc[open_]] + node[open_], 0]
            right = pos[open_] - before[open_] >= left
            before[open_[right]] += left[right]
            node[open_[right]] += 1
            open_ = open_[node[open_] < self.width[doc[open_]]]
        return np.minimum(node - self.width[doc], self.leaves[doc] - 1), before

    def ends_between(self, doc: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pre-tokens of leaves first .. last of each document: owner (place in ``doc``), row, end in characters."""
        cut = offsets(self.held)
        begin, end = cut[self.leaf_of[doc] + first], cut[self.leaf_of[doc] + last + 1]
        row = T.spans(begin, end - begin)
        owner = np.repeat(np.arange(len(doc)), end - begin)
        total = offsets(self.sizes[row])
        return owner, row, total[1:] - total[offsets(end - begin)[:-1]][owner] + before[owner]

    def splice(self, doc: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray, counts: np.ndarray, fresh: np.ndarray) -> None:
        """Put ``fresh[k]`` new pre-tokens in place of rows first[k] .. last[k] - 1 of document doc[k]; each at most once."""
        cut, at = offsets(self.held), self.at
        lead = self.leaf_of[doc]

        def leaf(row: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(cut, row, "right") - 1, lead, lead + self.leaves[doc] - 1)

        a, b = leaf(first), np.maximum(leaf(np.maximum(last - 1, first)), leaf(first))
        tail = cut[b] + self.held[b] - last
        self.held[T.spans(a + 1, np.maximum(b - a - 1, 0))] = 0
        self.held[b] = tail
        self.held[a] = first - cut[a] + fresh + np.where(a == b, tail, 0)
        source_at, piece = len(self.sizes) + offsets(fresh)[:-1], np.zeros((len(at) - 1, 3, 2), np.int64)
        piece[:, 0, 0], piece[:, 0, 1] = at[:-1], np.diff(at)
        piece[doc, 0, 1] = first - at[doc]
        piece[doc, 1, 0], piece[doc, 1, 1] = source_at, fresh
        piece[doc, 2, 0], piece[doc, 2, 1] = last, at[doc + 1] - last
        take = T.spans(piece[:, :, 0].ravel(), piece[:, :, 1].ravel())
        self.sizes, self.counts = np.concatenate((self.sizes, sizes))[take], np.concatenate((self.counts, counts))[take]
        changed = T.spans(a, b - a + 1)
        owner = np.repeat(doc, b - a + 1)
        cut = offsets(self.held)
        node = self.width[owner] + changed - self.leaf_of[owner]
        row = T.spans(cut[changed], self.held[changed])
        to = offsets(self.held[changed])
        for column, x in enumerate((self.sizes, self.counts)):
            total = offsets(x[row])
            self.sums[self.base[owner] + node, column] = total[to[1:]] - total[to[:-1]]
        while len(node):
            node //= 2
            owner, node = owner[node > 0], node[node > 0]
            self.sums[self.base[owner] + node] = self.sums[self.base[owner] + 2 * node] + self.sums[self.base[owner] + 2 * node + 1]


class Texts:
    """The code points of a chunk of texts."""

    def __init__(self, cp: np.ndarray, at: np.ndarray) -> None:
        self.cp, self.at = cp, at

    def utf8(self, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of characters first .. last - 1 of each document."""
        own = self.cp[T.spans(self.at[doc] + first, last - first)]
        raw = np.frombuffer(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        wide = offsets(1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000))
        return raw, wide[offsets(last - first)]

    def edit(self, doc: np.ndarray, start: np.ndarray, drop: np.ndarray, put: np.ndarray, put_size: np.ndarray) -> Texts:
        """The texts with ``drop`` characters from ``start`` on replaced by those of ``put``."""
        piece = np.zeros((len(self.at) - 1, 3, 2), np.int64)
        piece[:, 0, 0], piece[:, 0, 1] = self.at[:-1], np.diff(self.at)
        piece[doc, 0, 1] = start
        piece[doc, 1, 0], piece[doc, 1, 1] = len(self.cp) + offsets(put_size)[:-1], put_size
        piece[doc, 2, 0], piece[doc, 2, 1] = self.at[doc] + start + drop, self.at[doc + 1] - self.at[doc] - start - drop
        take = T.spans(piece[:, :, 0].ravel(), piece[:, :, 1].ravel())
        return Texts(np.concatenate((self.cp, put))[take], offsets(piece[:, :, 1].sum(1)))


def count_words(store: bpe.WordStore, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters and tokens of the pre-tokens of a chunk, and the rows' offsets into them; an added token is one token."""
    begin, kind, at, rows = bpe.split_words(raw, off, store.v.special)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(len(off), np.int64),)
    starts = at[begin]
    row = store.look_up(raw, starts, np.append(starts[1:], len(raw)))
    return np.diff(np.append(begin, len(at) - 1)), np.where(kind >= 0, 1, store.count[row].astype(np.int64)), np.searchsorted(begin, rows)


def edit_round(forest: Forest, texts: Texts, store: bpe.WordStore, doc: np.ndarray, start: np.ndarray, drop: np.ndarray, put: np.ndarray, put_size: np.ndarray) -> tuple[Texts, np.ndarray]:
    """Make one edit in each document of ``doc``; returns the new texts and how many pre-tokens were encoded again.

    ``put`` are the code points of all insertions, one after another. Starts and drops are clamped to the text.
    """
    size = np.diff(texts.at)[doc]
    start = np.clip(start, 0, size)
    drop = np.clip(drop, 0, size - start)
    some = np.flatnonzero((drop > 0) | (put_size > 0))
    put = put[T.spans(offsets(put_size)[some], put_size[some])]
    doc, start, drop, put_size = doc[some], start[some], drop[some], put_size[some]
    again = np.zeros(len(texts.at) - 1, np.int64)
    if not len(doc):
        return texts, again
    new = texts.edit(doc, start, drop, put, put_size)
    length = np.diff(new.at)[doc]
    reach = 1 + max([1, *(len(s.decode()) for s in store.v.special)])  # white space before an added token keeps its last character
    from_ = np.maximum(start - reach, 0)
    leaf, before = forest.find(doc, from_)
    owner, row, end = forest.ends_between(doc, leaf, leaf, before)
    passed = end <= from_[owner]
    skipped = np.bincount(owner[passed], minlength=len(doc))
    begin = before.copy()
    np.maximum.at(begin, owner[passed], end[passed])
    first = offsets(forest.held)[forest.leaf_of[doc] + leaf] + skipped
    shift, safe = put_size - drop, start + put_size
    stop, last = length.copy(), forest.at[doc + 1].copy()
    parts, fresh = [], np.zeros(len(doc), np.int64)
    todo, window = np.arange(len(doc)), WINDOW
    while len(todo):
        d, b = doc[todo], begin[todo]
        to = np.minimum(length[todo], safe[todo] + window)
        whole = to == length[todo]
        raw, off = new.utf8(d, b, to)
        words, kind, byte, rows = bpe.split_words(raw, off, store.v.special)
        ends = np.append(words[1:], rows[-1])[: len(words)]
        own = np.searchsorted(rows, words, "right") - 1
        place = ends - rows[own] + b[own]
        final, _ = forest.find(d, np.maximum(to - shift[todo], 0))
        final = np.maximum(final, leaf[todo])
        old_owner, old_row, old_end = forest.ends_between(d, leaf[todo], final, before[todo])
        key = (old_owner << 40) + old_end
        asked = (own << 40) + np.maximum(place - shift[todo][own], 0)
        hit = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        meets = (key[hit] == asked) if len(key) else np.zeros(len(asked), bool)
        sure = whole[own] | (place <= to[own] - reach)
        meets &= sure & (place >= safe[todo][own]) & (place - shift[todo][own] > b[own])
        met, where = np.unique(own[meets], return_index=True)
        where = np.flatnonzero(meets)[where]
        stop[todo[met]] = place[where]
        last[todo[met]] = old_row[hit[where]] + 1
        ready = whole.copy()
        ready[met] = True
        own_words = np.flatnonzero(ready[own] & (place <= stop[todo][own]))
        sizes, counts = (ends - words)[own_words], np.where(kind[own_words] >= 0, 1, 0)
        plain = own_words[counts == 0]
        row = store.look_up(raw, byte[words[plain]], byte[ends[plain]])
        counts[counts == 0] = store.count[row]
        fresh[todo] += np.bincount(own[own_words], minlength=len(todo))
        parts.append((todo[own[own_words]], sizes, counts))
        todo, window = todo[~ready], window * 4
    owner, sizes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    forest.splice(doc, first, last, sizes[order], counts[order], fresh)
    again[doc] = fresh
    return new, again


def build_trees(docs: DataFrame, vocabulary: bpe.Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``word_chars`` and ``word_tokens``: the pre-tokens below each document's tree in order, as arrays of ints.

    Strings of added tokens are one token each, as in bpe.encode. Cases: a null or empty text has empty arrays; a text of any
    length is one chunk; equal rows give equal rows; an empty table gives none; input columns of these names are replaced.
    """
    made = ("word_chars", "word_tokens")
    keep = [c for c in docs.columns if c not in made]
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = bpe.WordStore(shared.value)
        for batch in T.chunks(batches, text_col):
            size, count, at = count_words(store, *T.utf8(batch.column(batch.schema.get_field_index(text_col))))
            to = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(to, pa.array(x.astype(np.int32))) for x in (size, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *lists], names=[*keep, *made])

    schema = type(docs.schema)([f for f in docs.schema.fields if f.name in keep]).add("word_chars", ArrayType(IntegerType())).add("word_tokens", ArrayType(IntegerType()))
    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, vocabulary: bpe.Vocabulary, text_col: str = "text", edits_col: str = "edits", with_trees: bool = True) -> DataFrame:
    """``trees`` with text and tree after the edits, ``n_tokens``, ``edited_tokens``, ``n_words``, ``reencoded_words``.

    ``edits_col`` is an array of (start, drop, put) in code points, applied in order, each to the text left by those before;
    starts and drops beyond the text are clamped, a null put, array or field is empty or 0. The edits column is dropped, and
    the tree's two columns too unless ``with_trees``. Cases: a null text that its edits leave empty stays null and counts as
    empty; equal rows give equal rows; an empty table gives no rows; other columns pass through, those of the four names are
    replaced.
    """
    made = ("n_tokens", "edited_tokens", "n_words", "reencoded_words")
    tree = ("word_chars", "word_tokens")
    keep = [c for c in trees.columns if c not in (*made, text_col, edits_col, *tree)]
    ship_package(trees.sparkSession)
    shared = trees.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = bpe.WordStore(shared.value)
        for batch in T.chunks(batches, text_col):
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            raw, off = T.utf8(column[text_col])
            cp, _, rows = T.code_points(raw, off)
            at = column["word_chars"].offsets.to_numpy().astype(np.int64)
            forest = Forest(*(column[c].flatten().to_numpy(zero_copy_only=False) for c in tree), at - at[0])
            texts, before, words, again = Texts(cp, rows), forest.tokens, np.diff(at), np.zeros(len(off) - 1, np.int64)
            edits = column[edits_col]
            edit_at, fields = edits.offsets.to_numpy().astype(np.int64), edits.flatten()
            edit_at, given = edit_at - edit_at[0], np.diff(edit_at) * np.asarray(edits.is_valid())
            start, drop = (fields.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            put, _, put_at = T.code_points(*T.utf8(fields.field(2)))
            for turn in range(int(given.max()) if len(given) else 0):
                doc = np.flatnonzero(given > turn)
                k = edit_at[doc] + turn
                size = put_at[k + 1] - put_at[k]
                texts, n = edit_round(forest, texts, store, doc, start[k], drop[k], put[T.spans(put_at[k], size)], size)
                again += n
            every = np.arange(len(off) - 1)
            raw, to = texts.utf8(every, np.zeros(len(every), np.int64), np.diff(texts.at))
            gone = np.asarray(column[text_col].is_null()) & (np.diff(to) == 0)
            arrays = [text_array(raw, to, gone)]
            if with_trees:
                lists = pa.array(forest.at.astype(np.int32))
                arrays += [pa.ListArray.from_arrays(lists, pa.array(x.astype(np.int32))) for x in (forest.sizes, forest.counts)]
            arrays += [pa.array(x.astype(np.int64)) for x in (before, forest.tokens, words, again)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), *arrays], names=[*keep, text_col, *(tree if with_trees else ()), *made])

    schema = type(trees.schema)([f for f in trees.schema.fields if f.name in keep]).add(text_col, "string")
    for c in tree if with_trees else ():
        schema = schema.add(c, ArrayType(IntegerType()))
    for c in made:
        schema = schema.add(c, "long")
    return trees.mapInArrow(run, schema)


def text_array(raw: np.ndarray, off: np.ndarray, null: np.ndarray) -> pa.Array:
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.Array.from_buffers(pa.string(), len(null), [valid, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw.tobytes())])


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` with the edits (id_col, seq, start, drop, put) of each document as the array that apply_edits reads."""
    listed = edits.groupBy(F.col(id_col).alias("__te_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "drop", "put"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["drop"].alias("drop"), e["put"].alias("put"))).cast(EDIT_TYPE))
    return trees.join(listed, trees[id_col].eqNullSafe(F.col("__te_id")), "left").drop("__te_id")


def sample_edits(text: Column, label: Column) -> Column:
    """Three edits a document: 16 code points go at a third, a label comes in at two thirds, the end takes the beginning's form."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    one = F.struct(F.floor(n / 3).cast("int").alias("start"), F.lit(16).alias("drop"), F.lit("").alias("put"))
    two = F.struct(F.floor(n * 2 / 3).cast("int").alias("start"), F.lit(0).alias("drop"), F.concat(F.lit(" ["), F.coalesce(label.cast("string"), F.lit("none")), F.lit("] ")).alias("put"))
    three = F.struct(F.greatest(n - 12, F.lit(0)).cast("int").alias("start"), F.lit(8).alias("drop"), F.upper(F.substring(text, 1, 8)).alias("put"))
    return F.array(one, two, three).cast(EDIT_TYPE)
