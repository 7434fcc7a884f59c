"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

All words of a chunk lie in one flat array of symbols. In each round the pairs of neighbours are found by binary search over
the sorted keys of the merge table, and every word merges its pairs of lowest rank. Finished words leave the array.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes as T
from tallyloom.session import ship_package

#: Distinct words whose encoding a task keeps; beyond it, the store starts anew.
STORE_WORDS = 200_000


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary as arrays; ``special`` are added tokens, matched before words are split."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    token_bytes: np.ndarray
    token_at: np.ndarray
    special: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.token_at) - 1


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
    n = max([*vocab.values(), *special.values()]) + 1
    pieces = [b""] * n
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in token)
    for content, i in special.items():
        pieces[i] = content
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
    keys = left * n + right
    order = np.argsort(keys)
    byte_ids = np.zeros(256, np.int64)
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    return Vocabulary(byte_ids, keys[order], order.astype(np.int64), made[order], np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), special)


def pretokens(cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the words in ``cp``; ``breaks`` are the starts of the stretches that are split on their own.

    Words are, in this order: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of numbers or of other characters,
    each with one leading U+0020 if there is one; white space, whose last character stays with what follows.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = T.code_point_classes()[cp]
    cut = np.zeros(n + 1, bool)
    cut[breaks] = cut[n] = True
    start = cut[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    inside = ~cut[end]
    gap = (kind[begin] == T.SPACE) & inside
    last = end[gap] - 1
    start[last] = True
    start[end[gap][cp[last] == 0x20]] = False
    quote = (end - begin == 1) & (cp[begin] == 0x27) & inside & start[begin]
    q = np.flatnonzero(quote)
    q = q[kind[begin[q + 1]] == T.LETTER] if len(q) else q
    if len(q):
        a, room = begin[q + 1], end[q + 1] - begin[q + 1]
        one = cp[a]
        two = np.where(room > 1, cp[np.minimum(a + 1, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        wide = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(wide, 2, 0))
        a, room, size = a[size > 0], room[size > 0], size[size > 0]
        start[a] = False
        start[(a + size)[size < room]] = True
    return np.flatnonzero(start)


def merge_words(v: Vocabulary, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words raw[start:end], one after another, and their numbers of tokens."""
    size = ends - starts
    sym = v.byte_ids[raw[T.spans(starts, size)]]
    word = np.repeat(np.arange(len(starts)), size)
    done_word, done_sym = [], []
    none = np.int64(1 << 40)
    while len(sym):
        same = word[1:] == word[:-1]
        key = sym[:-1] * v.size + sym[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where(same & (v.keys[at] == key), v.ranks[at], none)
        heads = np.flatnonzero(np.append(True, ~same))
        best = np.minimum.reduceat(np.append(rank, none), heads)
        length = np.diff(np.append(heads, len(sym)))
        low = np.repeat(best, length)
        over = low == none
        if over.any():
            done_word.append(word[over])
            done_sym.append(sym[over])
        pick = np.flatnonzero((rank == low[:-1]) & ~over[:-1])
        if len(pick) > 1:  # of overlapping pairs, every second from the left
            new = np.append(True, np.diff(pick) > 1)
            first = np.flatnonzero(new)
            pick = pick[(np.arange(len(pick)) - first[np.cumsum(new) - 1]) % 2 == 0]
        sym[pick] = v.made[at[pick]]
        keep = ~over
        keep[pick + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_word:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    word, sym = np.concatenate(done_word), np.concatenate(done_sym)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(starts))


class WordStore:
    """Encodings of the words that a task has met, found by the words' 64-bit hashes and confirmed by their bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.count, self.ids = (np.zeros(0, np.int32) for _ in range(3))
        self.byte_at, self.byte_size, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode words and keep them; returns their rows."""
        first = len(self.at)
        ids, count = merge_words(self.v, raw, starts, ends)
        size = ends - starts
        grown = lambda x, y: np.concatenate((x, y.astype(x.dtype)))
        self.at, self.byte_at = grown(self.at, len(self.ids) + np.cumsum(count) - count), grown(self.byte_at, len(self.bytes) + np.cumsum(size) - size)
        self.count, self.byte_size = grown(self.count, count), grown(self.byte_size, size)
        self.ids, self.bytes = grown(self.ids, ids), grown(self.bytes, raw[T.spans(starts, size)])
        return np.arange(first, len(self.at), dtype=np.int32)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its row in ``at`` and ``count``; new words are encoded first.

        A word whose hash is another's gets a row of its own, which isn't found again.
        """
        hashes = T.run_hashes(raw, starts, ends)
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.at) > STORE_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[place] != found) if len(self.known) else np.arange(len(found))
        if len(fresh):
            rows = self.add(raw, starts[first[fresh]], ends[first[fresh]])
            known = np.concatenate((self.known, found[fresh]))
            order = np.argsort(known, kind="stable")
            self.known, self.row = known[order], np.concatenate((self.row, rows))[order]
            place = np.searchsorted(self.known, found)
        row = self.row[place][back]
        other = T.unlike(raw, starts, ends - starts, self.bytes, self.byte_at[row], self.byte_size[row])
        if len(other):
            row[other] = self.add(raw, starts[other], ends[other])
        return row


def split_words(raw: np.ndarray, off: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk: their first code points, for each the id of its added token or -1, the bytes at which code
    points begin (and the end), and the rows' offsets in code points."""
    cp, at, rows = T.code_points(raw, off)
    marks: list[tuple[int, int, int]] = []
    blob = raw.tobytes() if special else b""
    if any(s in blob for s in special):
        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
        for k in range(len(off) - 1):
            marks += [(m.start() + int(off[k]), m.end() + int(off[k]), special[m.group()]) for m in pattern.finditer(blob[off[k] : off[k + 1]])]
    breaks = np.unique(np.concatenate((rows, np.searchsorted(at, [x for m in marks for x in m[:2]]).astype(np.int64))))
    begin = pretokens(cp, breaks[breaks < len(cp)])
    kind = np.full(len(begin), -1, np.int64)
    if marks:
        keep = np.ones(len(begin), bool)
        for a, b, i in marks:
            x, y = np.searchsorted(begin, np.searchsorted(at, [a, b]))
            kind[x] = i
            keep[x + 1 : y] = False
        begin, kind = begin[keep], kind[keep]
    return begin, kind, at, rows


def encode_chunk(store: WordStore, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows of a chunk, one after another, and each row's number of tokens."""
    begin, kind, at, _ = split_words(raw, off, store.v.special)
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
    starts = at[begin]
    ends = np.append(starts[1:], len(raw))
    row = store.look_up(raw, starts, ends)
    at, count = store.at[row].astype(np.int64), store.count[row].astype(np.int64)
    ids = store.ids
    if (kind >= 0).any():  # added tokens lie behind the store's ids
        own = np.array(sorted(set(kind[kind >= 0])), np.int64)
        at = np.where(kind >= 0, len(ids) + np.searchsorted(own, kind), at)
        count = np.where(kind >= 0, 1, count)
        ids = np.concatenate((ids, own.astype(np.int32)))
    flat = ids[T.spans(at, count)].astype(np.uint32)
    doc = np.searchsorted(off, starts, "right") - 1
    return flat, np.bincount(doc, weights=count, minlength=len(off) - 1).astype(np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of token ids; bytes that aren't UTF-8 become U+FFFD."""
    ids = ids.astype(np.int64)
    return v.token_bytes[T.spans(v.token_at[ids], v.token_at[ids + 1] - v.token_at[ids])].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text unless given), ``n_tokens`` and ``ids``: little-endian unsigned 32-bit integers; and
    ``decoded``, if given, the text that the ids give back, made in the same step.

    Cases: a null or empty text has no tokens and empty ids; equal rows give equal rows; columns of these two names in the
    input are replaced. A text of any length is encoded whole.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids") and (keep or c != text_col)]
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(shared.value)
        for batch in T.chunks(batches, "__bpe_text"):
            raw, off = T.utf8(batch.column(batch.schema.get_field_index("__bpe_text")))
            ids, count = encode_chunk(store, raw, off)
            to = np.concatenate(([0], np.cumsum(count * 4))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(to), pa.py_buffer(ids.astype("<u4"))])
            texts = [pa.array((decode_ids(store.v, ids[a // 4 : b // 4]) for a, b in zip(to[:-1], to[1:], strict=True)), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(count), packed, *texts], names=[*keep, "n_tokens", "ids", *([decoded] if decoded else [])])

    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("__bpe_text"))
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = type(docs.schema)(sorted(fields, key=lambda f: keep.index(f.name))).add("n_tokens", "long").add("ids", "binary")
    return given.mapInArrow(run, schema.add(decoded, "string") if decoded else schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``ids_col`` replaced by the text ``out``; bytes that aren't UTF-8 become U+FFFD, null ids null."""
    keep = [c for c in encoded.columns if c not in (ids_col, out)]
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = []
            for i in range(len(column)):
                texts.append(decode_ids(v, np.frombuffer(column[i].as_buffer(), "<u4")) if column[i].is_valid else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    schema = type(encoded.schema)([f for f in encoded.schema.fields if f.name in keep]).add(out, "string")
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, n_tokens, and SHA-256 digests of the ids and of the text decoded from them.

    Encoding and decoding are one step, so a task has one Python worker, and the ids go through it once.
    """
    done = encode(docs, vocabulary, text_col, keep, "__bpe_decoded")
    return done.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("__bpe_decoded", "UTF-8"), 256).alias("decoded_sha256"))
