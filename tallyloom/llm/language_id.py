"""Language identification by a linear-chain conditional random field over words.

Words (runs of letters) have affix, character n-gram and lexicon features; transitions between neighbouring words are
learned with them. Forward-backward gives each word its label probabilities, also within code-switched texts; a document
gets the label with the largest expected share of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes as T
from tallyloom.llm.folds import held_out, sample_by_class
from tallyloom.session import ship_package

FEATURES = 1 << 15
#: The model is fitted on about so many documents a language, none longer than SAMPLE_CHARS.
SAMPLE_DOCS = 320
SAMPLE_CHARS = 20_000
SEQUENCES, LENGTH, STEPS, RATE, DECAY = 1500, 48, 60, 0.3, 1e-5
LEXICON_WORDS = 400
BLOCK = 64
STORE_WORDS = 300_000


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray
    lexicon_label: np.ndarray


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """The lower-case form of each code point, where that is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and len(c := chr(i).lower()) == 1:
            table[i] = ord(c)
    return table


def padded(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words cp[start:end] in lower case between the marks 1 and 2, one after another, with their starts and sizes."""
    n = ends - starts
    begin = np.cumsum(n + 2) - (n + 2)
    flat = np.full(int((n + 2).sum()), 2, np.uint64)
    flat[begin] = 1
    flat[T.spans(begin + 1, n)] = lower_case()[cp[T.spans(starts, n)]]
    return flat, begin, n + 2


def features(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, lexicon: np.ndarray, lexicon_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the words they belong to: n-grams of 1 to 3 letters, affixes of 2 to 4, lexicon entries."""
    word = np.repeat(np.arange(len(begin)), size)
    end = begin + size
    out, owner = [], []
    key = np.zeros(len(flat), np.uint64)
    for k in range(1, 5):
        key = key[: len(flat) - k + 1] + (flat[k - 1 :] << np.uint64(21 * (k - 1)) if k < 4 else flat[k - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        inside = np.arange(len(key)) + k <= end[word[: len(key)]]
        if k < 4:
            at = np.flatnonzero(inside)
            out.append(T.mix64(key[at] + np.uint64(k << 8)))
            owner.append(word[at])
        if k > 1:
            has = np.flatnonzero(size >= k)
            for kind, at in ((1, begin[has]), (2, end[has] - k)):
                out.append(T.mix64(key[at] + np.uint64(kind << 62)))
                owner.append(has)
    if len(lexicon):
        found = T.run_hashes(flat, begin, end)
        row = np.minimum(np.searchsorted(lexicon, found), len(lexicon) - 1)
        at = np.flatnonzero(lexicon[row] == found)
        for salt in (3, 4):
            out.append(T.mix64(lexicon_label[row[at]].astype(np.uint64) + np.uint64(salt << 60)))
            owner.append(at)
    return (np.concatenate(out) % np.uint64(FEATURES)).astype(np.int64), np.concatenate(owner)


def potentials(weights: np.ndarray, feature: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Emission scores, a row a word: the mean weight of its features times the root of their number."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    return np.stack([np.bincount(owner, weights[feature, j], n) for j in range(weights.shape[1])], 1) * scale[:, None]


def expectations(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (sequence, place, label) and expected moves for equally long sequences of potentials."""
    s, n, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    now = np.full((s, k), 1.0 / k)
    for t in range(n):
        now = (now @ a) * e[:, t]
        now /= now.sum(1, keepdims=True)
        alpha[:, t] = now
    for t in range(n - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (beta * e)[:, 1:, None, :]
    return gamma, (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))


def learn_lexicon(hashed: np.ndarray, doc: np.ndarray, langs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and labels of the LEXICON_WORDS words a label that mark it best by document frequency."""
    pairs = np.unique(np.stack((hashed, doc.astype(np.uint64)), 1), axis=0)
    words, back = np.unique(pairs[:, 0], return_inverse=True)
    counts = np.zeros((len(words), k))
    np.add.at(counts, (back, langs[pairs[:, 1].astype(np.int64)]), 1)
    total, keep, label = counts.sum(1), [], []
    for j in range(k):
        at = np.flatnonzero((counts[:, j] >= 3) & (counts[:, j] > 0.8 * total))
        at = at[np.lexsort((at, -(2 * counts[at, j] - total[at])))[:LEXICON_WORDS]]
        keep.append(at)
        label.append(np.full(len(at), j))
    keep, label = np.concatenate(keep), np.concatenate(label)
    order = np.argsort(words[keep])
    return words[keep][order], label[order]


def train(texts: list[str], names: list[str], seed: int = 3) -> Crf | None:
    """Fit a field on texts with one language each; None if no text has a letter.

    Training sequences splice spans of different documents, so that the transitions see texts that switch language. Weights
    are fitted by Adam on the exact gradient: expected minus observed features and moves.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw, off = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64)
    if not len(raw):
        return None
    cp, _, rows = T.code_points(raw, off)
    starts, ends, doc = T.runs(T.code_point_classes()[cp] == T.LETTER, rows)
    if not len(starts):
        return None
    labels = sorted({names[d] for d in np.unique(doc).tolist()})
    langs = np.array([labels.index(x) if x in labels else 0 for x in names])
    k = len(labels)
    flat, begin, size = padded(cp, starts, ends)
    hashed = T.run_hashes(flat, begin, begin + size)
    lexicon, lexicon_label = learn_lexicon(hashed, doc, langs, k)
    vocabulary, where, number = np.unique(hashed, return_index=True, return_inverse=True)
    n = len(vocabulary)
    part = padded(cp, starts[where], ends[where])
    feature, owner = features(*part, lexicon, lexicon_label)
    scale = (1 / np.sqrt(np.bincount(owner, minlength=n)))[owner]
    rng = np.random.default_rng(seed)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    some = np.flatnonzero(np.diff(at))
    groups = [some[langs[some] == j] for j in range(k)]
    idx, tag = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        filled = 0
        while filled < LENGTH:
            j = int(rng.integers(k))
            d = int(rng.choice(groups[j]))
            take = min(int(rng.integers(6, LENGTH)), LENGTH - filled, int(at[d + 1] - at[d]))
            first = int(at[d] + rng.integers(at[d + 1] - at[d] - take + 1))
            idx[s, filled : filled + take], tag[s, filled : filled + take] = number[first : first + take], j
            filled += take
    theta = np.zeros(FEATURES * k + k * k)
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((k, k))
    np.add.at(seen, (tag[:, :-1].ravel(), tag[:, 1:].ravel()), 1)
    truth = np.eye(k)[tag]
    for step in range(1, STEPS + 1):
        w, m = theta[: FEATURES * k].reshape(FEATURES, k), theta[FEATURES * k :].reshape(k, k)
        score = potentials(w, feature, owner, n)
        e = np.exp(score - score.max(1, keepdims=True))[idx] + 1e-12
        gamma, moves = expectations(e, np.exp(m - m.max()))
        off_by = (gamma - truth).reshape(-1, k)
        per_word = np.stack([np.bincount(idx.ravel(), off_by[:, j], n) for j in range(k)], 1)
        grad_w = np.stack([np.bincount(feature, per_word[owner, j] * scale, FEATURES) for j in range(k)], 1)
        grad = np.concatenate((grad_w.ravel(), (moves - seen).ravel())) / SEQUENCES + DECAY * theta
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad * grad
        theta -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, theta[: FEATURES * k].reshape(FEATURES, k), theta[FEATURES * k :].reshape(k, k), lexicon, lexicon_label)


def word_probabilities(e: np.ndarray, off: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by exact forward-backward; ``off`` are the documents' offsets into the words.

    Documents are cut into blocks of BLOCK words. The product of a block's transition matrices is formed for all blocks at
    once, carried from block to block within each document, and the blocks are then filled in at once again.
    """
    a = np.exp(moves - moves.max())
    k = a.shape[0]
    size = np.diff(off)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    gamma = np.zeros_like(e)
    if not nb:
        return gamma
    doc = np.repeat(np.arange(len(size)), blocks)
    begin = off[doc] + (np.arange(nb) - first[doc]) * BLOCK
    length = np.minimum(off[doc + 1] - begin, BLOCK)
    place = begin[:, None] + np.arange(BLOCK)
    valid = np.arange(BLOCK) < length[:, None]
    pot = e[np.where(valid, place, 0)]
    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        go = np.flatnonzero(valid[:, t])
        if not len(go):
            break
        new = (product[go].reshape(-1, k) @ a).reshape(-1, k, k) * pot[go, t][:, None, :]
        product[go] = new / new.sum((1, 2), keepdims=True)
    ahead, behind = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    order = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max())):
        on = order[: int(np.searchsorted(-blocks[order], -j, "left"))]
        b = first[on] + j
        x = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
        ahead[b] = x / x.sum(1, keepdims=True)
        b = first[on] + blocks[on] - 1 - j
        y = np.einsum("bij,bj->bi", product[b + 1], behind[b + 1])
        behind[b] = y / y.sum(1, keepdims=True)
    alpha = np.empty_like(pot)
    now = ahead
    for t in range(BLOCK):
        new = (now @ a) * pot[:, t]
        now = np.where(valid[:, t : t + 1], new / np.maximum(new.sum(1, keepdims=True), 1e-300), now)
        alpha[:, t] = now
    now = behind
    for t in range(BLOCK - 1, -1, -1):
        on = valid[:, t]
        g = alpha[:, t] * now
        gamma[place[on, t]] = (g / g.sum(1, keepdims=True))[on]
        new = (now * pot[:, t]) @ a.T
        now = np.where(on[:, None], new / np.maximum(new.sum(1, keepdims=True), 1e-300), now)
    return gamma


class Tagger:
    """Word and document labels of a chunk of texts; keeps the potentials of the words met so far.

    Words are found by their 64-bit hashes and confirmed by their letters.
    """

    def __init__(self, model: Crf) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pot = np.zeros((0, len(self.model.labels)))
        self.letters, self.letters_at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first = len(self.pot)
        score = potentials(self.model.weights, *features(*padded(cp, starts, ends), self.model.lexicon, self.model.lexicon_label), len(starts))
        self.pot = np.concatenate((self.pot, np.exp(score - score.max(1, keepdims=True)) + 1e-12))
        size = ends - starts
        self.letters_at = np.concatenate((self.letters_at, len(self.letters) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.letters = np.concatenate((self.letters, cp[T.spans(starts, size)]))
        return np.arange(first, len(self.pot))

    def potentials(self, raw: np.ndarray, at: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found, where, back = np.unique(T.run_hashes(raw, at[starts], at[ends]), return_index=True, return_inverse=True)
        if len(self.pot) > STORE_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[place] != found) if len(self.known) else np.arange(len(found))
        if len(fresh):
            rows = self.add(cp, starts[where[fresh]], ends[where[fresh]])
            known = np.concatenate((self.known, found[fresh]))
            order = np.argsort(known, kind="stable")
            self.known, self.row = known[order], np.concatenate((self.row, rows))[order]
            place = np.searchsorted(self.known, found)
        row = self.row[place][back]
        other = T.unlike(cp, starts, ends - starts, self.letters, self.letters_at[row], self.size[row])
        if len(other):
            row[other] = self.add(cp, starts[other], ends[other])
        return self.pot[row]

    def tags(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities of all words of a chunk, their letters, and the documents' offsets into the words."""
        k, n = len(self.model.labels), len(off) - 1
        nothing = np.zeros((0, k)), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if not len(raw):
            return nothing
        cp, at, rows = T.code_points(raw, off)
        starts, ends, doc = T.runs(T.code_point_classes()[cp] == T.LETTER, rows)
        if not len(starts):
            return nothing
        words = np.searchsorted(doc, np.arange(n + 1))
        return word_probabilities(self.potentials(raw, at, cp, starts, ends), words, self.model.moves), ends - starts, words

    def shares(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Expected share of each label in the letters of each document; zeros without letters."""
        gamma, letters, words = self.tags(raw, off)
        total = np.vstack((np.zeros(gamma.shape[1]), np.cumsum(gamma * letters[:, None], axis=0)))
        count = np.concatenate(([0], np.cumsum(letters)))
        return (total[words[1:]] - total[words[:-1]]) / np.maximum(count[words[1:]] - count[words[:-1]], 1)[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """Train on a bounded sample of the documents that aren't held out and have a language; None if there are none."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    chosen = sample_by_class(rows, lang_col, SAMPLE_DOCS, id_col)
    texts = rows.join(F.broadcast(chosen), F.col(id_col) == F.col("__sample_id")).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    found = sorted({(r.t, r.l): r.i for r in texts.collect()}.items(), key=lambda x: (x[1], x[0]))
    return train([t for (t, _), _ in found], [lang for (_, lang), _ in found])


def predict(docs: DataFrame, model: Crf | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``: the label's expected share of the letters of the whole text.

    Cases: a null text or one without a letter gets ``und`` and 0, as does every text if there is no model; ties go to the
    label first in code point order; equal texts get equal labels and scores; a text of any length is read whole, also where
    it is one word; an empty table gives no rows. Other columns aren't read; input columns of these names are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    schema = type(docs.schema)([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    if model is None:
        return docs.select(*(f"`{c}`" for c in keep), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in T.chunks(batches, "__li_text"):
            share = tagger.shares(*T.utf8(batch.column(batch.schema.get_field_index("__li_text"))))
            best, some = share.argmax(1), share.sum(1) > 0
            langs = [tagger.model.labels[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.minimum(share.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(langs, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*(f"`{c}`" for c in keep), F.col(text_col).alias("__li_text")).mapInArrow(run, schema)
