"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: density of words from a learned lexicon, their distance to words in the second person, capitals, punctuation, and
rates of obfuscated words. Everything is computed from the bytes of a chunk of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes as T
from tallyloom.llm.folds import held_out, sample_by_hash
from tallyloom.session import ship_package

#: The model is fitted on so many labelled rows at most, chosen by hash, with texts of SAMPLE_CHARS at most.
SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 20_000
TRAIN_CHUNK = 250
LEXICON_WORDS = 5000
LEXICON_SUPPORT, LEXICON_WEIGHT = 3, 2.0
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 5.0
NEAR = 10
#: Words in the second person; fixed values.
SECOND_PERSON = "you your yours yourself u tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch usted ustedes ti vosotros".split()
#: Characters that stand for letters in obfuscated words; fixed values.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("weight_density", "hit_rate", "log_hits", "top_weight", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "questions", "symbols", "digits", "mixed_words", "hidden_hits", "log_words", "word_size")

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_OPEN = T.LOWER.copy()
for _a, _b in LOOKALIKE.items():
    _OPEN[ord(_a)] = ord(_b)


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    xs: np.ndarray
    ys: np.ndarray


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = T.runs(T.LETTERS[raw], off)
    return T.run_hashes(raw, starts, ends), doc, ends - starts


def _hash_of(words: list[str]) -> np.ndarray:
    blob = [w.encode() for w in words]
    ends = np.cumsum([len(b) for b in blob])
    return np.sort(T.run_hashes(np.frombuffer(b"".join(blob), np.uint8), ends - [len(b) for b in blob], ends))


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row of each x in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    row = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[row] == x, row, -1)


def text_features(raw: np.ndarray, off: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of the chunk; all zeros for an empty text."""
    n = len(off) - 1
    per_doc = lambda doc, w=None: np.bincount(doc, w, n)[:n]
    low = T.LOWER[raw]
    hashed, doc, size = _words(low, off)
    count, chars = np.maximum(per_doc(doc), 1), np.maximum(np.diff(off), 1)
    row = _lookup(words, hashed)
    hit = np.flatnonzero(row >= 0)
    weight = weights[row[hit]]
    second = np.flatnonzero(_lookup(_hash_of(SECOND_PERSON), hashed) >= 0)
    near = np.zeros(len(hit))
    if len(second):
        for side in (-1, 0):
            at = second[np.clip(np.searchsorted(second, hit) + side, 0, len(second) - 1)]
            gap = np.abs(at - hit)
            near = np.maximum(near, np.where((doc[at] == doc[hit]) & (gap <= NEAR), 1 / np.maximum(gap, 1), 0))
    top = np.zeros(n)
    np.maximum.at(top, doc[hit], weight)
    tokens, ends, owner = T.runs(T.NOT_SPACE[raw], off)
    spaced = np.maximum(per_doc(owner), 1)
    sums = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    letters, symbols, digits, capitals = sums(T.LETTERS[raw]), sums(_SYMBOL[raw]), sums(_DIGIT[raw]), sums(_CAPITAL[raw])
    inner = np.maximum(ends - 1, tokens + 1)
    mixed = (letters[ends] - letters[tokens] >= 2) & ((symbols[inner] - symbols[tokens + 1]) + (digits[inner] - digits[tokens + 1]) > 0)
    shout = (ends - tokens >= 3) & (capitals[ends] - capitals[tokens] >= 3) & (capitals[ends] - capitals[tokens] == letters[ends] - letters[tokens])
    opened, open_doc, _ = _words(_OPEN[raw], off) if len(raw) and (mixed.any()) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
    hidden = np.maximum(per_doc(open_doc[_lookup(words, opened) >= 0]) - per_doc(doc[hit]), 0)
    span = lambda c: c[off[1:]] - c[off[:-1]]
    return np.stack([
        per_doc(doc[hit], weight) / count, per_doc(doc[hit]) / count, np.log1p(per_doc(doc[hit])), top,
        per_doc(doc[second]) / count, per_doc(doc[hit], near) / count, span(capitals) / np.maximum(span(letters), 1), per_doc(owner[shout]) / spaced,
        span(sums(raw == ord("!"))) / chars, span(sums(raw == ord("?"))) / chars, span(symbols) / chars, span(digits) / chars,
        per_doc(owner[mixed]) / spaced, hidden / count, np.log1p(per_doc(doc)), per_doc(doc, size) / count,
    ], 1)


def learn_lexicon(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the words that mark toxic texts, by smoothed log odds of document frequencies.

    ``parts`` are chunks of texts (bytes, offsets, labels); only their word counts are kept. No texts give no words.
    """
    found, bad, all_of, toxic, clean = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.int64)], 0.0, 0.0
    for raw, off, y in parts:
        hashed, doc, _ = _words(T.LOWER[raw], off)
        order = np.lexsort((hashed, doc))
        hashed, doc = hashed[order], doc[order]
        once = np.append(True, (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1]))[: len(hashed)]
        words, back = np.unique(hashed[once], return_inverse=True)
        found.append(words)
        bad.append(np.bincount(back, y[doc[once]], len(words)))
        all_of.append(np.bincount(back, minlength=len(words)))
        toxic, clean = toxic + y.sum(), clean + (1 - y).sum()
    words, back = np.unique(np.concatenate(found), return_inverse=True)
    bad, total = np.bincount(back, np.concatenate(bad)), np.bincount(back, np.concatenate(all_of))
    weight = np.log((bad + 0.5) / (toxic + 1)) - np.log((total - bad + 0.5) / (clean + 1))
    keep = np.flatnonzero((bad >= LEXICON_SUPPORT) & (weight >= LEXICON_WEIGHT))
    keep = np.sort(keep[np.lexsort((keep, -weight[keep] * np.sqrt(bad[keep])))[:LEXICON_WORDS]])
    return words[keep], weight[keep]


def boost(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic boosting of complete trees over histogram bins: features, cuts and leaf values, a row a tree.

    Without rows all values are 0.
    """
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(DEPTH):
            for k in range(2**d - 1, 2 ** (d + 1) - 1):
                on = np.flatnonzero(node == k)
                best = 1e-6
                for j in range(x.shape[1]):
                    if not len(edges[j]) or not len(on):
                        continue
                    gs, hs = np.cumsum(np.bincount(binned[on, j], g[on], BINS)), np.cumsum(np.bincount(binned[on, j], h[on], BINS))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(hs < LEAST / 20) | (hs[-1] - hs < LEAST / 20)] = 0
                    b = int(gain[: len(edges[j])].argmax())
                    if gain[b] > best:
                        best, feature[t, k], cut[t, k] = gain[b], j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        raw += value[t, leaf]
    return feature, cut, value, base


def raw_score(x: np.ndarray, m: Model) -> np.ndarray:
    out, rows = np.full(len(x), m.base), np.arange(len(x))
    for t in range(len(m.feature)):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, m.feature[t, node]] > m.cut[t, node])
        out += m.value[t, node - (2**DEPTH - 1)]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the best rising fit of y to x. Without rows, knots of the logistic function."""
    if not len(x):
        knots = np.linspace(-8, 8, 65)
        return knots, 1 / (1 + np.exp(-knots))
    at, back = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # first x, last x, sum, count; equal x are one from the beginning
    for v, total, n in zip(at.tolist(), np.bincount(back, y).tolist(), np.bincount(back).tolist(), strict=True):
        blocks.append([v, v, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = [v for b in blocks for v in b[:2]]
    ys = [b[2] / b[3] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)


def train(texts: list[str], y: np.ndarray) -> Model | None:
    """Fit lexicon, trees and calibration on parts of 40, 40 and 20 percent of the texts, however many there are.

    None without both labels.
    """
    if not len(y) or y.min() == y.max():
        return None
    part = np.arange(len(y)) % 5

    def chunks(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.flatnonzero(which)
        for i in range(0, len(at), TRAIN_CHUNK):
            own = [texts[j].encode("utf-8", "surrogatepass") for j in at[i : i + TRAIN_CHUNK]]
            yield np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in own]))).astype(np.int64), y[at[i : i + TRAIN_CHUNK]]

    a, b, c = part < 2, (part == 2) | (part == 3), part == 4
    words, weights = learn_lexicon(chunks(a))
    none = np.zeros((0, len(FEATURES)))
    table = lambda which: np.vstack([none, *(text_features(raw, off, words, weights) for raw, off, _ in chunks(which))])
    feature, cut, value, base = boost(table(b), y[b])
    m = Model(words, weights, feature, cut, value, base, np.zeros(1), np.zeros(1))
    m.xs, m.ys = isotonic(raw_score(table(c), m), y[c])
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on a bounded sample, chosen by hash, of the labelled documents that aren't held out.

    Equal texts count once. Of several labels of a document or text the largest counts; null labels don't count.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__tx_id"), F.col(label_col).cast("int").alias("__tx_y"))
    chosen = sample_by_hash(known, ["__tx_id", "__tx_y"], SAMPLE_ROWS)
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS)).join(F.broadcast(chosen), F.col(id_col) == F.col("__tx_id"))
    rows: dict[str, tuple] = {}
    for r in texts.select("__tx_id", F.col(text_col).alias("t"), F.col("__tx_y").alias("y")).collect():
        old = rows.get(r.t, (r["__tx_id"], 0))
        rows[r.t] = (min(old[0], r["__tx_id"]), max(old[1], int(r.y == 1)))
    order = sorted(rows.items(), key=lambda x: (x[1][0], x[0]))
    return train([t for t, _ in order], np.array([y for _, (_, y) in order], np.float64))


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on).

    Cases: a null text counts as empty and is scored like any text; without a model all scores are 0; equal texts get equal
    scores; a text of any length is read whole; an empty table gives no rows. Other columns aren't read; input columns of
    these names are replaced.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    schema = type(docs.schema)([docs.schema[c] for c in keep]).add("score", "double")
    if model is None:
        return docs.select(*(f"`{c}`" for c in keep), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_WORDS words and TREES small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in T.chunks(batches, "__tx_text"):
            x = text_features(*T.utf8(batch.column(batch.schema.get_field_index("__tx_text"))), m.words, m.weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.interp(raw_score(x, m), m.xs, m.ys))], names=[*keep, "score"])

    given = docs.select(*(f"`{c}`" for c in keep), F.col(text_col).alias("__tx_text"))
    return given.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
