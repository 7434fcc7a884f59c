"""The features and lexicons of the models against plain versions, word by word."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyloom.llm import language_id, toxicity
from tallyloom.llm import textbytes as T

WORD = rb"[A-Za-z\x80-\xff]+"


def hashes(words):
    return [int(x) for x in T.run_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]) - [len(w) for w in words], np.cumsum([len(w) for w in words]))] if words else []


def sample(n, seed):
    rng = random.Random(seed)
    pool = ["you", "idiot", "Idiot", "1d10t", "$tup1d", "stupid", "YOU", "WHAT", "été", "fine", "a", "b2b", "ok!", "really?", "--", "漢字", "tu", "don't", "stup!d"]
    return ["", "  ", "!!!", *(rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def plain_features(text, lexicon):
    raw = text.encode()
    words = [w.lower() for w in re.findall(WORD, raw)]
    letters = sum(len(w) for w in words)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    second = [i for i, w in enumerate(words) if w.decode() in toxicity.SECOND_PERSON]
    near = sum(max([1 / max(abs(i - j), 1) for j in second if abs(i - j) <= toxicity.NEAR], default=0) for i in hits)
    tokens = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    is_letter = lambda b: re.match(WORD, bytes([b])) is not None
    symbol, digit, capital = (lambda b: 33 <= b < 127 and not chr(b).isalnum()), (lambda b: 48 <= b < 58), (lambda b: 65 <= b < 91)
    mixed = [t for t in tokens if sum(map(is_letter, t)) >= 2 and any(symbol(b) or digit(b) for b in t[1:-1])]
    shout = [t for t in tokens if len(t) >= 3 and sum(map(capital, t)) >= 3 and sum(map(capital, t)) == sum(map(is_letter, t))]
    opened = bytes(ord(toxicity.LOOKALIKE.get(chr(b), chr(b))) if b < 128 else b for b in raw.lower())
    hidden = max(sum(w in lexicon for w in re.findall(WORD, opened)) - len(hits), 0) if mixed else 0
    n, chars, spaced = max(len(words), 1), max(len(raw), 1), max(len(tokens), 1)
    return [
        sum(lexicon[words[i]] for i in hits) / n, len(hits) / n, math.log1p(len(hits)), max([lexicon[words[i]] for i in hits], default=0), len(second) / n, near / n, sum(map(capital, raw)) / max(letters, 1), len(shout) / spaced,
        raw.count(b"!") / chars, raw.count(b"?") / chars, sum(map(symbol, raw)) / chars, sum(map(digit, raw)) / chars, len(mixed) / spaced, hidden / n, math.log1p(len(words)), letters / n,
    ]


def test_toxicity_features_equal_plain_ones():
    lexicon = {b"idiot": 2.5, b"stupid": 3.0, "été".encode(): 2.0}
    table = np.array(sorted(zip(hashes(list(lexicon)), lexicon.values(), strict=True)), object)
    texts = sample(60, 1)
    got = toxicity.text_features(*T.utf8(pa.array(texts)), table[:, 0].astype(np.uint64), table[:, 1].astype(float))
    assert got.shape == (len(texts), len(toxicity.FEATURES))
    for k, text in enumerate(texts):
        # a text of a chunk where no token is mixed isn't read again without its lookalikes
        assert np.allclose(got[k], plain_features(text, lexicon)), (text, got[k])


def test_toxicity_lexicon_equals_a_plain_one():
    texts, rng = sample(200, 2), random.Random(3)
    y = np.array([float(rng.random() < 0.3) for _ in texts])
    texts = [t + rng.choice([" venom", " Venom bile", " bile"]) if v else t for t, v in zip(texts, y, strict=True)]
    seen = [{w.lower() for w in re.findall(WORD, t.encode())} for t in texts]
    bad, total = Counter(w for s, v in zip(seen, y, strict=True) if v for w in s), Counter(w for s in seen for w in s)
    weight = {w: math.log((bad[w] + 0.5) / (y.sum() + 1)) - math.log((total[w] - bad[w] + 0.5) / ((1 - y).sum() + 1)) for w in total}
    keep = {w: x for w, x in weight.items() if bad[w] >= toxicity.LEXICON_SUPPORT and x >= toxicity.LEXICON_WEIGHT}
    half = len(texts) // 2
    words, weights = toxicity.learn_lexicon((*T.utf8(pa.array(texts[a:b])), y[a:b]) for a, b in ((0, half), (half, len(texts))))
    want = dict(zip(hashes(list(keep)), keep.values(), strict=True))
    assert keep and {int(w): round(float(x), 9) for w, x in zip(words, weights, strict=True)} == {w: round(x, 9) for w, x in want.items()}


def test_language_features_equal_plain_ones():
    """n-grams of one to three letters, affixes of two to four with the marks at a word's ends, and the word's lexicon entry."""
    words = ["a", "ab", "Straße", "ÉTÉ", "漢字", "international"]
    text = " ".join(words)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    flat, begin, size = language_id.padded(cp, ends - [len(w) for w in words], ends)
    known = [[1, *map(ord, w.lower()), 2] for w in words]
    assert [flat[b : b + n].tolist() for b, n in zip(begin, size, strict=True)] == known
    entry = T.run_hashes(flat, begin, begin + size)[[1, 5]]
    order = np.argsort(entry)
    got, owner = language_id.features(flat, begin, size, entry[order], np.array([0, 1])[order])
    mul, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    key = lambda g: sum(c << 21 * i if i < 3 else c * mul for i, c in enumerate(g)) & mask
    mix = lambda x: int(T.mix64(np.array([x & mask], np.uint64))[0]) % language_id.FEATURES
    for i, w in enumerate(known):
        want = [mix(key(w[a : a + k]) + (k << 8)) for k in (1, 2, 3) for a in range(len(w) - k + 1)]
        want += [mix(key(g) + (kind << 62)) for k in (2, 3, 4) if len(w) >= k for kind, g in ((1, w[:k]), (2, w[-k:]))]
        want += [mix({1: 0, 5: 1}[i] + (salt << 60)) for salt in (3, 4)] if i in (1, 5) else []
        assert sorted(got[owner == i].tolist()) == sorted(want), words[i]
