"""Small and edge cases of the training-data operators, against plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, components, hamming_search, language_id, line_dedup, mixing, near_dup, queries, token_counts, toxicity, warc, winnow
from tallyloom.llm import textbytes as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, lines string, size string"
LONG = "word " * 30_000


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in texts], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n\n "), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (5, LONG), (6, "é🙂 漢字 don't " * 50)]


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def test_line_dedup(spark):
    docs = frame(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "p\np\np\np")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("", 3, 3), 4: ("p", 4, 3)}


def edge_frame(spark, rows):
    """The cases with columns of the operators' own names beside them."""
    own = ("n_lines", "n_removed", "target", "taken", "repeats", "n_shingles", "kept", "lang_pred", "score", "ids", "n_tokens", "word_chars")
    return frame(spark, rows).select("*", *(F.lit("own").alias(c) for c in own))


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_edge_values_of_lines_and_mixing(spark):
    docs = edge_frame(spark, EDGE)
    lines = {None: 0, "": 1, " \n\n ": 3, "a b": 1, LONG: 1, EDGE[-1][1]: 1}
    assert values(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_removed") == sorted(((i, t, lines[t], 0) for i, t in EDGE), key=str)
    mixed = mixing.mix_sources(docs).collect()
    size = lambda t: len((t or "").split())
    assert sorted(((r.doc_id, r["size"]) for r in mixed), key=str) == sorted(((i, size(t)) for i, t in EDGE), key=str)
    total = sum(size(t) for _, t in EDGE)
    assert {(r.source_size, r.target) for r in mixed} == {(total, float(total))} and sum(r.taken for r in mixed) == total
    assert {r.n_lines for r in mixed} == {"own"}


def test_edge_values_of_near_duplicates(spark):
    out = near_dup.near_duplicates(edge_frame(spark, EDGE), keep=["doc_id", "kept", "score"])
    n6 = len({tuple(x) for x in zip(*(EDGE[-1][1].lower().split()[k:] for k in range(5)), strict=False)})
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, False), (None, 0, None, True), (5, 1, 5, True), (6, n6, 6, True)]
    assert values(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    assert {r.score for r in out.collect()} == {"own"}


def test_edge_values_of_tokens(spark, vocabulary):
    docs = edge_frame(spark, EDGE)
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in EDGE}
    want = sorted(((i, len(ids[t]), hashlib.sha256(np.array(ids[t], "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE), key=str)
    assert values(bpe.round_trip(docs, vocabulary, ["doc_id"]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    edited = docs.withColumn("edits", token_counts.sample_edits(F.col("text"), F.col("source")))
    done = token_counts.apply_edits(token_counts.build_trees(edited, vocabulary), vocabulary)
    assert values(done, "doc_id", "n_tokens") == sorted(((i, len(ids[t])) for i, t in EDGE), key=str)
    assert all(r.edited_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) == sum(r.word_tokens) for r in done.collect())


def test_edge_values_of_models(spark):
    docs = edge_frame(spark, EDGE)
    found = values(language_id.predict(docs, language_id.fit(docs), ["doc_id", "text"]), "doc_id", "text", "lang_pred")
    assert found == sorted(((i, t, "en" if (t or "").strip() else "und") for i, t in EDGE), key=str)
    assert values(language_id.predict(docs, None, ["doc_id"]), "lang_pred", "score") == [("und", 0.0)] * len(EDGE)
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(EDGE)] + [(6, None)], "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["text"]).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if not r.text}) == 1 and len({r.score for r in scored if r.text == "a b"}) == 1
    assert values(toxicity.score(docs, None, []), "score", "predicted") == [(0.0, 0)] * len(EDGE)


def test_empty_tables(spark, vocabulary):
    docs = edge_frame(spark, EDGE).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    edited = docs.withColumn("edits", token_counts.sample_edits(F.col("text"), F.col("source")))
    for out in (
        line_dedup.dedup_lines(docs), mixing.mix_sources(docs), winnow.compare_edits(docs), near_dup.near_duplicates(docs), bpe.round_trip(docs, vocabulary, ["doc_id"]),
        token_counts.apply_edits(token_counts.build_trees(edited, vocabulary), vocabulary), language_id.predict(docs, language_id.fit(docs), ["doc_id"]), toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]),
    ):
        assert out.collect() == []


def test_blank_windows_are_windows(spark):
    docs = frame(spark, [(1, "a\n\n\n\nb"), (2, "c\n\n\n\nd")])
    assert values(line_dedup.dedup_lines(docs), "doc_id", "text") == [(1, "a\n\n\n\nb"), (2, "c\nd")]
    assert values(line_dedup.dedup_lines(docs, skip_blank=True), "doc_id", "text") == [(1, "a\n\n\n\nb"), (2, "c\n\n\n\nd")]


def test_every_letter_of_a_long_word_counts():
    """Two words of 308 letters that differ in their middle have different features and probabilities."""
    rng = random.Random(1)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [" ".join(word(letters, 6) for _ in range(40)) for letters in ("abcd", "wxyz") for _ in range(30)]
    model = language_id.train(texts, ["one"] * 30 + ["two"] * 30)
    edge = word("abcd", 60)
    pair = [edge + word(letters, 188) + edge for letters in ("abcd", "wxyz")]
    assert [model.labels[i] for i in language_id.Tagger(model).shares(*T.utf8(pa.array(pair))).argmax(1)] == ["one", "two"]


def test_word_labels_in_mixed_text_equal_plain_forward_backward():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word(letters) for _ in range(50)) for letters in ("abcde", "vwxyz", "abxyz") for _ in range(25)]
    model = language_id.train(texts, ["l1"] * 25 + ["l2"] * 25 + ["l3"] * 25)
    mixed = " ".join([word("abcde") for _ in range(90)] + [word("vwxyz") for _ in range(90)])
    gamma, letters, _ = language_id.Tagger(model).tags(*T.utf8(pa.array(["", mixed])))
    words = mixed.split()
    assert letters.tolist() == [len(w) for w in words]
    e = []
    for w in words:
        cp = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        f, owner = language_id.features(*language_id.padded(cp, np.array([0]), np.array([len(w)])), model.lexicon, model.lexicon_label)
        s = language_id.potentials(model.weights, f, owner, 1)[0]
        e.append(np.exp(s - s.max()) + 1e-12)
    a, k = np.exp(model.moves - model.moves.max()), len(model.labels)
    alpha, beta = [np.full(k, 1 / k) @ a * e[0]], [np.ones(k)]
    for x in e[1:]:
        alpha.append(alpha[-1] / alpha[-1].sum() @ a * x)
    for x in e[:0:-1]:
        beta.append(a @ (x * beta[-1]) / (x * beta[-1]).sum())
    want = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(gamma, want / want.sum(1, keepdims=True))
    assert (gamma.argmax(1)[:80] == model.labels.index("l1")).mean() > 0.9 and (gamma.argmax(1)[-80:] == model.labels.index("l2")).mean() > 0.9


def test_isotonic_fit_equals_min_max_formula():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 25, 120).astype(float), rng.integers(0, 2, 120).astype(float)
    xs, ys = toxicity.isotonic(x, y)
    at = np.unique(x)
    mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
    want = [max(min(mean(a, b) for b in at if b >= v) for a in at if a <= v) for v in at]
    assert np.allclose(np.interp(at, xs, ys), want) and (np.diff(ys) >= 0).all()
    xs, ys = toxicity.isotonic(np.zeros(0), np.zeros(0))
    assert np.allclose(np.interp([0.0, 2.0], xs, ys), 1 / (1 + np.exp([0.0, -2.0])))


def test_boosting_equals_plain_boosting():
    """Splits by the largest gain over all features and cuts, leaves by Newton steps, one tree after another."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (160, 3)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 2] > 4) + rng.random(160) > 6).astype(float)
    feature, cut, value, base = toxicity.boost(x, y)
    raw = np.full(160, base)
    assert base == pytest.approx(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for j in range(3)]
    for t in range(4):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(160, int)
        for d in range(toxicity.DEPTH):
            for k in range(2**d - 1, 2 ** (d + 1) - 1):
                on = node == k
                best = 1e-6
                for j in range(3):
                    for e in edges[j]:
                        left = on & (x[:, j] <= e)
                        right = on & (x[:, j] > e)
                        if min(h[left].sum(), h[right].sum()) >= toxicity.LEAST / 20:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[on].sum() ** 2 / (h[on].sum() + 1)
                            best = max(best, gain)
                f, c = feature[t, k], cut[t, k]
                left, right = on & (x[:, f] <= c), on & (x[:, f] > c)
                got = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[on].sum() ** 2 / (h[on].sum() + 1)
                assert (best == 1e-6 and np.isinf(c)) or got == pytest.approx(best)
            node = 2 * node + 1 + (x[np.arange(160), feature[t, node]] > cut[t, node])
        leaf = node - (2**toxicity.DEPTH - 1)
        step = np.array([toxicity.RATE * g[leaf == k].sum() / (h[leaf == k].sum() + 1) for k in range(2**toxicity.DEPTH)])
        assert np.allclose(value[t], step)
        raw += step[leaf]


@pytest.mark.parametrize("n", [0, 1, 3, 9, 60])
def test_toxicity_has_one_scheme_at_every_size(n):
    texts = [f"you are {'vile scum' if i % 2 else 'kind and good'} number {i}" for i in range(n)]
    y = np.array([i % 2 for i in range(n)], float)
    model = toxicity.train(texts, y)
    assert (model is None) == (n < 2)
    if model is not None:
        raw, off = T.utf8(pa.array(texts))
        score = np.interp(toxicity.raw_score(toxicity.text_features(raw, off, model.words, model.weights), model), model.xs, model.ys)
        assert ((score >= 0) & (score <= 1)).all() and (n < 60 or ((score >= 0.5) == y).mean() > 0.9)


def test_bpe_equals_library(vocabulary):
    random.seed(1)
    alphabet = [*"ab AB'stredlvm  \n\t\r\x0b\x1c\x1f\x85\xa0é²½Ⅷ漢字🙂́ .,!<|>09", "<|endoftext|>", "'ll", "'re", " 's"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["", "a" * 500]
    raw, off = T.utf8(pa.array(texts))
    ids, count = bpe.encode_chunk(bpe.WordStore(vocabulary), raw, off)
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


def test_bpe_digests(spark, vocabulary):
    text = "don't <|endoftext|> 漢字"
    row = bpe.round_trip(frame(spark, [(1, text)]), vocabulary, ["doc_id"]).first()
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    ids = library.encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_trees_equal_full_counts(vocabulary):
    """After random edits, also across added tokens, trees and texts are those of a full count; sums hold at every node."""
    random.seed(3)
    alphabet = [*"ab AB'stredlvm  \n\t\r\x0bé²漢字🙂 .,!09", "'ll", "'re", " 's", "<|endoftext|>", "<|endof", "text|>"]
    piece = lambda n: "".join(random.choice(alphabet) for _ in range(n))
    store = bpe.WordStore(vocabulary)
    texts = [piece(random.choice([0, 1, 50, 600])) for _ in range(300)]
    cp, _, rows = T.code_points(*T.utf8(pa.array(texts)))
    forest, held = token_counts.Forest(*token_counts.count_words(store, *T.utf8(pa.array(texts)))), token_counts.Texts(cp, rows)
    for _ in range(6):
        doc = np.array(sorted(random.sample(range(300), 200)))
        edits = [(random.randint(0, len(texts[d]) + 1), random.choice([0, 1, 5, 400]), piece(random.choice([0, 1, 9, 100]))) for d in doc]
        put, _, put_at = T.code_points(*T.utf8(pa.array([e[2] for e in edits])))
        held, again = token_counts.edit_round(forest, held, store, doc, np.array([e[0] for e in edits]), np.array([e[1] for e in edits]), put, np.diff(put_at))
        for d, (start, drop, new) in zip(doc, edits, strict=True):
            texts[d] = texts[d][: min(start, len(texts[d]))] + new + texts[d][start + drop :]
        sizes, counts, at = token_counts.count_words(store, *T.utf8(pa.array(texts)))
        assert held.cp.tobytes().decode("utf-32-le") == "".join(texts)
        assert np.array_equal(forest.sizes, sizes) and np.array_equal(forest.counts, counts) and np.array_equal(forest.at, at)
        assert forest.tokens.tolist() == [int(counts[a:b].sum()) for a, b in zip(at[:-1], at[1:], strict=True)]
        for d in range(300):
            for node in range(1, forest.width[d]):
                i = forest.base[d]
                assert np.array_equal(forest.sums[i + node], forest.sums[i + 2 * node] + forest.sums[i + 2 * node + 1])
        assert 0 < again.sum() < len(sizes)


def test_token_counts_equal_library_after_edits(spark, vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    texts = [(1, "one <|endof two"), (2, None), (3, ""), (4, LONG), (5, "a <|endoftext|> b"), (5, "a <|endoftext|> b")]
    edits = [[(12, 4, "text|> x")], [(0, 3, "new")], None, [(10, 0, "zz"), (100, 5, None), (10**6, 9, "end")], [(3, 1, "")], [(3, 1, "")]]
    rows = [(i, t, e) for (i, t), e in zip(texts, edits, strict=True)]
    df = spark.createDataFrame(rows, f"doc_id int, text string, edits {token_counts.EDIT_TYPE}")
    done = token_counts.apply_edits(token_counts.build_trees(df, vocabulary), vocabulary)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in done.collect():
        text, changes = next((t or "", e or []) for i, t, e in rows if i == r.doc_id)
        assert r.n_tokens == count(text)
        for start, drop, put in changes:
            text = text[:start] + (put or "") + text[start + drop :]
        assert (r.text or "") == text and r.edited_tokens == count(text) == sum(r.word_tokens) and sum(r.word_chars) == len(text)
    assert [r.text for r in done.where("doc_id = 3").collect()] == [""]


def test_words_of_equal_hash_are_told_apart(vocabulary, monkeypatch):
    """All words get one hash: only the comparison of bytes is left."""
    monkeypatch.setattr(T, "run_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["hello brave new world", "new hello", "abc", "xyz abd <|endoftext|>"]
    ids, count = bpe.encode_chunk(bpe.WordStore(vocabulary), *T.utf8(pa.array(texts)))
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_copies_among_other_texts_of_a_node_branch_once(spark, monkeypatch):
    """Near copies leave a large node whatever else is listed in it; all classes that look alike are connected."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, near_dup.COORDINATES, dtype=np.uint64).astype("<u4")

    def signatures(n, least, most):
        own = rng.integers(0, 1 << 32, (n, near_dup.COORDINATES), dtype=np.uint64).astype("<u4")
        return np.where(rng.random(own.shape) < rng.uniform(least, most, (n, 1)), base, own)

    sigs = np.concatenate([signatures(1500, 0.2, 0.4), signatures(1000, 0.88, 0.97)])
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "cid bigint, sig binary")
    branched, branch = [], near_dup.branch
    monkeypatch.setattr(near_dup, "branch", lambda rows, percent, root: (root or branched.append(rows.where("cid >= 1500").count()), branch(rows, percent, root))[1])
    edges = [(r.a, r.b) for r in near_dup.chosen_path_candidates(classes, 85, near_dup.TARGET_RECALL).collect()]
    assert sum(branched) < 10 * 1000  # ten trees with two nodes each hold most of the copies
    forest = near_dup.Forest(len(sigs))
    for a, b in edges:
        forest.join(a, b)
    x, y, _ = near_dup.agreements(*[sigs.astype(np.uint8)] * 2, near_dup.least_agreement(85))
    assert len(x) > 500_000 and all(forest.root(i) == forest.root(j) for i, j in zip(x.tolist(), y.tolist()))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_CLASSES", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 600)
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    base = [[random.choice(words) for _ in range(120)] for _ in range(8)]
    texts = []
    for i in range(120):
        own = list(base[i % 8])
        for _ in range(random.randint(0, 6)):
            own[random.randrange(len(own))] = random.choice(words)
        texts.append(" ".join(own))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    up = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: (len(sets[i]), up[i]) for i in range(len(texts))}


def test_filter_keeps_all_wanted_rows(spark):
    rows = spark.range(5000).selectExpr("if(id % 1000 = 7, null, id) AS doc", "id * 31 AS key", "cast(id AS string) AS text")
    wanted = rows.where("key % 3 = 0").select("doc", "key")
    kept = {r.key for r in near_dup.passing(rows, wanted, ["doc", "key"]).collect()}
    need = {r.key for r in wanted.collect()}
    assert need <= kept and len(kept) <= len(need) + 5
    assert near_dup.passing(rows, wanted.limit(0), ["doc", "key"]).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def plain_grams(unit):
    """Gram values of a list of units: tuples of units."""
    k = winnow.GRAM_UNITS
    return [tuple(unit[i : i + k]) for i in range(len(unit) - k + 1)] if len(unit) >= k else [tuple(unit)] * bool(unit)


def plain_units(text):
    """The units of a text: cut at blanks, behind characters of unspaced scripts and behind every 24 characters without blanks."""
    out, now, run = [], "", 0
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out, now, run = [*out, now], "", 0
            continue
        now, run = now + c, run + 1
        if "\u2e80" <= c <= "\uffff" or c > "\uffff" or run >= 24:
            out, now = [*out, now], ""
    return [u for u in [*out, now] if u]


def test_winnowing_equals_brute_force(spark):
    """Per window the smallest order value, the rightmost on ties; checked from the hashes of all grams (windows of one)."""
    random.seed(4)
    texts = ["", "   ", "ab", "a b", "ababababab" * 3, "one two three four five six seven", " ".join(["same"] * 60), "x" * 500, "漢字仮名" * 40, LONG[:5000], "ab " + "cd" * 40 + " " + "cd" * 12 + " ef"]
    texts += [" ".join(random.choice(["la", "lo", "7q7", "😀é", "b"]) for _ in range(random.randint(1, 120))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r for r in winnow.with_fingerprints(df, "t", "p").collect()}
    heads = {t: [c for c in t[:64] if c not in " \t\n\x0b\x0c\r"] for t in texts}
    value = {}  # of every gram, from texts that hold nothing else
    grams = sorted({g for t in texts for g in plain_grams(plain_units(t)) + plain_grams(heads[t])})
    single = spark.createDataFrame([(i, list(g)) for i, g in enumerate(grams)], "i int, u array<string>")
    rot = lambda c: F.shiftleft(c, 1).bitwiseOR(F.shiftrightunsigned(c, 63))
    rolled = F.xxhash64(F.aggregate(F.transform("u", lambda x: F.xxhash64(x)), F.lit(0).cast("long"), lambda a, x: rot(a).bitwiseXOR(x)))
    value = {grams[r.i]: r.v for r in single.select("i", rolled.alias("v")).collect()}

    def chosen(units, size):
        own = [value[g] for g in plain_grams(units)]
        at = []
        for end in range(len(own)):
            best = min(range(max(0, end - size + 1), end + 1), key=lambda p: (own[p] & (2**31 - 1), -p))
            if best not in at:
                at.append(best)
        return at, [own[p] for p in at]

    for i, text in enumerate(texts):
        (head_at, head), (at, own) = chosen(heads[text], 2), chosen(plain_units(text), 4)
        assert rows[i].p_at == [-1 - x for x in head_at] + at and rows[i].p == head + own, text


def test_likeness_does_not_depend_on_a_length(spark):
    """Texts that differ by one code point are near at all lengths, short and unspaced texts stay near their edit."""
    random.seed(3)
    words = lambda n: (" ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(n)))
    texts = [words(40)[:n] for n in (63, 64, 65, 100) for _ in range(10)]
    df = winnow.with_fingerprints(winnow.with_fingerprints(spark.createDataFrame([(t, t + "s") for t in texts], "t string, u string"), "t", "p"), "u", "q")
    assert all(jaccard(set(r.p), set(r.q)) > 0.9 for r in df.collect())
    got = lambda *t: {r.doc_id: r.near_edited for r in winnow.compare_edits(frame(spark, list(enumerate(t)))).collect()}
    assert got(words(40)[:70], "")[0] > 0.4
    assert got("bb" * 40, "QUITE ELSE " * 20)[0] > 0 and got("".join(random.choice("etaoinsh") for _ in range(5000)), "QUITE ELSE " * 200)[0] > 0.5


def test_winnowing_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(winnow.GRAM_UNITS + winnow.WINDOW_GRAMS - 1))
    df = spark.createDataFrame([(1, "a b c d e f " * 9 + shared + " x y" * 9), (2, "q r " * 20 + shared)], "i int, t string")
    rows = {r.i: r for r in winnow.with_fingerprints(df, "t", "p").collect()}
    assert set(rows[1].p) & set(rows[2].p)


def test_long_texts_keep_positions(spark):
    """The end of a long text gets the fingerprints that it gets in a short one, at shifted positions (32 bits hold them)."""
    text = lambda n: F.concat(F.repeat(F.lit("a "), n), F.lit("b c d e f g h"))
    df = spark.range(2).select("id", text(F.when(F.col("id") == 0, 60).otherwise(300_000)).alias("t"))
    short, long = winnow.with_fingerprints(df, "t", "p").orderBy("id").collect()
    assert long.p[-5:] == short.p[-5:] and [x - 300_000 for x in long.p_at[-5:]] == [x - 60 for x in short.p_at[-5:]]
    assert len(long.p) == len(long.p_at) and winnow.TOP == 2**32 - 1


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_edits(spark, monkeypatch):
    """Edited texts, order of ids, likeness and equal texts, also with many ranges of ids."""
    random.seed(6)
    monkeypatch.setattr(winnow, "DOCS_PER_RANGE", 10)
    monkeypatch.setattr(winnow, "RANGE_STEP", 3)
    rows = [(i * 3 - 50, " ".join(random.choice(["la", "lo", "le", "lu"]) for _ in range(random.choice([0, 3, 40, 90])))) for i in range(60)]
    rows += [(7, None), (8, ""), (9, "same text " * 20), (9, "same text " * 20), (-10**12, "abcdefgh"), (10**15, "xyz"), (None, "null id")]
    random.shuffle(rows)
    docs = frame(spark, rows)
    got = sorted(winnow.compare_edits(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {r.t: set(r.p) for r in winnow.with_fingerprints(spark.createDataFrame([(t,) for t in {t for _, t in order} | {r.edited_text for r in got}], "t string"), "t", "p").collect()}
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[k]
        assert (r.doc_id, r.n_chars, r.edited_text) == (i, len(text), edited)
        assert set(r.prints) == prints[text] and set(r.edited_prints) == prints[edited]
        assert r.near_edited == pytest.approx(jaccard(prints[text], prints[edited])) and r.near_next == pytest.approx(jaccard(prints[text], prints[after]))


@pytest.mark.parametrize("text", ["The cat sat on it", "abcdefghijklmnop", "x1y2z3a4" * 30, "東京都" * 30, "one two three four five six seven eight nine ten"])
def test_short_texts_and_texts_without_blanks_stay_near_their_edit(spark, text):
    got = {r.doc_id: r for r in winnow.compare_edits(frame(spark, [(1, text), (2, "QUITE ELSE " * 20)])).collect()}
    assert 0 < got[1].near_edited < 1 and got[1].near_next == 0


@pytest.mark.parametrize("bits", [64, 20, 150])
def test_hamming_equals_brute_force(spark, bits):
    """Codes of one long, of less than one and of three; equal codes, null ids and null codes among them."""
    rng = np.random.default_rng(2)
    signs = rng.choice([-1.0, 1.0], (300, bits))
    signs[100:200] = np.where(rng.random((100, bits)) < 0.1, -signs[:100], signs[:100])
    rows = [(i, v.tolist()) for i, v in enumerate(signs)] + [(1000 + i, signs[0].tolist()) for i in range(30)] + [(None, signs[1].tolist()), (9999, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert hamming_search.dimension(df) == bits
    codes = df.select("id", hamming_search.sign_code(F.col("embedding"), bits).alias("code"), F.lit(1).alias("rank"))
    got = hamming_search.top_k(codes, codes.where("id % 100 = 0"), 5, bits).collect()
    clean = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    want = set()
    for q, a in clean:
        if q % 100 == 0:
            near = sorted((int((a != c).sum()), i) for i, c in clean)[:5]
            want |= {(q, k + 1, i, d) for k, (d, i) in enumerate(near)}
    assert {(r.query_id, r.rank, r.id, r.distance) for r in got} == want and len(got) == len(want)
    assert hamming_search.top_k(codes.limit(0), codes, 5, bits).count() == 0
    assert hamming_search.top_k(codes, codes.limit(0), 5, bits).count() == 0


def test_sign_codes_tell_all_components_apart(spark):
    """Vectors that differ behind the 64th component have different codes; short, null and empty ones have defined codes."""
    long = [1.0] * 64 + [-1.0] * 64
    df = spark.createDataFrame([(1, [1.0] * 128), (2, long), (3, [1.0, None, -2.0]), (4, []), (5, None)], "id int, v array<double>")
    got = {r.id: r.c for r in df.select("id", hamming_search.sign_code(F.col("v"), 128).alias("c")).collect()}
    assert got == {1: [-1, -1], 2: [-1, 0], 3: [-(2**63), 0], 4: [0, 0], 5: None}


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (2, None, big), (None, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 2003, "revisit", 2), (2, 2003, "response", None), (2, 2003, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (0, 2, "response", None)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_of_one_digest_in_half_the_rows(spark, monkeypatch, tmp_path):
    """A digest in half of all rows, archives that roll, ids that are unique, and the standard's frames."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "<p>" + "copy " * 300 if i % 2 else "".join(rng.choice("abcdef ") for _ in range(i * 7))) for i in range(400)] + [(3, "http://h/3", "<p>" + "copy " * 300)] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder = f"{tmp_path}/archives"
    written = warc.write_archives(warc.with_record_plan(pages), folder, warc.train_dictionary(warc.payloads(pages)))
    assert written.agg(F.sum("n")).first()[0] == len(rows)
    files = sorted(tmp_path.glob("archives/*.warc.zst"))
    assert len(files) > 3 and all(f.read_bytes()[:4] == warc.struct.pack("<I", warc.DICTIONARY_FRAME) for f in files)
    records = warc.read_archives(spark, folder).collect()
    assert len({r.record_id for r in records}) == len(rows)
    assert sorted((r.page_id, r.payload.decode() if r.payload is not None else None) for r in records if r.type == "response") == sorted((i, h) for i, _, h in rows if i % 2 == 0 or i == 399)
    assert all(r.refers_page == 399 for r in records if r.type == "revisit")
    # what an attempt that died left behind is in no list and isn't read
    (tmp_path / "archives/part-000000-99999-000000.warc.zst").write_bytes(files[0].read_bytes())
    assert warc.read_archives(spark, folder, written).count() == len(rows) < warc.read_archives(spark, folder).count()
    got = warc.resolved_records(warc.read_archives(spark, folder, written)).collect()
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "response" if i % 2 == 0 or i == 399 else "revisit", None if i % 2 == 0 or i == 399 else 399) for i, _, h in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mixing_caps_and_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i < 300 else ("b" if i < 310 else None), 1, "", "") for i in range(330)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source in ("big", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6


def test_forward_backward_in_blocks_is_exact():
    rng = np.random.default_rng(1)
    e, off, moves = rng.random((300, 3)) + 0.01, np.array([0, 1, 1, 200, 300]), rng.normal(size=(3, 3))
    got = language_id.word_probabilities(e, off, moves)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b > a:
            want, _ = language_id.expectations(e[None, a:b], np.exp(moves - moves.max()))
            assert np.allclose(got[a:b], want[0])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lang = queries.op3_language_id(spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    toxic = queries.op8_toxicity(spark, d).where("held_out").join(labels, "doc_id")
    assert toxic.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.85


def test_no_reference_of_library_to_this_package():
    import pathlib

    root = pathlib.Path(line_dedup.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tallyloom\.llm|from \.+llm", path.read_text())
