"""Packing, filter audit and periodic runs: plain versions, edge cases, empty tables."""

import random
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import filter_audit, packing, periodic_runs, queries

SCHEMA = "doc_id bigint, text string, source string, start string, ids string, runs string, collapsed string, n bigint, part string"
LONG = "word " * 30_000
EDGE = [(1, None, None), (2, "", ""), (3, " \n\n ", "s"), (4, "a b", "s"), (4, "a b", "s"), (None, "a b", "t"), (None, None, None), (5, LONG, "s"), (6, "é🙂 漢字 don't " * 50, "t")]


def frame(spark, rows):
    """Rows of id, text and source beside columns of the operators' own names."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", 1, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "DELTA", "e", "漢字", "x$y", "\n"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 30, 300, 900, 3000)))) for _ in range(n)]


def check_pieces(rows, want):
    """Each token of ``want`` (id: ids) lies in one piece; sequences are gapless, full or a power of two long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert ids == np.array(want[i], "<u4").tobytes() and all(r.doc_tokens == len(want[i]) and r.length * 4 == len(r.ids) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        total = sum(r.length for r in pieces)
        assert total <= packing.WINDOW_TOKENS and total & (total - 1) == 0 and {r.sequence_tokens for r in pieces} == {total}
    return by_seq


def test_packing_holds_every_token_once(spark, vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    rows = list(enumerate([*texts(60), LONG, None, ""]))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for parts in (1, 5):
        docs = frame(spark, [(i, t, "s") for i, t in rows]).repartition(parts)
        by_seq = check_pieces(packing.pack(docs, vocabulary).collect(), want)
        short = sum(len(p) > 0 and sum(r.length for r in p) < packing.WINDOW_TOKENS for p in by_seq.values())
        assert short <= 11 * parts and len(by_seq) >= sum(map(len, want.values())) / packing.WINDOW_TOKENS


def test_packing_edges(spark, vocabulary):
    docs = frame(spark, EDGE).coalesce(1)
    rows = packing.pack(docs, vocabulary).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows if r.doc_id in (1, 2, None)}, key=str) == [(1, 1), (2, 1), (None, 1), (None, 3)]
    assert sum(r.length for r in rows if r.doc_id == 4) == 6 and sum(r.length for r in rows if r.doc_id is None) == 4
    assert {tuple(sorted(x)) for x in [[r.offset for r in rows if r.sequence_id == s] for s in {r.sequence_id for r in rows}] if x[0]} == set()
    assert packing.pack(docs.limit(0), vocabulary).collect() == []
    again = packing.pack(docs, vocabulary).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def plain_levels(sizes, size):
    """Sum of squares by trying every fill: the fills chosen, and the counts left."""
    count, chosen = [0] * (size + 1), []
    for n in sizes:
        best = None
        for h in [*range(size - n, 0, -1), 0]:
            if h and not count[h]:
                continue
            after = list(count)
            if h:
                after[h] -= 1
            after[h + n] += 1
            cost = sum(x * x for x in after[1:size])
            if best is None or cost < best[0]:
                best = cost, h, after
        chosen.append(best[1])
        count = best[2]
        count[size] = 0
    return chosen, count


def test_levels_are_those_of_least_squares():
    rng = random.Random(5)
    for size in (7, 16, 60):
        sizes = [rng.randint(1, size - 1) for _ in range(400)]
        packer, chosen = packing.Packer(size, 10**6), []
        for k, n in enumerate(sizes):
            chosen.append(packer.level(n))
            packer.add(packing.Piece(k, 0, np.zeros(n, np.uint32), n))
        want, count = plain_levels(sizes, size)
        assert chosen == want and packer.count.tolist() == count


def test_open_windows_are_bounded():
    packer = packing.Packer(64, 20)
    for k in range(500):  # no two fit together
        packer.add(packing.Piece(k, 0, np.full(40, k, np.uint32), 40))
        assert packer.count.sum() <= 20
    packer.finish()
    assert sum(packing.filled(w) for w in packer.closed) == 500 * 40
    assert sum(packing.filled(w) != 64 for w in packer.closed) <= 6


def plain_fails(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        other = any((u or "") == t and None not in (i, j) and j < i for j, u, _ in rows)
        caps = sum("A" <= c <= "Z" for c in t)
        out.append([len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * caps > 5 * len(t), any(c in "#$%&*|" for c in t), other])
    return out


def plain_audit(rows, good, toxic):
    fails, out = plain_fails(rows), {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(f, i in good, i in toxic) for f, (i, _, s) in zip(fails, rows, strict=True) if (s or "") == part]
        totals = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                c = "ABCDE".index(x)
                gone = [m for m in left if m[0][c]]
                left = [m for m in left if not m[0][c]]
                totals[x] += len(gone)
                found["".join(order), k + 1] = (x, len(left), len(gone), sum(m[0][c] for m in mine) - len(gone), sum(m[0][c] and sum(m[0]) == 1 for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone))
        out |= {(part, *key): (*v[1:], totals[v[0]]) for key, v in found.items()}
    return out


def test_audit_equals_a_plain_one(spark):
    rng = random.Random(9)
    body = lambda: " ".join(rng.choice(["one", "Two", "THREE", "a$b", f"w{rng.randint(0, 99)}"]) for _ in range(rng.choice((0, 20, 60, 90))))
    pool = [body() for _ in range(40)]
    rows = [*EDGE, *((100 + k, rng.choice(pool), rng.choice(["s", "t", None])) for k in range(150))]
    good, toxic = {5, 102, 110, 130}, {4, 103, 110}
    labels = spark.createDataFrame([(i, int(i in good), int(i in toxic)) for i in good | toxic | {6}] + [(6, None, None), (5, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows).repartition(3), labels).collect()
    want = plain_audit(rows, good, toxic)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(frame(spark, rows).limit(0), labels).collect() == []
    none = filter_audit.audit(frame(spark, rows), labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none) == (0, 0, len(want))


def test_shapley_by_least_squares_is_the_mean_over_orders():
    rng = random.Random(2)
    for n in (2, 3, 5):
        by_mask = [rng.randint(0, 50) for _ in range(1 << n)]
        removed = filter_audit.coalitions(by_mask)
        assert removed == [sum(c for m, c in enumerate(by_mask) if m & s) for s in range(1 << n)]
        orders = list(permutations(range(n)))
        for i, share in enumerate(filter_audit.shapley(removed)):
            gains = [removed[b | 1 << i] - removed[b] for o in orders for b in [sum(1 << j for j in o[: o.index(i)])]]
            assert share == Fraction(sum(gains), len(orders))


def plain_runs(w, least=12):
    n, found = len(w), {}
    for d in range(1, n // 2 + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and w[j] == w[j + d]:
                j += 1
            if j - i >= d and j - i + d >= least:
                found.setdefault((i, j - i + d), d)
            i = max(j, i) + 1
    return sorted((s, length, d) for (s, length), d in found.items())


def plain_collapsed(w, found):
    drop = {i for s, length, d in found for i in range(s + d, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [*((i, t) for i, t, _ in EDGE if t != LONG), (50, "z " * 700)]
    for k in range(160):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        w = [rng.choice(letters) for _ in range(rng.randint(0, 120))]
        if k % 2 and w:
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else "q" for i in range(len(w))]
        rows.append((100 + k, rng.choice([" ", "\n", "\t "]).join(w)))
    for least in (2, 12):
        got = periodic_runs.find_runs(frame(spark, [(i, t, "s") for i, t in rows]).repartition(2), keep=["doc_id", "text", "part"], least=least).collect()
        assert len(got) == len(rows)
        for r in got:
            w = (r.text or "").split()
            want = plain_runs(w, least)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == plain_collapsed(w, want) and r.part == "x"


def test_runs_of_a_long_text(spark):
    got = periodic_runs.find_runs(frame(spark, [(5, LONG, "s"), (6, "a b c " * 9000 + "d", "s")]), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(x) for x in got[0].runs] == [(0, 30_000, 1)] and got[0].collapsed == "word"
    assert [tuple(x) for x in got[1].runs] == [(0, 27_000, 3)] and got[1].collapsed == "a b c d"
    assert periodic_runs.find_runs(frame(spark, EDGE).limit(0)).collect() == []


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    from tallyloom.llm import textbytes as T

    monkeypatch.setattr(T, "run_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    ids = periodic_runs.word_ids(raw, np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14]))
    assert ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids.tolist())) == 3


def test_repeating_words_of_the_query(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 37))) for k in range(200)] + [(7000, None)]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    for r in docs.select("doc_id", F.col("text").alias("old"), queries.repeating(F.col("text"), F.col("doc_id")).alias("new")).collect():
        h, w = zlib.crc32(str(r.doc_id).encode()), (r.old or "").split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert (r.new or "").split() == w
