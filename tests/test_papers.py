"""Page kinds, stapled filings and repeated documents against plain versions."""

import random
import re

from tallyloom.operators import classify, duplicates

CELLS = "array<struct<text:string,x0:double,x1:double>>"


def printed(spark, pages):
    """Rows of (doc, page, list of lines)."""
    rows = [(d, p, i, [(w, 0.0, 0.0) for w in line.split(" ")]) for d, p, lines in pages for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, f"doc_id int, page int, row int, cells {CELLS}")


def kinds(spark, pages, every=None):
    all_pages = None if every is None else spark.createDataFrame(every, "doc_id int, page int")
    return {(r.doc_id, r.page): (r.kind, r.score) for r in classify.classify_pages(printed(spark, pages), all_pages).collect()}


def test_order_of_page_rules(spark):
    got = kinds(spark, [
        (1, 1, ["Form 5472 and Form 5471"]),  # the first rule wins
        (1, 2, ["x"] * 14 + ["Form 5471"]),  # below the head
        (1, 3, ["Form 5471", *["x"] * 20, "Schedule C", "of the Income Statement"]),  # over lines of the whole page
        (2, 1, ["ABN 1", "Directors' report", "Balance Sheet"]),
        (2, 2, ["Profit and loss", "Movements in equity"]),  # in a statutory document
        (2, 3, ["Terms & Conditions"]),
        (2, 4, ["nothing"]),  # goes on
        (3, 1, ["As of June 30, 2024", "Balance Sheet"]),
        (3, 2, ["As of June 30", "Balance Sheet of a kind"]),  # no export
        (4, 1, ["Balance Sheet"]),
    ], [(2, 5), (4, 1), (4, 2), *((d, p) for d in (1, 2, 3) for p in (1, 2, 3, 4))])
    assert got[1, 1] == ("us-5472", 3) and got[1, 2] == ("unknown", 0) and got[1, 3] == ("us-5471-schC", 2) and got[1, 4] == ("unknown", 0)
    assert got[2, 1] == ("fs-cover", 3) and got[2, 2] == ("fs-equity", 3) and got[2, 3] == ("tandc", 2) and got[2, 4] == got[2, 5] == ("tandc", 1)
    assert got[3, 1] == ("fs-balance-sheet", 2) and got[3, 2] == ("fs-balance-sheet", 3) and got[3, 3] == ("fs-balance-sheet", 1)
    assert got[4, 1] == got[4, 2] == ("unknown", 0)


def words(name):
    return {w for w in re.sub("[^a-z0-9 ]+", " ", (name or "").lower()).split() if w not in classify.name_tokens.__defaults__[0]}


def plain_blocks(pages, names, ids):
    """Blocks of one document by going through its pages; dicts of lists."""
    family = [p for p, k in sorted(pages.items()) if k.startswith("us-5471-")]
    blocks = []
    for p in family:
        if pages[p] == "us-5471-face" or not blocks:
            blocks.append({"pages": [], "face": p if pages[p] == "us-5471-face" else None, "start": p})
        blocks[-1]["pages"].append(p)
    for k, b in enumerate(blocks):
        b["range"] = [min(pages) if k == 0 else b["start"], blocks[k + 1]["start"] - 1 if k + 1 < len(blocks) else max(pages)]
        said = [n for p in b["pages"] for n in names.get(p, [])]
        b["name"] = max(dict.fromkeys(said), key=lambda n: (said.count(n), -said.index(n))) if said else None
        b["ids"] = list(dict.fromkeys(i for p in range(b["range"][0], b["range"][1] + 1) for i in ids.get(p, [])))

    def join(into, other, front=False):
        into["pages"] = other["pages"] + into["pages"] if front else into["pages"] + other["pages"]
        into["range"] = [min(into["range"][0], other["range"][0]), max(into["range"][1], other["range"][1])]
        both = other["ids"] + into["ids"] if front else into["ids"] + other["ids"]
        into["ids"] = list(dict.fromkeys(both))

    named = [k for k, b in enumerate(blocks) if b["name"]]
    lead = blocks[: named[0]] if named else []
    blocks = blocks[len(lead) :]
    for b in reversed(lead):
        join(blocks[0], b, front=True)
    out = []
    for b in blocks:
        alike = out and words(out[-1]["name"]) and words(b["name"]) and len(words(out[-1]["name"]) & words(b["name"])) >= 0.5 * min(len(words(out[-1]["name"])), len(words(b["name"])))
        if out and (not b["name"] or alike):
            join(out[-1], b)
        else:
            out.append(b)
    return [(i, b["pages"], *b["range"], b["face"], b["name"], b["ids"]) for i, b in enumerate(out)]


def test_blocks_equal_plain_ones(spark):
    rng = random.Random(1)
    pages, names, ids, want = [], [], [], []
    some = ["Alpha Mining Ltd", "Alpha Mining Group", "Mining Group Beta", "Beta Ltd", "Gamma", "The Co."]
    for doc in range(120):
        n = rng.randint(1, 14)
        mine = {p: rng.choice(["us-5471-face", "us-5471-face", "us-5471-schJ", "us-1120", "unknown"]) for p in range(1, n + 1)}
        named = {p: [rng.choice(some) for _ in range(rng.choice((0, 0, 1, 2)))] for p in mine}
        found = {p: [f"R{rng.randint(0, 5)}" for _ in range(rng.choice((0, 1, 2)))] for p in mine}
        pages += [(doc, p, k) for p, k in mine.items()]
        names += [(doc, p, i, x) for p, xs in named.items() for i, x in enumerate(xs)] + [(doc, 1, 9, None)]
        ids += [(doc, p, i, x) for p, xs in found.items() for i, x in enumerate(xs)]
        want += [(doc, *b) for b in plain_blocks(mine, named, found)]
    frame = lambda rows, col: spark.createDataFrame(rows, f"doc_id int, page int, ord int, {col} string")
    got = classify.segment_blocks(spark.createDataFrame(pages, "doc_id int, page int, kind string"), frame(names, "name"), frame(ids, "id")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def plain_marks(docs, values):
    sets = {}
    for e, d, v in values:
        sets.setdefault((e, d), set()).add(v)
    out = {}
    for e in {d[0] for d in docs}:
        mine = sorted((d for d in docs if d[0] == e and d[2] in duplicates.COMPARED), key=lambda d: d[5])
        for x, a in enumerate(mine):
            for b in mine[x + 1 :]:
                if a[1] in out or b[1] in out or (a[3] and b[3] and a[3] != b[3]):
                    continue
                s, t = sets.get((e, a[1]), set()), sets.get((e, b[1]), set())
                if min(len(s), len(t)) < 5:
                    continue
                both = len(s & t)
                if both / len(s | t) >= 0.8 or both / min(len(s), len(t)) >= 0.9:
                    keep, lost = (a, b) if a[4] >= b[4] else (b, a)
                    out[lost[1]] = keep[1]
    return out


def test_marks_equal_a_plain_choice(spark):
    rng = random.Random(8)
    docs, values, n = [], [], 0
    for e in range(25):
        pool = [sorted(rng.sample(range(1000), rng.choice((4, 5, 10, 20)))) for _ in range(4)]
        for k in range(rng.randint(1, 14)):
            base = set(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2))):
                base.discard(rng.choice(sorted(base)))
            base |= set(rng.sample(range(1000), rng.choice((0, 0, 1, 6))))
            n += 1
            docs.append((e, n, rng.choice([*duplicates.COMPARED, "unknown"]), rng.choice([None, None, 2023, 2024]), rng.randint(1, 4), k))
            values += [(e, n, v) for v in base] * rng.choice((1, 2))
    schema = "entity_id int, doc_id int, kind string, year int, n_pages int, ord int"
    values.append((3, docs[0][1], None))
    got = duplicates.mark_duplicates(spark.createDataFrame(docs, schema), spark.createDataFrame(values, "entity_id int, doc_id int, value int")).collect()
    want = plain_marks(docs, [v for v in values if v[2] is not None])
    assert len(want) > 25 and {r.doc_id: r.duplicate_of for r in got if r.duplicate_of is not None} == want and len(got) == len(docs)


def test_a_hot_entity_of_copies_makes_no_pairs_of_documents(spark):
    """Six hundred copies in three widths: one is kept, with the years apart."""
    docs = [(1, i, "trial-balance", 2023 if i % 2 else 2024, 1 + i % 3, i) for i in range(600)] + [(2, 1000, "trial-balance", None, 1, 0)]
    values = [(1, i, v) for i in range(600) for v in range(8)] + [(2, 1000, v) for v in range(8)]
    frame = spark.createDataFrame(docs, "entity_id int, doc_id int, kind string, year int, n_pages int, ord int")
    got = {r.doc_id: r.duplicate_of for r in duplicates.mark_duplicates(frame, spark.createDataFrame(values, "entity_id int, doc_id int, value int")).collect()}
    assert got == {d[1]: None for d in docs} | plain_marks(docs, values)
    none = duplicates.mark_duplicates(frame.limit(0), spark.createDataFrame([], "entity_id int, doc_id int, value int"))
    assert none.collect() == []


def test_entities_of_few_documents_are_settled_as_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(e, 100 * e + k, "trial-balance", rng.choice([None, 2023, 2024]), rng.choice((None, 1, 2, 3)), 10 - k) for e in range(12) for k in range(9)]
    values = [(d[0], d[1], v) for d in docs for v in range(rng.choice((0, 0, 0, 1, 3)), rng.choice((9, 10, 10, 10, 12)))]
    frame, held = spark.createDataFrame(docs, "entity_id int, doc_id int, kind string, year int, n_pages int, ord int"), spark.createDataFrame(values, "entity_id int, doc_id int, value int")
    few = {r.doc_id: r.duplicate_of for r in duplicates.mark_duplicates(frame, held).collect()}
    monkeypatch.setattr(duplicates, "FEW_DOCS", 0)
    assert {r.doc_id: r.duplicate_of for r in duplicates.mark_duplicates(frame, held).collect()} == few
    want = plain_marks([(*d[:4], d[4] or 0, d[5]) for d in docs], values)
    assert len(want) > 12 and {k: v for k, v in few.items() if v is not None} == want


def test_entities_of_few_documents_take_no_rounds(spark, monkeypatch):
    """What is written grows with documents only: values in one array a document, nothing a round."""
    written = []
    monkeypatch.setattr(duplicates, "materialize", lambda df, label: written.append(label) or df)
    frame = spark.createDataFrame([(1, i, "trial-balance", None, 1, i) for i in range(6)], "entity_id int, doc_id int, kind string, year int, n_pages int, ord int")
    values = spark.createDataFrame([(1, i, v) for i in range(6) for v in range(6)], "entity_id int, doc_id int, value int")
    assert {r.doc_id: r.duplicate_of for r in duplicates.mark_duplicates(frame, values).collect()} == {0: None} | dict.fromkeys(range(1, 6), 0)
    assert written == ["sets", "large"]
