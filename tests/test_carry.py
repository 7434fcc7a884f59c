"""Earlier filings, siblings and particulars against plain versions."""

import random
import re

from tallyloom.operators import carry, profile
from tallyloom.operators.cases import NAME_STOP


def words(name):
    return {w for w in re.sub("[^a-z0-9 ]+", " ", (name or "").lower()).split() if w not in NAME_STOP}


def like(a, b):
    x, y = words(a), words(b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def plain_kept(candidates):
    kept = []
    for c in candidates:
        at = next((i for i, k in enumerate(kept) if set(k[2]) & set(c[2]) or (k[1] and c[1] and like(k[1], c[1]) >= 0.5)), None)
        if at is None:
            kept.append(c)
        elif c[3] > kept[at][3]:
            kept[at] = c
    return kept


def plain_choice(kept, known):
    if not known:
        return kept[0] if kept else None
    best, most = None, 0
    for c in kept:
        if c[1] and like(known, c[1]) >= 0.5 and like(known, c[1]) > most:
            best, most = c, like(known, c[1])
    return best or next((c for c in kept if not c[1]), None)


def test_filings_equal_a_plain_choice(spark):
    rng = random.Random(4)
    names = ["Alpha Mining Ltd", "Alpha Mining Group East", "Mining East", "Beta Co", None, "", "The Ltd", "Beta Gamma Delta", "Delta Trading"]
    rows, entities, want = [], [], {}
    for e in range(120):
        own = [(k, rng.choice(names), [f"R{rng.randint(0, 6)}" for _ in range(rng.choice((0, 0, 1, 2)))], rng.randint(1, 4), rng.choice([None, 2020, 2022, 2023])) for k in range(rng.randint(1, 9))]
        known, cy = rng.choice([None, "", "Alpha Mining", "Beta", "Unheard Of"]), rng.choice([None, 2024])
        rows += [(e, *c) for c in own]
        entities.append((e, known, cy))
        kept = plain_kept(own)
        chosen = plain_choice(kept, known)
        want[e] = ([c[0] for c in kept], chosen and chosen[0], sorted(c[0] for c in kept if c is not chosen and c[1]), bool(chosen and cy and chosen[4] and chosen[4] < cy - 1))
    frame = spark.createDataFrame(rows, "entity_id int, ord int, name string, ref_ids array<string>, pages int, year int")
    kept = carry.dedupe_carry_forward(frame).cache()
    got = {e: [r.ord for r in sorted((r for r in kept.collect() if r.entity_id == e and r.place is not None), key=lambda r: r.place)] for e in want}
    assert got == {e: w[0] for e, w in want.items()} and kept.count() == len(rows)
    s = carry.select_carry_forward(kept, spark.createDataFrame(entities, "entity_id int, known_name string, cy int"))
    assert {r.entity_id: r.ord for r in s.chosen.collect()} == {e: w[1] for e, w in want.items() if w[1] is not None}
    siblings = s.siblings.collect()
    assert all(sorted(r.ord for r in siblings if r.entity_id == e) == w[2] for e, w in want.items())
    review = s.review.collect()
    assert {r.entity_id for r in review if r.kind == "older year"} == {e for e, w in want.items() if w[3]}
    assert {r.entity_id for r in review if r.kind == "other entity"} == {e for e, w in want.items() if w[1] is None}
    kept.unpersist()


def test_siblings_that_exist_are_left_out(spark):
    siblings = spark.createDataFrame([(1, 9, 0, "Alpha Mining Ltd", []), (1, 9, 1, "Beta", ["R1"]), (1, 9, 2, "Gamma Delta Two", []), (2, 8, 0, "Alpha", []), (1, 9, 3, "The Ltd", [])], "owner_id int, entity_id int, ord int, name string, ref_ids array<string>")
    existing = spark.createDataFrame([(1, "ALPHA (East)", ""), (1, "Else", "R1"), (1, "Delta", None), (2, "Beta", "R1"), (1, None, "")], "owner_id int, name string, ref_id string")
    assert sorted((r.owner_id, r.ord) for r in carry.sibling_entities(siblings, existing).collect()) == [(1, 3), (2, 0)]


def test_particulars_are_filled_once_in_order(spark):
    given = spark.createDataFrame([(1, "profile", "legalName", "Typed"), (1, "profile", "currency", ""), (1, "profile", "note", ""), (2, "ownership", "cfc", None)], "entity_id int, bucket string, key string, value string")
    entities = spark.createDataFrame([(1, 2024, 2023), (2, None, None), (3, 2024, 2023)], "entity_id int, cy int, py int")
    columns = "entity_id int, source string, period_end string, name string, addr1 string, addr2 string, addr3 string, formed string, country string, activity string, currency string, ref_id string, place string, activity_code string, pct_voting double"
    face = lambda e, end, **k: tuple({"entity_id": e, "source": f"return {e}", "period_end": end, **k}.get(c.split()[0]) for c in columns.split(", "))
    faces = spark.createDataFrame([face(1, "6/30/2023", name="Face", country="NZ", pct_voting=50.0), face(2, "12/31/2020", pct_voting=9.5), face(3, "6/30/2020", currency="AUD")], columns)
    found = spark.createDataFrame([(1, "profile", "countryInc", "AU", "doc b", 2), (1, "profile", "phone", "2", "doc b", 2), (1, "profile", "phone", "1", "doc a", 1), (1, "profile", "phone", "", "doc 0", 0)], "entity_id int, bucket string, key string, value string, source string, ord int")
    sniffed = spark.createDataFrame([(1, "EUR", "seen", 5), (1, "USD", "seen", 3), (3, "EUR", "seen", 1)], "entity_id int, value string, source string, ord int")
    out = profile.propose_profile(given, entities, faces, found, sniffed)
    got = {(r.entity_id, r.key): r.value for r in out.profile.collect()}
    assert got == {
        (1, "legalName"): "Typed", (1, "currency"): "USD", (1, "note"): "", (1, "cyEnd"): "06/30/24", (1, "pyEnd"): "06/30/23", (1, "countryInc"): "NZ", (1, "phone"): "1", (1, "ownStart"): "50", (1, "ownEnd"): "50", (1, "cfc"): "Yes", (1, "tenPct"): "Yes", (1, "daysCfc"): "366", (1, "daysOwned"): "366",
        (2, "cfc"): "Yes", (2, "cyEnd"): "12/31/21", (2, "pyEnd"): "12/31/20", (2, "ownStart"): "9.5", (2, "ownEnd"): "9.5",
        (3, "cyEnd"): "12/31/24", (3, "pyEnd"): "12/31/23", (3, "currency"): "AUD", (3, "cfc"): "Yes", (3, "tenPct"): "Yes", (3, "daysCfc"): "366", (3, "daysOwned"): "366",
    }
    source = {(r.entity_id, r.key): r.source for r in out.provenance.collect()}
    assert source[1, "cyEnd"] == "return 1 · annual accounting period" and source[3, "cyEnd"] == "statement year" and source[1, "tenPct"] == "return 1 · 50% voting per prior filing" and (1, "legalName") not in source
    assert {(r.entity_id, r.key, r.value) for r in out.disagreements.collect()} == {(1, "cyEnd", "12/31/24"), (1, "pyEnd", "12/31/23"), (1, "countryInc", "AU"), (1, "phone", "2"), (1, "currency", "EUR"), (3, "currency", "EUR")}
