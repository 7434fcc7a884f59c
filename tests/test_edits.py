"""Replayed edits against a plain replay, one edit after another."""

import random

from tallyloom.operators import edits

VALID = ["income:1", "income:2", "balance:1", "balance:2"]


def plain_remap(given, lines, log):
    """given: (target, label, field, value); lines: {target: {field: figure}}; one entity, in order."""
    rows, lines, told = [list(r) for r in given], {t: dict(v) for t, v in lines.items()}, []
    for seq, label, source, to in log:
        mine = [r for r in rows if r[0] == source]
        moved = [r for r in mine if r[1] == label]
        total = {f: sum(r[3] for r in mine if r[2] == f) for f in edits.FIELDS}
        if (to is not None and to not in VALID) or to == source:
            told.append((seq, "no such line"))
        elif any(abs(lines.get(source, {}).get(f, 0) - total[f]) > 0.01 for f in edits.FIELDS):
            told.append((seq, "edited by hand"))
        elif not moved:
            told.append((seq, "nothing to move"))
        else:
            told.append((seq, "unassigned" if to is None else "moved"))
            rows = [r for r in rows if r not in moved or r[0] != source]
            lines[source] = {f: sum(r[3] for r in rows if r[0] == source and r[2] == f) for f in edits.FIELDS if any(r[0] == source and r[2] == f for r in rows)}
            for r in moved if to else []:
                if to.startswith("income") and r[2] == "boy":
                    continue
                field = "amount" if to.startswith("income") else "eoy" if r[2] == "amount" else r[2]
                rows.append([to, r[1], field, r[3]])
                lines.setdefault(to, {})[field] = lines.get(to, {}).get(field, 0) + r[3]
    return sorted(map(tuple, rows)), {(t, f): v for t, m in lines.items() for f, v in m.items() if v}, told


def test_moves_equal_a_plain_replay(spark):
    rng = random.Random(12)
    given, lines, log, want_rows, want_lines, want_log = [], [], [], [], {}, []
    for e in range(80):
        own = []
        for _ in range(rng.randint(1, 9)):
            t = rng.choice(VALID)
            own.append((t, rng.choice("abc"), "amount" if t.startswith("income") else rng.choice(["boy", "eoy"]), float(rng.randint(1, 99))))
        figures = {t: {f: sum(r[3] for r in own if r[0] == t and r[2] == f) for f in edits.FIELDS if any(r[0] == t and r[2] == f for r in own)} for t in {r[0] for r in own}}
        if rng.random() < 0.3:
            figures.setdefault(rng.choice(VALID), {})["eoy"] = 1234.0
        moves = [(k, rng.choice("abc"), rng.choice(VALID), rng.choice([*VALID, *VALID, None, "income:9"])) for k in range(rng.randint(0, 12))]
        rows, after, told = plain_remap(own, figures, moves)
        given += [(e, *r) for r in own]
        lines += [(e, t, *(m.get(f) for f in edits.FIELDS)) for t, m in figures.items()]
        log += [(e, *m) for m in moves]
        want_rows += [(e, *r) for r in rows]
        want_lines |= {(e, *k): v for k, v in after.items()}
        want_log += [(e, *x) for x in told]
    out = edits.remap_contributions(
        spark.createDataFrame(given, "entity_id int, target string, label string, field string, value double"), spark.createDataFrame(lines, "entity_id int, target string, amount double, boy double, eoy double"),
        spark.createDataFrame(log, "entity_id int, seq int, label string, from_target string, to_target string"), spark.createDataFrame([(t,) for t in VALID], "target string"),
    )
    assert sorted(map(tuple, out.contributions.collect())) == sorted(want_rows)
    assert {(r.entity_id, r.target, f): r[f] for r in out.lines.collect() for f in edits.FIELDS if r[f]} == want_lines
    told = [(r.entity_id, r.seq, r.status) for r in out.log.collect()]
    assert sorted(told) == sorted(want_log) and {"moved", "unassigned", "no such line", "edited by hand", "nothing to move"} == {x[2] for x in told}
    off = {(e, s) for e, s, x in want_log if x == "unassigned"}
    assert {(r.entity_id, r.seq) for r in out.unassigned.collect()} == off
    last = {(e, m[1]): m[3] for e, s, x in want_log if x in ("moved", "unassigned") for m in [next(m[1:] for m in log if m[0] == e and m[1] == s)]}
    assert {(r.entity_id, r.label): r.target for r in out.overrides.collect()} == last


def plain_sign_offs(items, writes, cells, log):
    state = {i: dict(stored=s, dismissed=False, note="", resolution=None, edited=None, prior=None) for i, _, s in items}
    target, writes, cells = {i: t for i, t, _ in items}, {i: list(v) for i, v in writes.items()}, dict(cells)
    for i, action, value, note in log:
        s = state[i]
        if action == "edit":
            number = value.replace(",", "")
            value = number if number.lstrip("-").isdigit() else value
            prior = None
            if i in writes:
                prior, writes[i] = writes[i][0], [value] * len(writes[i])
            elif "!" in target[i] and target[i].split("!")[0] in ("income", "balance") and value.lstrip("-").isdigit():
                prior, cells[target[i]] = cells.get(target[i]), value
            s.update(stored=True, dismissed=True, note=note or "", resolution="edited", edited=value, prior=prior)
        elif action == "dismiss":
            s.update(stored=True, dismissed=True, note=note or "")
        elif s["stored"]:
            if s["resolution"] == "edited" and s["prior"] is not None and i in writes:
                writes[i] = [s["prior"]] * len(writes[i])
            s.update(dismissed=False, note="", resolution=None, edited=None, prior=None)
    return state, writes, cells


def test_sign_offs_equal_a_plain_replay(spark):
    rng = random.Random(5)
    items, writes, lines, log, want = [], [], [], [], {}
    want_writes, want_cells = [], {}
    for e in range(60):
        own = [(f"i{k}", rng.choice(["income!F1", "balance!D2", "balance!F2", "nowhere"]), rng.random() < 0.5) for k in range(4)]
        linked = {"i0": ["a", "b"], **({"i1": ["c"]} if e % 2 else {})}
        told = [(rng.choice(own)[0], rng.choice(["edit", "edit", "dismiss", "restore"]), rng.choice(["5", "1,000", "-7", "text"]), rng.choice([None, "n"])) for _ in range(rng.randint(0, 14))]
        state, after, cells = plain_sign_offs(own, linked, {"income!F1": "9"}, told)
        items += [(e, *x) for x in own]
        writes += [(e, i, k, v) for i, vs in linked.items() for k, v in enumerate(vs)]
        lines.append((e, "income:1", 9.0, None, None))
        log += [(e, i, k, *x) for k, (i, *x) in enumerate(told)]
        want |= {(e, i): tuple(s.values()) for i, s in state.items()}
        want_writes += [(e, i, k, v) for i, vs in after.items() for k, v in enumerate(vs)]
        want_cells |= {(e, c): float(v) for c, v in cells.items() if any(x[0] in state and dict((a, b) for a, b, _ in own)[x[0]] == c and x[0] not in linked and x[1] == "edit" and x[2] != "text" for x in told)}
    out = edits.resolve_review_edits(
        spark.createDataFrame(items, "entity_id int, id string, target string, stored boolean"), spark.createDataFrame(writes, "entity_id int, review_id string, ord int, value string"),
        spark.createDataFrame(lines, "entity_id int, target string, amount double, boy double, eoy double"), spark.createDataFrame(log, "entity_id int, id string, seq int, action string, value string, note string"),
    )
    assert {(r.entity_id, r.id): (r.stored, r.dismissed, r.note, r.resolution, r.edited_value, r.prior_value) for r in out.items.collect()} == want
    assert sorted((r.entity_id, r.review_id, r.ord, r.value) for r in out.writes.collect()) == sorted(want_writes)
    cell = lambda r: {"amount": "income!F", "boy": "balance!D", "eoy": "balance!F"}[r.field] + r.target.split(":")[1]
    assert {(r.entity_id, cell(r)): r.value for r in out.cells.collect()} == want_cells


def test_lines_edited_by_hand_are_found_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(edits, "materialize", lambda df, label: written.append(label) or df)
    given = spark.createDataFrame([(1, "income:11", "a", "amount", 5.0)], "entity_id int, target string, label string, field string, value double")
    lines = spark.createDataFrame([(1, "income:11", 7.0, None, None)], "entity_id int, target string, amount double, boy double, eoy double")
    moves = spark.createDataFrame([(1, 1, "a", "income:11", "income:12")], "entity_id int, seq int, label string, from_target string, to_target string")
    made = edits.remap_contributions(given, lines, moves, spark.createDataFrame([("income:12",)], "target string"))
    assert [r.status for r in made.log.collect()] == ["edited by hand"] and written == ["by-hand"]
