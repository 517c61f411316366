"""The edge ledger and the reminder budget against loops; the stream against the batch after a restart."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import edge_ledger, reminders
from corpusmill.streaming import reminders as stream

SCHEMA = "seq long, edge_id string, state string, pass string, source long, target long, applied_at int"


def random_ledger(rng, n):
    rows = []
    for seq in range(1, n + 1):
        edge = f"e{rng.randrange(12)}" if rng.random() > 0.03 else None
        kind = rng.choice(["apply", "apply", "undo", "expire", "note"])
        if kind == "apply":
            rows.append((seq, edge, "active", f"p{seq // 10}", rng.randrange(5), rng.randrange(5), rng.choice([seq // 3, None, -1])))
        else:
            rows.append((seq, edge, {"undo": "undone", "expire": "expired"}.get(kind), None, None, None, None))
    return rows


def loop_states(rows, at=None):
    states = {}
    for seq, edge, *fields in rows:
        if edge is None or (at is not None and seq > at):
            continue
        known = states.setdefault(edge, [None] * 5 + [seq, seq])
        states[edge] = [new if new is not None else old for new, old in zip(fields, known)] + [known[5], seq]
    return states


def test_states_and_intervals_at_every_moment(spark):
    rows = random_ledger(random.Random(1), 160)
    df = spark.createDataFrame(rows, SCHEMA)
    spans = edge_ledger.edge_intervals(df).collect()
    for at in (1, 17, 80, 159, None):
        want = loop_states(rows, at)
        got = {r.edge_id: list(r)[1:] for r in edge_ledger.edge_states(df, at).collect()}
        assert got == want
        t = 10**6 if at is None else at
        now = {r.edge_id: r.state for r in spans if r.since <= t and (r.until is None or t < r.until)}
        assert now == {e: s[0] for e, s in want.items() if s[0] is not None}


def test_undo_and_apply_again(spark):
    rng = random.Random(2)
    rows = random_ledger(rng, 120)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"edge_ids": ["e1", "e5", "e99"]}, {"since": 60}, {"sessions": 12, "now": 40}):
        states = loop_states(rows)
        active = {e: s for e, s in states.items() if s[0] == "active"}
        if "edge_ids" in how:
            chosen = set(how["edge_ids"]) & set(active)
        elif "since" in how:
            state, applied = {}, {}
            for seq, e, s, *_ in rows:
                if e and s:
                    applied[e] = seq if state.get(e) != s else applied[e]
                    state[e] = s
            chosen = {e for e in active if applied[e] >= 60}
        elif "sessions" in how:
            chosen = {e for e, s in active.items() if s[4] is not None and 40 - s[4] < 12}
        else:
            last = max(active, key=lambda e: (active[e][5], e))
            chosen = {e for e in active if active[e][1] == active[last][1]}
        args = how | ({"edge_ids": spark.createDataFrame([(e,) for e in how["edge_ids"]], "edge_id string")} if "edge_ids" in how else {})
        undone = edge_ledger.undo_rows(frame(rows), **args)
        got = undone.orderBy("seq").collect()
        assert [r.edge_id for r in got] == sorted(chosen, key=lambda e: (active[e][5], e), reverse=True) and chosen
        assert [r.seq for r in got] == list(range(121, 121 + len(got)))
        # Undone rows are sparse: all else stays known, and an edge can come again.
        after = edge_ledger.appended(frame(rows), undone)
        again = edge_ledger.appended(after, frame([(999, got[0].edge_id, "active", "new", None, None, 50)]))
        result = {r.edge_id: r for r in edge_ledger.edge_states(again).collect()}
        assert all(result[e].state == "undone" for e in chosen - {got[0].edge_id})
        first = result[got[0].edge_id]
        assert (first.state, first["pass"], first.source) == ("active", "new", active[first.edge_id][2])
    assert edge_ledger.undo_rows(frame([])).collect() == []


def test_ageing(spark):
    rows = [(1, "a", "active", "p", 1, 2, 0), (2, "b", "active", "p", 2, 3, 15), (3, "c", "active", "p", 3, 4, None), (4, "d", "active", "p", 4, 5, -1), (5, "e", "undone", "p", 5, 6, 19)]
    states = edge_ledger.edge_states(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in edge_ledger.young_pairs(states, 20).collect()} == {(2, 3), (3, 4), (4, 5)}


def random_events(rng, n):
    names = [f"n{i}" for i in range(9)]
    kept = [(f"p{i}", place, name) for i in range(8) for place, name in enumerate(rng.sample(names, rng.randrange(0, 7)), 1)] + [("p0", 1, "n0"), (None, 1, "n1"), ("p1", 9, None)]
    events = [(f"s{min(rng.randrange(40), 20)}", i, rng.choice(["touch", "touch", "seen"]), None) for i in range(n)]
    events = [(s, i, k, rng.choice(names) if k == "seen" else f"p{rng.randrange(10)}") for s, i, k, _ in events]
    return events, list(dict.fromkeys(kept))


def loop_budget(events, kept):
    by_path = {}
    for p, place, n in kept:
        if p and n:
            by_path.setdefault(p, {}).setdefault(place, n)
    state, shown, noted = {}, set(), set()
    for s, seq, kind, path in sorted(events, key=lambda e: e[1]):
        st = state.setdefault(s, {"lines": 0, "rows": 0, "paths": set(), "shown": set(), "seen": set()})
        if kind == "seen":
            st["seen"].add(path)
            continue
        names = [by_path[path][k] for k in sorted(by_path.get(path, {}))]
        if names and st["rows"] < reminders.ROWS:
            st["rows"] += 1
            noted.add((s, seq, path, ",".join(names[: reminders.NOTED]), st["rows"]))
        if names and st["lines"] < reminders.LINES and path not in st["paths"]:
            st["paths"].add(path)
            for n in names[: reminders.KEPT]:
                if st["lines"] >= reminders.LINES:
                    break
                if n not in st["shown"]:
                    st["shown"].add(n)
                    if n not in st["seen"]:
                        st["lines"] += 1
                        shown.add((s, seq, path, n, st["lines"]))
    return shown, noted


def test_budget_as_batch_and_as_a_restarted_stream(spark, tmp_path):
    events, kept = random_events(random.Random(7), 500)
    kept = [k for k in kept if k != ("p0", 1, "n0")] or kept
    shown, noted = loop_budget(events, kept)
    assert len(shown) > 50 and max(row for *_, row in noted) == reminders.ROWS
    schema = "session string, seq long, kind string, path string"
    e, k = spark.createDataFrame(events, schema), spark.createDataFrame(kept, "path string, place int, name string")
    seen = e.where("kind = 'seen'").select("session", "seq", F.col("path").alias("name"))
    touches = e.where("kind = 'touch'")
    assert {tuple(r) for r in reminders.reminder_lines(touches, k, seen).collect()} == shown
    assert {tuple(r) for r in reminders.noted_touches(touches, k).collect()} == noted

    # Three runs over one checkpoint: the second sees rows of the first again, the third nothing new.
    place, before = tmp_path / "in", spark.conf.get(stream.STORE, None)
    parts = [events[:50], events[20:60] + events[50:400] + events[50:55], [], events[380:]]
    for part in parts:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(place))
        source = spark.readStream.schema(schema).parquet(str(place))
        stream.run(stream.reminders(source, k), str(tmp_path / "state"), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.session, r.seq, r.path, n, r.line + i) for r in out for i, n in enumerate(r.shown)} == shown
    assert {(r.session, r.seq, r.path, r.names, r.row) for r in out if r.names is not None} == noted
    assert len(out) == len({(r.session, r.seq) for r in out}) and spark.conf.get(stream.STORE, None) == before
