import random

import pytest

from hourloom.operators.edits import apply_edits, read_commands, upsert_entries
from hourloom.operators.slot_rules import DAY_FULL, DELETED, NOTHING, SAVED
from small import bag, edits, facts, rows

DAY = "2024-01-05"


def state(outcome):
    return bag(outcome.entries, "projectId", "stageId", "dateStamp", "userId", "hours")


def fate(outcome):
    return dict(rows(outcome.statuses, "seq", "status"))


def brute(entries, commands):
    """One request at a time over a plain list of rows."""
    log = [list(e) for e in sorted(entries)]
    statuses = {}
    for seq, op, u, p, s, d, h in sorted(commands):
        here = [e for e in log if (e[2], e[3], e[4]) == (p, s, d)]
        own = [e for e in here if e[1] == u]
        if op == "delete":
            if own and h <= own[0][5]:
                log.remove(own[0])
                statuses[seq] = DELETED
            else:
                statuses[seq] = NOTHING
        elif len({e[1] for e in here if e[1] != u}) >= 2:
            statuses[seq] = DAY_FULL
        else:
            statuses[seq] = SAVED
            if own:
                own[0][5] = h
            else:
                log.append([1_000_000 + seq, u, p, s, d, h])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(((e[2], e[3], e[4], e[1], e[5]) for e in log), key=key), statuses


def as_text(found):
    return [(p, s, str(d), u, h) for p, s, d, u, h in found]


def scenario(seed, n=250, deletes=True, people=4, duplicates=True):
    rng = random.Random(seed)
    slot = lambda: (rng.randint(1, 3), rng.randint(1, 2), f"2024-01-0{rng.randint(1, 4)}")
    entries = []
    taken = set()
    for i in range(1, 26):
        p, s, d = slot()
        u = rng.randint(1, people)
        if not duplicates and (u, p, s, d) in taken:
            continue
        taken.add((u, p, s, d))
        entries.append((i, u, p, s, d, rng.randint(1, 12)))
    commands = []
    for seq in range(1, n + 1):
        p, s, d = slot()
        op = "delete" if deletes and rng.random() < 0.4 else "set"
        commands.append((seq, op, rng.randint(1, people), p, s, d, rng.randint(1, 12)))
    return entries, commands


@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_equal_one_request_at_a_time(spark, seed):
    entries, commands = scenario(seed, n=60, deletes=False)
    expected, statuses = brute(entries, commands)
    outcome = upsert_entries(facts(spark, entries), edits(spark, commands))
    assert as_text(state(outcome)) == expected
    assert fate(outcome) == statuses


@pytest.mark.parametrize("seed, people", [(3, 2), (4, 3), (5, 6)])
def test_mixed_edits_equal_one_request_at_a_time(spark, seed, people):
    entries, commands = scenario(seed, people=people)
    expected, statuses = brute(entries, commands)
    outcome = apply_edits(facts(spark, entries), edits(spark, commands))
    assert as_text(state(outcome)) == expected
    assert fate(outcome) == statuses
    ids = [r[0] for r in rows(outcome.entries, "id")]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize("seed, people, deletes", [(12, 3, 0.4), (13, 8, 0.05), (14, 50, 0.5), (15, 2, 0.9)])
def test_one_hot_slot_over_many_ranges(spark, seed, people, deletes):
    """All edits on one slot, cut into stretches that are put together."""
    rng = random.Random(seed)
    entries = [(i, i % 3, 1, 1, DAY, 6) for i in range(1, rng.choice([3, 5]))]
    commands = [
        (n, "delete" if rng.random() < deletes else "set", rng.randint(1, people), 1, 1, DAY, rng.randint(1, 12))
        for n in range(1, 900)
    ]
    expected, statuses = brute(entries, commands)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        outcome = apply_edits(facts(spark, entries), edits(spark, commands))
        found, told = as_text(state(outcome)), fate(outcome)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == expected
    assert told == statuses


@pytest.mark.parametrize("seed, people", [(6, 4), (7, 40)])
def test_crowded_slots_equal_one_request_at_a_time(spark, seed, people):
    entries, commands = scenario(seed, n=400, people=people)
    expected, statuses = brute(entries, commands)
    outcome = apply_edits(facts(spark, entries), edits(spark, commands))
    assert as_text(state(outcome)) == expected
    assert fate(outcome) == statuses


def test_full_slot_refuses_a_third_person(spark):
    commands = [(1, "set", 1, 1, 1, DAY, 4), (2, "set", 2, 1, 1, DAY, 5), (3, "set", 3, 1, 1, DAY, 6), (4, "set", 1, 1, 1, DAY, 7)]
    for apply in (upsert_entries, apply_edits):
        outcome = apply(facts(spark, []), edits(spark, commands))
        assert fate(outcome) == {1: SAVED, 2: SAVED, 3: DAY_FULL, 4: SAVED}
        assert [r[-2:] for r in state(outcome)] == [(1, 7), (2, 5)]


def test_delete_needs_an_hour_within_the_entry(spark):
    base = facts(spark, [(7, 1, 1, 1, DAY, 4)])
    assert fate(apply_edits(base, edits(spark, [(1, "delete", 1, 1, 1, DAY, 6)]))) == {1: NOTHING}
    outcome = apply_edits(base, edits(spark, [(1, "delete", 1, 1, 1, DAY, 3)]))
    assert fate(outcome) == {1: DELETED} and state(outcome) == []


def test_over_full_slot_takes_deletes_and_then_sets(spark):
    base = facts(spark, [(i, i, 1, 1, DAY, 4) for i in (1, 2, 3)])
    commands = [(1, "set", 1, 1, 1, DAY, 9), (2, "delete", 1, 1, 1, DAY, 1), (3, "set", 2, 1, 1, DAY, 6), (4, "set", 1, 1, 1, DAY, 2)]
    outcome = apply_edits(base, edits(spark, commands))
    assert fate(outcome) == {1: DAY_FULL, 2: DELETED, 3: SAVED, 4: DAY_FULL}
    assert [r[-1] for r in state(outcome)] == [6, 4]
    sets = edits(spark, [(1, "set", 1, 1, 1, DAY, 9)])
    assert fate(upsert_entries(base, sets)) == {1: DAY_FULL}


def test_edit_hits_the_lowest_id_of_doubled_entries(spark):
    base = facts(spark, [(5, 1, 1, 1, DAY, 4), (6, 1, 1, 1, DAY, 4), (9, 1, 1, 1, "2025-01-01", 2)])
    for apply in (upsert_entries, apply_edits):
        outcome = apply(base, edits(spark, [(1, "set", 1, 1, 1, DAY, 9)]))
        assert bag(outcome.entries, "id", "hours") == [(5, 9), (6, 4), (9, 2)]


def test_new_ids_follow_arrival(spark):
    base = facts(spark, [(40, 9, 9, 1, DAY, 1)])
    commands = edits(spark, [(11, "set", 1, 1, 1, DAY, 4), (12, "set", 2, 2, 1, DAY, 5)])
    for apply in (upsert_entries, apply_edits):
        assert bag(apply(base, commands).entries, "id", "userId") == [(40, 9), (41, 1), (42, 2)]


def test_no_edits(spark):
    base = facts(spark, [(1, 1, 1, 1, DAY, 4)])
    for apply in (upsert_entries, apply_edits):
        outcome = apply(base, edits(spark, []))
        assert bag(outcome.entries, "id", "hours") == [(1, 4)] and fate(outcome) == {}


def test_no_slot_grows_beyond_two_people(spark):
    entries, commands = scenario(8, people=7, duplicates=False)
    before = {}
    for _, u, p, s, d, _ in entries:
        before.setdefault((p, s, d), set()).add(u)
    after = {}
    for p, s, d, u, _ in as_text(state(apply_edits(facts(spark, entries), edits(spark, commands)))):
        after.setdefault((p, s, d), set()).add(u)
    assert all(len(v) <= max(2, len(before.get(k, ()))) for k, v in after.items())


def test_clicks_by_date_parts(spark):
    raw = spark.createDataFrame(
        [
            (1, "set", 1, 1, 1, 2024, 2, 29, 4),
            (2, "set", 1, 1, 1, 2023, 2, 29, 4),
            (3, "move", 1, 1, 1, 2024, 1, 1, 13),
        ],
        "seq long, op string, userId long, projectId long, stageId int, year int, month int, day int, hour int",
    ).selectExpr("*", "timestamp'2024-01-01' AS ts")
    good, bad = read_commands(raw)
    assert [(r[0], str(r[1])) for r in rows(good, "seq", "dateStamp")] == [(1, "2024-02-29")]
    assert bag(bad, "seq", "reason") == [(2, "no such day"), (3, "unknown op, bad hour")]
