import datetime as dt

from pyspark.sql import functions as F

from hourloom.operators import audit, maintenance as m
from small import bag, day, projects, rows, tables, users

LOG = [(1, 1, 1, 1, "2024-01-10", 3), (2, 2, 1, 2, "2024-01-11", 5), (3, 2, 2, 2, "2023-02-01", 8)]
DEADLINES = [(1, 1, "2024-01-01"), (1, 2, "2024-02-01"), (2, 1, None)]


def findings(t):
    return {f: n for f, n in rows(audit.integrity_audit(t)) if n}


def test_new_users_are_checked_and_completed(spark):
    t = tables(spark)
    batch = spark.createDataFrame(
        [
            (10, "Eva", "eva", None, None, "#4080ff"),
            (11, "Max", " ", None, None, None),
            (12, None, "x", "yes", None, None),
            (14, "Ida", "ida", "1", "0", None),
            (15, "Bad", "bad", None, "2", "red"),
        ],
        "seq long, name string, username string, admin string, relevant string, color string",
    )
    checked = m.check_new_users(batch)
    assert bag(m.rejected(checked), "seq", "reason") == [
        (11, "no login"), (12, "no name, bad admin"), (15, "bad relevant, bad color"),
    ]
    after = m.insert_users(t, m.accepted(checked)).user
    assert bag(after.filter("id > 3")) == [
        (4, "Eva", "0.251, 0.502, 1.0, 1.0", "eva", 0, 1),
        (8, "Ida", "0.5,0.5,0.5,1", "ida", 1, 0),
    ]


def test_new_projects_have_six_stage_rows_and_unique_names(spark):
    t = tables(spark, deadline=DEADLINES)
    batch = spark.createDataFrame(
        [
            (1, "Парк", "120", None, day("2024-07-01")),
            (2, "ДОМ", "10", None, None),
            (3, "парк", "11", None, None),
            (4, "Сад", None, None, None),
            (5, "Лес", "много", None, None),
            (6, "Луг", "0", "1", None),
        ],
        "seq long, name string, square string, isDone string, stage3 date",
    )
    checked = m.check_new_projects(t, batch)
    assert bag(m.rejected(checked), "seq", "reason") == [
        (2, "name taken"), (3, "name repeated"), (4, "no square"), (5, "bad square"),
    ]
    after = m.insert_projects(t, m.accepted(checked), dt.date(2024, 5, 5))
    new = bag(after.project.filter("id > 3"), "id", "name", "square", "level", "startdate", "isDone")
    assert new == [
        (4, "Парк", 120, 1, dt.date(2024, 5, 5), 0), (9, "Луг", 0, 1, dt.date(2024, 5, 5), 1),
    ]
    dates = bag(after.deadline.filter("projectId = 4"), "stageId", "finishdate")
    assert dates == [(s, day("2024-07-01") if s == 3 else None) for s in range(1, 7)]
    assert after.deadline.count() == 3 + 12


def test_partial_updates_touch_only_named_fields(spark):
    t = tables(spark)
    patch = spark.createDataFrame(
        [(1, 1, ["name"], "Ann Doe", None), (2, 2, ["color"], "ignored", "#ff0000")],
        "seq long, id long, fields array<string>, name string, color string",
    )
    after = bag(m.update_users(t, patch).user, "id", "name", "color")
    assert after == [(1, "Ann Doe", "0.9,0.3,0.5,1"), (2, "Bob", "1.0, 0.0, 0.0, 1.0"), (3, "Cy Dent", None)]
    patch = spark.createDataFrame(
        [(1, 1, ["square", "isDone"], None, 1)], "seq long, id long, fields array<string>, square int, isDone int"
    )
    assert bag(m.update_projects(t, patch).project, "id", "square", "isDone")[0] == (1, None, 1)


def test_bad_patch_rows_are_turned_away(spark):
    t = tables(spark)
    patch = spark.createDataFrame(
        [
            (1, 1, ["color"], None, "#zz", None), (2, 2, ["admin"], None, None, "yes"), (3, 3, ["name"], " ", None, None),
            (4, 1, ["name", "admin"], "Ann", "#zz", "1"), (5, 2, None, "nothing named", "#zz", "yes"),
        ],
        "seq long, id long, fields array<string>, name string, color string, admin string",
    )
    assert bag(m.rejected(m.check_user_patch(patch)), "seq", "reason") == [
        (1, "bad color"), (2, "bad admin"), (3, "no name"),
    ]
    after = bag(m.update_users(t, patch).user, "id", "name", "color", "admin")
    assert after == [(1, "Ann", "0.9,0.3,0.5,1", 1), (2, "Bob", "0.5,0.5,0.5,1", 0), (3, "Cy Dent", None, 0)]


def test_repeated_patch_rows_set_the_last_value_of_each_field(spark):
    t = tables(spark, deadline=DEADLINES)
    patch = spark.createDataFrame(
        [(3, 1, ["name"], "late", 1), (1, 1, ["name", "admin"], "early", 1), (2, 1, ["admin"], "no", 0)],
        "seq long, id long, fields array<string>, name string, admin int",
    )
    after = bag(m.update_users(t, patch).user, "id", "name", "admin")
    assert after[0] == (1, "late", 0) and len(after) == 3
    twice = spark.createDataFrame(
        [(2, 1, 1, day("2026-01-01")), (1, 1, 1, day("2025-01-01"))],
        "seq long, projectId long, stageId int, finishdate date",
    )
    assert bag(m.patch_deadlines(t, twice).deadline)[0] == (1, 1, day("2026-01-01"))
    assert m.patch_deadlines(t, twice).deadline.count() == 3


def test_projects_keep_unique_names(spark):
    t = tables(spark)
    patch = spark.createDataFrame(
        [
            (1, 1, ["name"], "X", "1"), (2, 2, ["name"], "x", "1"), (3, 3, ["name"], "дом", "1"), (4, 1, ["name"], "X", "1"),
            (5, 2, ["square"], None, "big"), (6, 3, ["name", "square"], "ПУСТОЙ", "7"), (7, 3, ["name"], None, "1"),
        ],
        "seq long, id long, fields array<string>, name string, square string",
    )
    assert bag(m.rejected(m.check_project_patch(t, patch)), "seq", "reason") == [
        (2, "name repeated"), (3, "name taken"), (5, "bad square"), (7, "no name"),
    ]
    assert bag(m.update_projects(t, patch).project, "id", "name", "square") == [
        (1, "X", 50), (2, "Офис", 80), (3, "ПУСТОЙ", 7),
    ]


def test_ids_of_deleted_rows_are_not_used_again(spark):
    t = m.delete_users(tables(spark), spark.createDataFrame([(3,)], "id long"))
    batch = spark.createDataFrame([(1, "Eva", "eva")], "seq long, name string, username string")
    assert max(bag(m.insert_users(t, batch, F.lit(4)).user, "id")) == (4,)


def test_deadline_patch(spark):
    t = tables(spark, deadline=DEADLINES)
    patch = spark.createDataFrame([(1, 1, 2, day("2025-01-01")), (2, 2, 5, day("2025-01-01"))], "seq long, projectId long, stageId int, finishdate date")
    assert bag(m.patch_deadlines(t, patch).deadline) == [(1, 1, day("2024-01-01")), (1, 2, day("2025-01-01")), (2, 1, None)]


def test_deletes_leave_no_orphans(spark):
    t = tables(spark, LOG, deadline=DEADLINES)
    ids = spark.createDataFrame([(2,)], "id long")
    after = m.delete_users(t, ids)
    assert bag(after.fact, "id") == [(1,)] and after.user.count() == 2
    assert not [f for f in findings(after) if "unknown" in f]
    after = m.delete_projects(t, ids)
    assert bag(after.fact, "id") == [(1,), (2,)] and bag(after.deadline, "projectId") == [(1,), (1,)]
    assert not [f for f in findings(after) if "unknown" in f]


def test_audit_follows_edits(spark, tmp_path):
    """After each of some batches the kept audit equals a full one."""
    import random

    from hourloom.operators import audit_state
    from hourloom.operators.edits import apply_edits
    from hourloom.schema import SLOT
    from small import edits, facts

    rng = random.Random(31)
    days = [f"202{y}-01-0{d}" for y in (3, 4) for d in (1, 2, 3)]
    slot = lambda: (rng.randint(1, 4), rng.choice([1, 2, 9]), rng.choice(days))
    log = [(i, rng.choice([1, 2, 3, 8]), *slot(), rng.randint(1, 14)) for i in range(1, 60)]
    log += [(5, 1, *slot(), 3), (6, 2, *slot(), 3), (6, 2, *slot(), 3)]  # repeated ids
    t = tables(spark, log)
    state = audit_state.start_audit(t, str(tmp_path / "start"))
    entries = t.fact
    for n in range(2):
        batch = [
            (1000 * n + k, rng.choice(["set", "delete", "delete"]), rng.choice([1, 2, 3, 8]), *slot(), rng.randint(1, 12))
            for k in range(1, 25)
        ]
        commands = edits(spark, batch)
        after = facts(spark, [(r.id, r.userId, r.projectId, r.stageId, str(r.dateStamp), r.hours) for r in apply_edits(entries, commands).entries.collect()])
        slots = commands.select(*SLOT).distinct()
        touched = lambda e: e.join(slots, SLOT, "left_semi")
        state = audit_state.audit_after(state, t, touched(entries), touched(after), str(tmp_path / f"b{n}"))
        want = audit.integrity_audit(t.with_(fact=after), ("id",))
        assert sorted(rows(state.result(spark))) == sorted(rows(want, "finding", "n"))
        entries = after


def test_audit_finds_each_fault(spark):
    log = LOG + [
        (3, 1, 1, 1, "2024-01-10", 13),  # id repeated, entry doubled, hours, long day
        (5, 2, 1, 1, "2024-01-10", 1),
        (6, 9, 8, 7, "2024-01-10", 1),  # three orphans
        (7, 3, 1, 1, "2024-01-10", 1),  # third person in the slot
    ]
    t = tables(
        spark,
        log,
        user=users(spark, [(1, "A", "1,2"), (2, "B", None), (3, "C", "0,0,0,1")]),
        project=projects(spark, [(1, "Дом", 1, 9, 0), (2, "ДОМ", 1, 1, 3)]),
        deadline=[(1, 1, None), (1, 1, "2024-01-01"), (7, 9, "2024-01-01")],
    )
    assert findings(t) == {
        "main: key repeated": 1,
        "project: name repeated": 1,
        "projectstage: key repeated": 1,
        "main: hours out of range": 1,
        "project: isDone not a flag": 1,
        "project: level out of range": 1,
        "projectstage: finishdate missing": 1,
        "user: color unreadable": 1,
        "main: user unknown": 1,
        "main: project unknown": 1,
        "main: stage unknown": 1,
        "projectstage: project unknown": 1,
        "projectstage: stage unknown": 1,
        "main: entry doubled": 1,
        "main: slot over-full": 1,
        "main: day too long": 1,
    }
    clean = tables(spark, LOG, deadline=[(1, 1, "2024-01-01")])
    assert findings(clean) == {}
    assert audit.integrity_audit(clean).filter(F.col("n").isNull()).count() == 0
