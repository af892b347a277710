import random

import pytest

from hourloom import catalogue
from hourloom.operators.edits import apply_edits
from hourloom.sources import snapshots, views
from hourloom.streaming import edit_stream
from small import bag, edits, facts, rows
from test_edits import as_text, brute, scenario

ENTRY = ["projectId", "stageId", "dateStamp", "userId", "hours"]


def saved(spark, tmp_path, entries):
    snapshots.save_entries(facts(spark, entries), str(tmp_path / "before"))
    return snapshots.year_folders(spark, str(tmp_path / "before"))


def run(spark, tmp_path, batches, start=snapshots.YearFolders({})):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([], edit_stream.EDIT).write.parquet(source)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        edit_stream.run_available(edit_stream.read_edits(spark, source), log, str(tmp_path / "ck"), start)
    found = bag(edit_stream.current_entries(spark, log), *ENTRY)
    return found, dict(rows(edit_stream.edit_statuses(spark, log), "seq", "status"))


def test_stream_equals_batch_fold(spark, tmp_path):
    entries, commands = scenario(11, n=80, people=5)
    found, statuses = run(spark, tmp_path, [edits(spark, commands)], saved(spark, tmp_path, entries))
    expected, told = brute(entries, commands)
    assert as_text(found) == expected
    assert statuses == told
    fold = apply_edits(facts(spark, entries), edits(spark, commands))
    assert found == bag(fold.entries, *ENTRY)


def test_state_lasts_over_batches_and_late_edits_apply_on_arrival(spark, tmp_path):
    day = "2024-01-05"
    first = [(5, "set", 1, 1, 1, day, 4), (6, "set", 2, 1, 1, day, 5)]
    late = [(1, "set", 3, 1, 1, day, 9), (2, "delete", 1, 1, 1, day, 2), (3, "delete", 2, 1, 1, day, 1)]
    found, statuses = run(spark, tmp_path, [edits(spark, first), edits(spark, late)])
    assert statuses == {5: "saved", 6: "saved", 1: "day full", 2: "deleted", 3: "deleted"}
    assert found == []


def test_a_batch_that_fails_half_way_runs_again(spark, tmp_path, monkeypatch):
    """Its entries are written, its record is not: the next run repeats it from the same log."""
    entries, commands = scenario(16, n=60, people=4)
    expected, told = brute(entries, commands)
    start = saved(spark, tmp_path, entries)
    record = edit_stream._record

    def fails(spark, root, batch, years):
        if batch == 1:
            raise RuntimeError("lost")
        record(spark, root, batch, years)

    monkeypatch.setattr(edit_stream, "_record", fails)
    halves = [edits(spark, commands[:30]), edits(spark, commands[30:])]
    source, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    spark.createDataFrame([], edit_stream.EDIT).write.parquet(source)
    halves[0].coalesce(1).write.mode("append").parquet(source)
    edit_stream.run_available(edit_stream.read_edits(spark, source), log, ck, start)
    halves[1].coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        edit_stream.run_available(edit_stream.read_edits(spark, source), log, ck, start)
    monkeypatch.setattr(edit_stream, "_record", record)
    edit_stream.run_available(edit_stream.read_edits(spark, source), log, ck, start)
    assert as_text(bag(edit_stream.current_entries(spark, log), *ENTRY)) == expected
    assert dict(rows(edit_stream.edit_statuses(spark, log), "seq", "status")) == told
    ids = [r[0] for r in rows(edit_stream.current_entries(spark, log), "id")]
    assert len(ids) == len(set(ids))


def test_a_slot_with_a_third_of_all_edits(spark, tmp_path):
    rng = random.Random(17)
    commands = []
    for n in range(1, 601):
        p = 1 if n % 3 == 0 else rng.randint(2, 40)
        op = "delete" if rng.random() < 0.4 else "set"
        commands.append((n, op, rng.randint(1, 9), p, 1, "2024-01-05", rng.randint(1, 12)))
    found, statuses = run(spark, tmp_path, [edits(spark, commands)])
    expected, told = brute([], commands)
    assert (as_text(found), statuses) == (expected, told)


@pytest.mark.parametrize("batches", [1, 3])
def test_seeded_stream_writes_its_edits_in_many_tasks(spark, tmp_path, monkeypatch, batches):
    """The edits that wait for the stream are not brought into one task; parts arrive in turn."""
    n = 4000
    spark.range(0, n, numPartitions=4).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-03 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts",
        "id % 7 AS user_id", "'view' AS event_type", "CAST(id % 200 AS DOUBLE) AS value",
        "concat('{\"k\": ', id % 11, '}') AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    waits = []
    run_available = edit_stream.run_available

    def seen(source, root, checkpoint, start):
        files = spark.read.schema(edit_stream.EDIT).parquet(f"{root.removesuffix('/log')}/in")
        waits.append((files.rdd.getNumPartitions() > 1, len(set(files.inputFiles())), files.count()))
        run_available(source, root, checkpoint, start)

    monkeypatch.setattr(edit_stream, "run_available", seen)
    root = catalogue._seeded_stream(spark, str(tmp_path), batches)
    assert len(waits) == batches and waits[-1][2] == n
    assert waits[0][1] > 1
    statuses = rows(edit_stream.edit_statuses(spark, root), "seq")
    assert len(statuses) == len(set(statuses)) == n
    events = spark.read.parquet(str(tmp_path / "events.parquet"))
    fold = apply_edits(views.calendar_facts(events), views.calendar_edits(events, next_user=True))
    assert bag(edit_stream.current_entries(spark, root), *ENTRY) == bag(fold.entries, *ENTRY)
