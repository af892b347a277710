"""Ordered runs of edits over slots, cut into stretches that compose.

All steps are range-partitioned by slot and order of arrival, so a slot that holds a third of
all edits spreads over many tasks. Each task runs the slots in its range. Only a slot that
reaches over the end of a range needs more: its stretches are functions from the people who
hold the slot before to those who hold it after, and are put together in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hourloom.operators.slot_rules import SEATS, Slot
from hourloom.schema import SLOT
from hourloom.session import fresh_dir

KEY = [*SLOT, "seed", "at", "seq"]
# The id of a snapshot entry is its `seq`.
_STEP = [*KEY, "op", "userId", "hour"]

RESULT = (
    "projectId long, stageId int, dateStamp date, userId long, id long, born long, hours int, "
    "seq long, status string"
)
_COLUMNS = [
    "projectId", "stageId", "dateStamp", "userId", "id", "born", "hours", "seq", "status",
]
_WHOLE = ["projectId", "stageId", "userId", "id", "born", "hours", "seq"]
# A mark tells the driver about a stretch at the end of a range: at most two per range.
_MARKED = f"{RESULT}, range int, mark string"

_STAND_IN = -(1 << 62)  # and below: no user has such an id

State = dict[int, list[list]]


def _text(state: State) -> str:
    return json.dumps(sorted(state.items()))


def _state(text: str) -> State:
    return {user: entries for user, entries in json.loads(text)}


def _slot(state: State) -> Slot:
    return Slot((user, entry) for user, entries in state.items() for entry in entries)


def _outsiders(n: int) -> State:
    """People who hold a slot and have no steps in a stretch, as stand-ins."""
    return {_STAND_IN - i: [[None, None, 0]] for i in range(n)}


def _frame(rows: list[tuple], more: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[*_COLUMNS, *more])
    return frame.astype({c: "Int64" for c in (*_WHOLE, *(["range"] if "range" in more else []))})


def _steps(batch: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(batch[c] for c in _STEP))


class _Run:
    """One slot's steps in one range, run from an empty slot; the first slot of a range, which
    may go on from the range before, from slots held by one and two outsiders too."""

    def __init__(self, key: tuple, first: tuple, is_first: bool):
        self.key, self.first = key, first
        self.slots = [_slot(_outsiders(n)) for n in range(SEATS + 1 if is_first else 1)]

    def step(self, seed: int, op: str, user: int, hour: int, seq: int) -> tuple | None:
        for slot in reversed(self.slots):
            status = _applied(slot, seed, op, user, hour, seq)
        return None if seed == 0 else (*self.key, user, None, None, None, seq, status, None, None)

    def entries(self) -> list[tuple]:
        return [(*self.key, u, i, b, h, None, None, None, None) for u, i, b, h in self.slots[0].rows()]

    def mark(self, number: int) -> tuple:
        found = json.dumps({"first": self.first, "exits": [_text(s.held) for s in self.slots]})
        return (*self.key, *[None] * 6, number, found)


def _applied(slot: Slot, seed: int, op: str, user: int, hour: int, seq: int) -> str | None:
    if seed == 0:
        slot.seed(user, seq, hour)
        return None
    return slot.apply(op, user, hour, seq)


def _run_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of the slots of one range, and marks of its first and its last slot."""
    number = TaskContext.get().partitionId()
    run, marked = None, False
    for batch in batches:
        out = []
        for p, s, d, seed, at, seq, op, user, hour in _steps(batch):
            key = (p, s, d)
            if run is None or key != run.key:
                if run is not None:
                    out.extend(run.entries())
                    if not marked:
                        out.append(run.mark(number))
                        marked = True
                run = _Run(key, (int(seed), int(at), int(seq)), run is None)
            told = run.step(int(seed), op, int(user), int(hour), int(seq))
            if told:
                out.append(told)
        yield _frame(out, ["range", "mark"])
    if run is not None:
        yield _frame([*run.entries(), run.mark(number)], ["range", "mark"])


def run_slots(steps: DataFrame) -> DataFrame:
    """Run each slot's steps in order: (slot, userId, id, born, hours) of what it holds in the
    end, and (slot, userId, seq, status) of each edit.

    `steps` has seed (0 for an entry of the snapshot, 1 for an edit), ts, seq (an entry's id),
    op, userId, hour and the slot. The result is written once.
    """
    spark = steps.sparkSession
    at = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
    keyed = steps.withColumn("at", at).select(*_STEP)
    path = fresh_dir(spark, "slot-runs")
    ranged = keyed.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ranged.mapInPandas(_run_range, _MARKED).write.parquet(path)
    done = spark.read.schema(_MARKED).parquet(path)
    # At most two marks per range come to the driver.
    stretches = _Stretches(done.filter(F.col("mark").isNotNull()).collect())
    results = done.filter(F.col("mark").isNull()).drop("range", "mark")
    if not stretches.slots:
        return results
    long = F.broadcast(spark.createDataFrame(list(stretches.slots), steps.select(*SLOT).schema))
    return results.join(long, SLOT, "left_anti").unionByName(stretches.put_together(keyed, long))


class _Stretches:
    """The slots that reach over range ends, and what is known of their stretches: `exits` by
    the state a stretch is entered in, who of some people `acts` in it."""

    def __init__(self, marks: list):
        by_slot: dict[tuple, list] = {}
        for m in sorted(marks, key=lambda m: m.range):
            found = json.loads(m.mark)
            ranges = by_slot.setdefault((m.projectId, m.stageId, m.dateStamp), [])
            if not ranges or ranges[-1][0] != m.range:
                ranges.append((m.range, found["first"], [_state(e) for e in found["exits"]]))
        self.slots = {k: v for k, v in by_slot.items() if len(v) > 1}
        self.exits: dict[tuple, dict[str, State]] = {}
        self.acts: dict[tuple, dict[int, bool]] = {}

    def _through(self, slot: tuple, n: int, state: State) -> tuple[State, bool]:
        """The state after stretch `n`, and whether it is certain."""
        known = self.exits.get((slot, n), {}).get(_text(state))
        if known is not None:
            return known, True
        acts = self.acts.get((slot, n), {})
        generic = self.slots[slot][n][2][min(len(state), SEATS)]
        # Nobody who holds the slot has a step in the stretch: they stay, and only their
        # number counts for the others.
        kept = {u: e for u, e in generic.items() if u > _STAND_IN}
        return state | kept, all(acts.get(u) is False for u in state) and len(state) <= SEATS

    def _walk(self, slot: tuple) -> tuple[list[State], int]:
        """The state each stretch is entered in, and how many of them are certain."""
        stretches = self.slots[slot]
        state, certain = stretches[0][2][0], True
        states, sure = [{}], 1
        for n in range(1, len(stretches)):
            states.append(state)
            sure += certain
            state, known = self._through(slot, n, state)
            certain = certain and known
        return states, sure

    def put_together(self, steps: DataFrame, long: DataFrame) -> DataFrame:
        """Settle the state each stretch is entered in, then run all from there. Every round
        runs all open stretches at once, from the states that are likely by now; it settles
        the first open stretch of each slot, and those after it whose state was right."""
        spark = steps.sparkSession
        firsts = [(*slot, [tuple(s[1]) for s in found]) for slot, found in self.slots.items()]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.select(*SLOT).schema)
        cuts = spark.createDataFrame(firsts, f"{schema}, firsts array<struct<seed:int,at:long,seq:long>>")
        place = F.struct(F.col("seed").cast("int").alias("seed"), "at", "seq")
        cut = steps.join(F.broadcast(cuts), SLOT).withColumn(
            "stretch", F.size(F.filter("firsts", lambda f: f <= place)) - 1
        )
        path = fresh_dir(spark, "slot-stretches")
        cut.select(*_STEP, "stretch").write.partitionBy("stretch").parquet(path)
        stored = spark.read.schema(cut.select(*_STEP, "stretch").schema).parquet(path)
        while True:
            walks = {slot: self._walk(slot) for slot in self.slots}
            entered = {(slot, n): state for slot, (states, _) in walks.items() for n, state in enumerate(states)}
            open_ = {(slot, n) for slot, (states, sure) in walks.items() for n in range(sure, len(states))}
            if not open_:
                break
            people = {slot: sorted({u for s in states for u in s}) for slot, (states, _) in walks.items()}
            wanted = {k: _text(entered[k]) for k in open_ | self._next_certain(walks)}
            asked = _asked(stored, wanted, long.schema)
            told = asked.mapInPandas(_probe(wanted, people), "slot string, stretch int, mark string")
            for row in told.collect():  # one row per open stretch
                slot = next(s for s in self.slots if str(s) == row.slot)
                found = json.loads(row.mark)
                self.exits.setdefault((slot, row.stretch), {})[wanted[slot, row.stretch]] = _state(found["exit"])
                acting = self.acts.setdefault((slot, row.stretch), {})
                acting.update({u: u in found["acts"] for u in people[slot]})
        wanted = {k: _text(s) for k, s in entered.items()}
        last = {slot: len(found) - 1 for slot, found in self.slots.items()}
        return _asked(stored, wanted, long.schema).mapInPandas(_settled(wanted, last), RESULT)

    @staticmethod
    def _next_certain(walks: dict) -> set:
        """The stretches that are entered in a certain state and left in an open one."""
        return {(slot, sure - 1) for slot, (states, sure) in walks.items() if 1 < sure < len(states)}


def _asked(stored: DataFrame, wanted: dict, schema) -> DataFrame:
    """The steps of some stretches, each stretch in order. One row per stretch is broadcast."""
    rows = [(*slot, n) for slot, n in wanted]
    wide = StructType([*schema, StructField("stretch", IntegerType())])
    keys = stored.sparkSession.createDataFrame(rows, wide)
    order = [*SLOT, "stretch", "seed", "at", "seq"]
    picked = stored.join(F.broadcast(keys), [*SLOT, "stretch"], "left_semi")
    return picked.repartition(*SLOT, "stretch").sortWithinPartitions(*order)


def _stretch_runs(batches: Iterator[pd.DataFrame], wanted: dict) -> Iterator[tuple]:
    """(slot key, stretch, slot, step, status) for each step, run from the wanted states."""
    key, slot = None, None
    for batch in batches:
        for n, (p, s, d, seed, _, seq, op, user, hour) in zip(batch["stretch"], _steps(batch)):
            if (p, s, d, n) != key:
                key = (p, s, d, n)
                slot = _slot(_state(wanted[(p, s, d), n]))
            status = _applied(slot, int(seed), op, int(user), int(hour), int(seq))
            yield (p, s, d), int(n), slot, int(user), int(seq), status


def _probe(wanted: dict, people: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, held, acts = [], None, None, set()

        def closed():
            mark = json.dumps({"exit": _text(held.held), "acts": sorted(acts)})
            return (str(key[0]), key[1], mark)

        for where, n, slot, user, _, _ in _stretch_runs(batches, wanted):
            if (where, n) != key:
                if key is not None:
                    out.append(closed())
                key, acts = (where, n), set()
                known = set(people[where])
            held = slot
            if user in known:
                acts.add(user)
        if key is not None:
            out.append(closed())
        yield pd.DataFrame(out, columns=["slot", "stretch", "mark"])

    return run


def _settled(wanted: dict, last: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ends():
            if key is not None and key[1] == last[key[0]]:
                out.extend((*key[0], u, i, b, h, None, None) for u, i, b, h in held.rows())

        out, key, held = [], None, None
        for where, n, slot, user, seq, status in _stretch_runs(batches, wanted):
            if (where, n) != key:
                ends()
                key = (where, n)
            held = slot
            if status is not None:
                out.append((*where, user, None, None, None, seq, status))
            if len(out) >= 10_000:
                yield _frame(out, [])
                out = []
        ends()
        yield _frame(out, [])

    return run
