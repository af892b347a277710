"""Op 13 against enumeration of all edits, and a plain walk over whole scripts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from hourloom.llm import audits, conversation_repair, queries

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        marks = SPACES.findall(text)
        if not marks:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif marks[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(letter, cost, what comes out) for one row."""
    role, text = row
    yield "D", 4, []
    if fault not in ("blank", "duplicate"):
        extra = 3 * (fault == "truncated")
        yield "K", extra, [row]
        for new in ("user", "assistant"):
            yield "R", 3 + extra, [(new, text)]


def by_enumeration(rows):
    """Least (cost, audit) over all edits, with up to two inserts in each gap."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    faults, best = faults_of(rows), None
    for picks in itertools.product(*[list(choices(r, f)) for r, f in zip(rows, faults)]):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for i, gap in enumerate(filled):
                out += [(role, "") for role in gap]
                audit += "I" * len(gap)
                cost += 3 * len(gap)
                if i < len(rows):
                    audit += picks[i][0]
                    cost += picks[i][1]
                    out += picks[i][2]
            if best is None or (cost, audit) < best[:2]:
                if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                    best = cost, audit, out
    return best


def by_walk(rows):
    """Least (cost, audit, turns), by whole scripts for each end of what is out so far."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserts(best):
        for _ in range(3):
            for at, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = steps.get((at, role[0]))
                    if to:
                        new = (cost + 3, audit + "I", out + [(role, "")])
                        best[to] = min(best.get(to, new), new, key=lambda b: b[:2])
        return best

    best = inserts({"": (0, "", [])})
    for row, fault in zip(rows, faults_of(rows)):
        new = {}
        for at, (cost, audit, out) in best.items():
            for letter, more, kept in choices(row, fault):
                to = steps.get((at, kept[0][0][:1])) if kept else at
                if to is not None:
                    found = (cost + more, audit + letter, out + kept)
                    new[to] = min(new.get(to, found), found, key=lambda b: b[:2])
        best = inserts(new)
    return min((best[e] for e in ("", "a") if e in best), key=lambda b: b[:2])


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "", " ", "tool", "User"]
    texts = ["", " \n", "Yes.", "No!", "well", "So?  ", "one.", "two."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_walk_equals_enumeration():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 2, 3):
        rows = random_rows(rng, n)
        assert by_walk(rows)[:2] == by_enumeration(rows)[:2]


def ours(rows, cuts=()):
    """Cost and audit from pieces that end at the cuts."""
    codes = {"": audits.FINE, "blank": audits.BLANK, "duplicate": audits.DUPLICATE, "truncated": audits.TRUNCATED}
    best, piece = audits.beginning(), None
    for i, ((role, _), fault) in enumerate(zip(rows, faults_of(rows))):
        if i in cuts and piece:
            best = audits.composed(best, piece.costs(), piece.scripts())
            piece = None
        piece = piece or audits.Piece(i == 0 and 0 not in cuts)
        piece.add(role[:1], codes[fault], 1)
    if piece:
        best = audits.composed(best, piece.costs(), piece.scripts())
    return audits.cheapest(best)


@pytest.mark.parametrize("modulus", [audits.MODULUS, 3])
def test_audits_whole_and_in_pieces(monkeypatch, modulus):
    """A tiny modulus makes hashes collide all the time."""
    monkeypatch.setattr(audits, "MODULUS", modulus)
    rng = random.Random(2)
    for _ in range(400):
        rows = random_rows(rng, rng.randint(0, 14))
        want = by_walk(rows)[:2]
        assert ours(rows) == want
        assert ours(rows, {i for i in range(len(rows)) if rng.random() < 0.4}) == want


def conversations(rows):
    """What op 13 must return for (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        if hit:
            order = (turn is not None, turn or 0)
            out[conv] += [(order, role, text, turn)] * (2 if hit == 3 else 1)
    done = {}
    for conv, found in out.items():
        found.sort()
        plain = [(r, t) for _, r, t, _ in found]
        faults = faults_of(plain)
        turns = [t for *_, t in found if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(plain, plain[1:])]
        cost, audit, mended = by_walk(plain)
        done[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            sha(mended),
        )
    return done


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_op13_on_a_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, SF)
    assert got.columns[0] == "conv_id"
    assert answers(got) == conversations(rows)


SCHEMA = "conv_id long, turn long, role string, text string, pos int, audit string, copies int"


def odd_table():
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randint(1, 9)):
            role, text = random_rows(rng, 1)[0]
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            rows.append((conv, turn, rng.choice([role, None]) if rng.random() < 0.2 else role, rng.choice([text, text, None])))
    rows += [(77, 1, "user", "Yes.")] * 30 + [(77, 2, "assistant", "No!")] * 2  # repeated rows
    rows += [(78, t, ("user", "assistant")[t % 2], f"long {t}. " * 300) for t in range(200)]  # a long one
    return rows


@pytest.mark.parametrize("most", [1, 7, 2048])
def test_odd_rows(spark, monkeypatch, tmp_path, most):
    """Nulls, repeated rows, ties of turns, clashing columns, one long conversation."""
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", most)
    rows = odd_table()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert answers(got) == conversations(rows)


def test_turns_and_empty_table(spark, tmp_path):
    rows = [("a", 2, "user", "Hi."), ("a", 1, "system", "Be kind."), ("b", 1, "assistant", "So.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = conversation_repair.repair(df).turns().orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, "system", "Be kind."),
        ("a", 1, "user", "Hi."),
        ("a", 2, "assistant", ""),
        ("b", 0, "user", ""),
        ("b", 1, "assistant", "So."),
    ]
    assert conversation_repair.repair(df.limit(0)).turns().count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).count() == 0
