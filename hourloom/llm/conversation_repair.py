"""Op 13, conversation structure repair: faults, cheapest edits, repaired turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hourloom.llm import audits
from hourloom.llm.common import keys128, spread_join, stored, table

PIECE_ROWS = 2048  # rows of a conversation that one piece sums up
PREFIX = 64  # characters of a text that decide its range; rows inside are ordered by all
SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
ROLES = {audits.USER: "user", audits.ASSISTANT: "assistant"}
OUT_ROWS = 1000  # repaired rows of an Arrow batch

_KEY = ["_null", "_conv"]


@dataclass(frozen=True)
class Repair:
    """`conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    `_script`: the rows in order with each conversation's audit ahead of them."""

    conversations: DataFrame
    _script: DataFrame
    _conv: StructField

    def turns(self) -> DataFrame:
        """(conv_id, place, role, text) of the repaired conversations, place from 0."""
        schema = StructType([*self._script.select(*_KEY).schema])
        schema = schema.add("place", "long").add("role", "string").add("text", "string")
        return self._conv_back(self._script.mapInArrow(_turns, schema))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of each conversation's `role:text`, newline-joined."""
        schema = StructType([*self._script.select(*_KEY).schema]).add("repaired_sha256", "string")
        return self._conv_back(self._script.mapInArrow(_digests, schema))

    def _conv_back(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in _KEY]
        return df.select(_conv_of(self._conv), *rest)


def _conv_of(field: StructField) -> Column:
    return F.when(~F.col("_null"), F.col("_conv")).cast(field.dataType).alias(field.name)


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Mend conversations with the fewest edits, see `audits`.

    Rows go by turn, nulls first, and rows of one turn by role and text. Null roles and texts
    count as one space; a null id is a conversation of its own; a role whose first letter is
    not s, u or a can only be renamed or deleted. Rows repeated inside a turn are
    combined before anything shuffles, and stand next to each other. An empty table gives
    empty results; columns beyond the four play no part.

    Rows are range-partitioned in order, so a conversation that holds a third of all rows
    spreads over many tasks; each sums up its pieces, and pieces compose. One task per
    conversation strings the pieces together, and one streams its rows to the digest, which
    is sequential by definition; neither holds its texts.
    """
    field = StructField(conv, df.schema[conv].dataType)
    rows = df.select(
        F.col(f"`{conv}`").isNull().alias("_null"),
        F.coalesce(F.col(f"`{conv}`"), F.lit(0).cast(field.dataType)).alias("_conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )
    order = [*_KEY, "turn", "role", "text"]
    combined = rows.groupBy(*order).agg(F.count("*").alias("copies"))
    # Positions are stored: a second run of the range partitioner could cut otherwise.
    k1, k2 = keys128(F.col("role"), F.col("text"))
    ranged = combined.repartitionByRange(*_KEY, "turn", "role", F.left("text", F.lit(PREFIX)))
    placed = stored(
        ranged.sortWithinPartitions(*order).select(
            "*",
            F.monotonically_increasing_id().alias("pos"),
            F.substring("role", 1, 1).alias("initial"),
            _own_fault(F.col("text")).alias("fault"),
            k1.alias("k1"),
            k2.alias("k2"),
        ),
        "turns",
    )
    pieces = _pieces(_with_duplicates(placed))
    ends = _strung(pieces)
    spans = placed.groupBy(*_KEY, "turn").agg(F.lit(1).alias("_one")).groupBy(*_KEY)
    spans = spans.agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    found = spans.join(ends, _KEY)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    script = (
        ends.select(*_KEY, F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"),
                    F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
        .unionByName(placed.select(*_KEY, "pos", "role", "text", "copies"))
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "pos")
    )
    return Repair(found.select(_conv_of(field), *counts), script, field)


def _own_fault(text: Column) -> Column:
    """Blank and truncated rows, by their own text."""
    bare = F.rtrim(text, F.lit(SPACES))
    return (
        F.when(bare == "", audits.BLANK)
        .when(~F.substring(bare, -1, 1).isin(*ENDINGS), audits.TRUNCATED)
        .otherwise(audits.FINE)
    )


def _with_duplicates(placed: DataFrame) -> DataFrame:
    """Narrow rows with their first fault: a text and role seen earlier are a duplicate."""
    narrow = placed.select(*_KEY, "pos", "initial", "fault", "copies", "k1", "k2")
    texts = [*_KEY, "k1", "k2"]
    repeated = narrow.groupBy(*texts).agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    repeated = repeated.filter("_n > 1").drop("_n")
    again = (F.col("fault") != audits.BLANK) & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    return spread_join(narrow, repeated, texts, "left").select(
        *_KEY, "pos", "initial", F.when(again, audits.DUPLICATE).otherwise(F.col("fault")).alias("fault"), "copies"
    )


_PIECE = (
    "first_pos long, begins boolean, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, costs array<long>, scripts array<string>"
)


def _pieces(narrow: DataFrame) -> DataFrame:
    """Summaries of stretches of rows. A range of positions stays together and in order."""
    part = F.shiftright("pos", 33)
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.select(*_KEY).schema)
    return (
        narrow.withColumn("_part", part)
        .repartition("_part")
        .sortWithinPartitions("pos")
        .mapInArrow(_summed(PIECE_ROWS), f"{key}, {_PIECE}")
    )


def _summed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, start, done, schema = None, None, 0, [], None
        for batch in batches:
            schema = schema or _piece_schema(batch)
            columns = [batch.column(c).to_pylist() for c in ("_part", *_KEY, "pos", "initial", "fault", "copies")]
            for part, null, conv, pos, initial, fault, copies in zip(*columns):
                here = (part, null, conv)
                if here != key or piece.rows >= most:
                    if piece is not None:
                        done.append(_piece_row(key, start, piece))
                    # Only the first conversation of a range may have rows in another one.
                    piece = audits.Piece(here != key and key is not None and part == key[0])
                    key, start = here, pos
                piece.add(initial, fault, copies)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([_piece_row(key, start, piece)], schema)

    return run


def _piece_schema(batch: pa.RecordBatch) -> pa.Schema:
    fields = [(c, batch.schema.field(c).type) for c in _KEY]
    longs = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    return pa.schema(
        [*fields, ("first_pos", pa.int64()), ("begins", pa.bool_()), *longs, ("first", pa.string()),
         ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("scripts", pa.list_(pa.string()))]
    )


def _piece_row(key: tuple, start: int, piece: audits.Piece) -> dict:
    return {
        "_null": key[1],
        "_conv": key[2],
        "first_pos": start,
        "begins": piece.begins,
        "blank": piece.counts[audits.BLANK],
        "duplicate": piece.counts[audits.DUPLICATE],
        "truncated": piece.counts[audits.TRUNCATED],
        "illegal": piece.illegal,
        "first": piece.first,
        "last": piece.last,
        "costs": piece.costs(),
        "scripts": piece.scripts(),
    }


_ENDS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _strung(pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation from its pieces in order."""
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*_KEY).schema)
    ordered = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first_pos")
    return stored(ordered.mapInArrow(_string, f"{key}, {_ENDS}"), "audits")


def _string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted = ("blank", "duplicate", "truncated", "illegal")
    key, best, counts, last, schema = None, None, None, None, None

    def closed() -> pa.RecordBatch:
        cost, audit = audits.cheapest(best)
        row = dict(zip((*_KEY, *counted, "cost", "audit"), (*key, *counts, cost, audit)))
        return pa.RecordBatch.from_pylist([row], schema)

    out: list[pa.RecordBatch] = []
    for batch in batches:
        if schema is None:
            fields = [(c, batch.schema.field(c).type) for c in _KEY]
            longs = [(c, pa.int64()) for c in (*counted, "cost")]
            schema = pa.schema([*fields, *longs, ("audit", pa.string())])
        columns = [batch.column(c).to_pylist() for c in (*_KEY, *counted, "first", "last", "costs", "scripts")]
        for null, conv, *numbers, first, final, costs, scripts in zip(*columns):
            if (null, conv) != key:
                if key is not None:
                    out.append(closed())
                key, best, counts, last = (null, conv), audits.beginning(), [0] * 4, None
            best = audits.composed(best, costs, scripts)
            counts = [a + b for a, b in zip(counts, numbers)]
            counts[3] += last is not None and last + first not in audits.LEGAL_PAIRS
            last = final
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if key is not None:
        yield closed()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, role, text) of each repaired turn in order, and (key, None, None) at the end of
    each conversation. Each conversation's audit comes ahead of its rows."""
    key, audit, at, state = None, "", 0, audits.EMPTY

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == audits.INSERT:
            at += 1
            state = audits.NEXT[state]
            yield key, ROLES[state], ""

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "pos", "role", "text", "copies")]
        for null, conv, pos, role, text, copies in zip(*columns):
            if pos < 0:
                if key is not None:
                    yield from inserted()
                    yield key, None, None
                key, audit, at, state = (null, conv), text, 0, audits.EMPTY
                continue
            yield from inserted()
            letter = audit[at]
            if letter == audits.KEEP:
                state = audits.MOVES[role[:1]][state]
                yield key, role, text
            elif letter == audits.REROLE:
                state = audits.NEXT[state]
                yield key, ROLES[state], text
            at += copies
    if key is not None:
        yield from inserted()
        yield key, None, None


def _out_schema(batch: pa.RecordBatch, more: list) -> pa.Schema:
    return pa.schema([*[(c, batch.schema.field(c).type) for c in _KEY], *more])


def _peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)

    def again():
        if first is not None:
            yield first
        yield from batches

    return first, again()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, batches = _peeked(iter(batches))
    if first is None:
        return
    schema = _out_schema(first, [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    rows, place = [], 0
    for key, role, text in _repaired(batches):
        if role is None:
            place = 0
            continue
        rows.append(dict(zip((*_KEY, "place", "role", "text"), (*key, place, role, text))))
        place += 1
        if len(rows) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, batches = _peeked(iter(batches))
    if first is None:
        return
    schema = _out_schema(first, [("repaired_sha256", pa.string())])
    rows, digest, between = [], hashlib.sha256(), b""
    for key, role, text in _repaired(batches):
        if role is None:
            rows.append(dict(zip((*_KEY, "repaired_sha256"), (*key, digest.hexdigest()))))
            digest, between = hashlib.sha256(), b""
            if len(rows) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        else:
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
    yield pa.RecordBatch.from_pylist(rows, schema)


def damaged(df: DataFrame) -> DataFrame:
    """The rows of `conversations` damaged by a hash of conversation and turn: of twenty
    parts, one drops the row, one empties its text, one takes its sentence ends away, one
    repeats it, one makes it a user's. Null roles and texts become one space."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        "conv_id",
        "turn",
        either("role").alias("role"),
        either("text").alias("text"),
        (F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20).alias("_hit"),
    ).filter("_hit <> 0")
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_hit") == 1, F.lit(""))
        .when(F.col("_hit") == 2, F.translate("text", "".join(ENDINGS), ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    mended = repair(damaged(rows))
    # Conversations that lost all rows stay, null ids too.
    ids = rows.select("conv_id").distinct()
    counts = [c for c in mended.conversations.columns if c not in ("conv_id", "audit")]
    found = mended.conversations.withColumnRenamed("conv_id", "_c")
    digests = mended.digests().withColumnRenamed("conv_id", "_d")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left"
    )
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
