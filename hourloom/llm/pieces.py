"""Op 12, encoding and decoding with piece models (merges over whole texts, byte fallback)."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import kept_by_worker, table

SPACE = "▁"  # stands for a space inside a model
BREAKS = "\n\t\r"  # texts are cut at those of them that no piece holds
CACHE_WORDS = 150_000  # words since the last change of memory; the one before is kept too
CACHE_CHARS = 200  # longer words are encoded each time
CACHE_PAIRS = 2_000_000
UNKNOWN = -1

# Kinds of pieces and the surface of an unknown id.
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
UNK_SURFACE = " ⁇ "


def _varint(blob: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = blob[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(blob):
        key, at = _varint(blob, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(blob, at)
        else:
            size, at = _varint(blob, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = blob[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """The pieces of a model file in merge order, their automaton, and the pair table.

    Takes merge-type models with byte fallback and plain normalisation (texts stay as they
    are, spaces become a letter of their own, one goes before the text). Two neighbours merge
    whenever their concatenation is a piece, better scores first, leftmost among equals.
    """

    def __init__(self, blob: bytes):
        message = list(fields(blob))
        trainer = dict(fields(next((v for n, v in message if n == 2), b"")))
        rules = dict(fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35):
            raise ValueError("only merge-type models with byte fallback are read")
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only models without normalisation, with a space before the text")
        pieces: list[tuple[str, float, int]] = []
        for number, value in message:
            if number == 1:
                p = dict(fields(value))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                pieces.append((p[1].decode(), score, p.get(3, NORMAL)))
        if {k for _, _, k in pieces} - {NORMAL, UNK, CONTROL, BYTE}:
            raise ValueError("pieces of other kinds are not read")
        self.byte_ids = [0] * 256
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
        ids = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == NORMAL}
        self._rank(ids, [s for _, s, _ in pieces])
        self._cuts(ids)
        # Decoding: id i's bytes stand at offsets[i] : offsets[i + 1].
        surface = {UNK: lambda t: UNK_SURFACE.encode(), CONTROL: lambda t: b""}
        surface[BYTE] = lambda t: bytes([int(t[1:-1], 16)])
        surface[NORMAL] = lambda t: t.replace(SPACE, " ").encode()
        parts = [surface[kind](t) for t, _, kind in pieces]
        self.offsets = np.cumsum([0, *map(len, parts)])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.kinds = np.array([kind for _, _, kind in pieces], np.int8)
        self.spaced = np.array([t.startswith(SPACE) for t, _, _ in pieces])
        self.binary = [struct.pack("<I", i) for i in range(len(pieces))]
        self.decimal = [b"%d," % i for i in range(len(pieces))]
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.older = self.words

    def _rank(self, ids: dict[str, int], scores: list[float]) -> None:
        """Number the pieces in merge order. A character that has no piece but is part of one
        takes a number too: it can merge; alone it falls back to its bytes."""
        loose = {c for t in ids for c in t} - ids.keys()
        order = sorted((t for t in ids if len(t) > 1), key=lambda t: (-scores[ids[t]], ids[t]))
        letters = sorted({t for t in ids if len(t) == 1} | loose)
        rank = {t: r for r, t in enumerate([*letters, *order])}
        self.ids = [ids.get(t, UNKNOWN) for t in rank]
        self.lengths = [len(t) for t in rank]
        self.left, self.right = list(range(len(rank))), list(range(len(rank)))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for t, r in rank.items():
            halves = self._last_merge(t, rank, len(letters)) if len(t) > 1 else None
            if halves:
                if max(halves) >= r:
                    raise ValueError(f"piece {ids[t]} comes before its parts")
                self.left[r], self.right[r] = halves
                self.merged[halves] = r
            if halves or len(t) == 1:
                self.tokens.add_word(t, (r, len(t)))
        self.tokens.make_automaton()

    @staticmethod
    def _last_merge(text: str, rank: dict[str, int], first: int) -> tuple[int, int] | None:
        """The two parts whose merge completes a piece, by merging its letters step by step;
        None for a piece that merging never makes."""
        parts = list(text)
        while len(parts) > 2:
            made = [rank.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            best = min((m for m in made if m >= first), default=None)
            if best is None:
                return None
            i = made.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None

    def _cuts(self, ids: dict[str, int]) -> None:
        """No piece reaches over a cut, so the words between cuts are encoded on their own:
        before spaces, if pieces hold spaces only in front, and around characters that no
        piece holds."""
        lone = "".join(c for c in BREAKS if not any(c in t for t in ids))
        if any(SPACE in t.lstrip(SPACE) for t in ids):
            self.cut = re.compile(f"[{lone}]|[^{lone}]+" if lone else "(?s:.)+")
        else:
            self.cut = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+|[{lone or SPACE}]")

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a, b stay as they are next to each other. Their own merges are taken
        back from the latest on, and the merge across the seam that becomes possible by it
        must not come earlier than the one taken back."""
        key = a * len(self.ids) + b
        fit, bound = True, len(self.ids)
        while True:
            if self.merged.get((a, b), bound) < bound:
                fit = False
                break
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                break
            if whole_b or (not whole_a and a > b):
                bound, a = a, self.right[a]
            else:  # equal merges go from left to right, so the right one is the later one
                bound, b = b + 1, self.left[b]
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text between cuts. `last[i]` is the one last piece of the encoding of the
        first i characters: the match that ends there and is compatible with the last piece
        of the prefix before it. The ids are read off backwards."""
        last = [UNKNOWN] * (len(word) + 1)
        fits, n, compatible = self.fits, len(self.ids), self.compatible
        for end, (piece, length) in self.tokens.iter(word):
            end += 1
            if last[end] == UNKNOWN:
                before = last[end - length]
                if before == UNKNOWN:
                    last[end] = piece
                else:
                    fit = fits.get(before * n + piece)
                    if fit or (fit is None and compatible(before, piece)):
                        last[end] = piece
        out: list[int] = []
        at = len(word)
        while at:
            piece = last[at]
            found = self.ids[piece] if piece != UNKNOWN else UNKNOWN
            if found != UNKNOWN:
                out.append(found)
                at -= self.lengths[piece]
            else:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(word[at].encode()))
        out.reverse()
        return out

    def words_of(self, text: str) -> list[tuple[bytes, bytes]]:
        """Per word of a text its ids as little-endian unsigned 32-bit integers, and as decimals
        each followed by a comma. An empty text has none."""
        if not text:
            return []
        if len(self.words) >= CACHE_WORDS:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        found = self.cut.findall(SPACE + text.replace(" ", SPACE))
        out = list(map(known.get, found))
        if None in out:
            for i, entry in enumerate(out):
                if entry is None:
                    word = found[i]
                    entry = out[i] = known.get(word) or older.get(word) or self._entry(word)
                    if len(word) <= CACHE_CHARS:
                        known[word] = entry
        return out

    def _entry(self, word: str) -> tuple[bytes, bytes]:
        ids = self.encode_word(word)
        binary, decimal = self.binary, self.decimal
        return b"".join([binary[i] for i in ids]), b"".join([decimal[i] for i in ids])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([ids for ids, _ in self.words_of(text)])

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8. Control ids are empty, the space before the text goes,
        bytes that are no UTF-8 become U+FFFD each."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        kinds = self.kinds[i]
        shown = kinds != CONTROL
        if not shown.all():
            # A control id parts the bytes before it from those after it.
            pieces = np.split(i, np.flatnonzero(~shown))
            parts = [p[1:] if n else p for n, p in enumerate(pieces)]
            parts = [p for p in parts if len(p)]
            first = [self.decode(p.astype("<u4").tobytes()) for p in parts[:1]]
            rest = [self._spelled(p) for p in parts[1:]]
            return b"".join(first + rest)
        if not len(i):
            return b""
        return self._spelled(i)[int(self.spaced[i[0]]) :]

    def _spelled(self, i: np.ndarray) -> bytes:
        begin = self.offsets[i]
        length = self.offsets[i + 1] - begin
        ends = np.cumsum(length)
        flat = self.bytes[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)]
        raw = flat.tobytes()
        is_byte = self.kinds[i] == BYTE
        if not is_byte.any():
            return raw
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self._repaired(flat, ends, is_byte)

    @staticmethod
    def _repaired(flat: np.ndarray, ends: np.ndarray, is_byte: np.ndarray) -> bytes:
        """Each run of byte pieces is decoded on its own."""
        cuts = np.flatnonzero(np.diff(is_byte)) + 1
        out, start = [], 0
        for stop in [*cuts.tolist(), len(ends)]:
            part = flat[(ends[start - 1] if start else 0) : ends[stop - 1]].tobytes()
            out.append(_each_bad_byte(part) if is_byte[start] else part)
            start = stop
        return b"".join(out)


def _each_bad_byte(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            break
        else:
            out.append("�".encode())
            size = 1
        at += size
    return b"".join(out)


def load(blob: bytes) -> PieceModel:
    """The model, built once per Python worker."""
    return kept_by_worker("pieces", hashlib.sha256(blob).digest(), lambda: PieceModel(blob))


def _shipped(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str):
    """Column function: text to the ids of its pieces. A null text counts as empty: no ids."""
    shipped = _shipped(spark, path)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(shipped.value)
        for texts in batches:
            ids = [np.frombuffer(model.encode(t.as_py() or ""), "<u4") for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(flat))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")


def decoder(spark: SparkSession, path: str):
    """Column function: ids to text; null and empty give the empty text."""
    shipped = _shipped(spark, path)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(shipped.value)
        for lists in batches:
            yield pa.array(
                [model.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode() for x in lists],
                pa.string(),
            )

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")


ROUND_TRIP = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def round_trip(spark: SparkSession, path: str):
    """Column function: text to the number of its ids and the SHA-256 of the ids as decimals
    joined by commas and of what they decode to, so neither has to leave the task."""
    shipped = _shipped(spark, path)

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(shipped.value)
        for texts in batches:
            rows = []
            for t in texts:
                words = model.words_of(t.as_py() or "")
                ids = b"".join([w[0] for w in words])
                decimals = b"".join([w[1] for w in words])[:-1]
                rows.append(
                    {
                        "n_tokens": len(ids) // 4,
                        "ids_sha256": hashlib.sha256(decimals).hexdigest(),
                        "decoded_sha256": hashlib.sha256(model.decode(ids)).hexdigest(),
                    }
                )
            yield pa.array(rows, ROUND_TRIP)

    digest.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_table(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row of `df` as a struct `row`, with `ids` (array<int>) and `n_tokens`.

    The ids are those of the model file at `path`, without begin and end ids. Null texts
    count as empty and have no ids; characters without a piece become the ids of their
    bytes. Rows are independent, so repeats, ties and an empty table need no rule; other
    columns pass in `row`, whatever their names. Nothing shuffles. A text costs one table
    entry per character while it is encoded, and is never cut short.
    """
    encode = encoder(df.sparkSession, path)
    rows = df.select(F.struct("*").alias("row"), encode(F.col(f"`{text_col}`")).alias("ids"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = round_trip(spark, default_path())
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
