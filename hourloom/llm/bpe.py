"""Op 7, BPE encoding and decoding with a backtracking encoder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import kept_by_worker, table

CACHE_WORDS = 150_000  # words a worker remembers; then it starts over
PIECE_CHARS = 1_000_000  # a very long text is encoded in pieces cut at white space
BLANK = regex.compile(r"[ \t\n\r]")
# Below U+0300 every text is in NFC, and tables of case and classes agree.
BEYOND = regex.compile("[\u0300-\U0010ffff]")
LAST = 0xE000  # a word's last byte is a symbol of its own in vocabularies with word ends


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule:
    printable Latin-1 stands for itself, the other bytes take 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens in merge order, the automaton of all tokens, and the pair table."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        made = {"".join(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        order = sorted(vocab, key=lambda t: (made.get(t, -1), vocab[t]))
        rank = {t: r for r, t in enumerate(order)}
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            t = rank[a + b]
            self.left[t], self.right[t] = rank[a], rank[b]
            self.merged[rank[a], rank[b]] = t
        self.ids = [vocab[t] for t in order]
        alphabet = byte_alphabet()
        self.tokens = ahocorasick.Automaton()
        for t, r in rank.items():
            ends = bool(self.suffix) and t.endswith(self.suffix)
            symbols = [alphabet[c] for c in (t.removesuffix(self.suffix) if ends else t)]
            if not symbols:
                continue
            key = "".join(map(chr, symbols[:-1])) + chr(symbols[-1] + LAST * ends)
            self.tokens.add_word(key, (r, len(key)))
        self.tokens.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        added = spec.get("added_tokens", [])
        self.special = {a["content"]: a["id"] for a in added}
        self.alphabet = alphabet
        # Latin text is split by the file's own pattern. Beyond it tables of Unicode versions
        # differ, so the library that the file is for normalises and splits there, and all
        # text of files that normalise otherwise; the merges are ours everywhere.
        self.pieces = _lower_pattern(spec)
        self.library = tokenizers.Tokenizer.from_str(blob.decode())
        self.marks = self.special and regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        # Decoding: token i's bytes and a space stand at offsets[i] : offsets[i + 1].
        by_id = {i: t for t, i in chain(vocab.items(), self.special.items())}
        parts = [(by_id.get(i, "") + " ").encode() for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stand next to each other in the encoding of their text: undoing
        their merges at the seam, latest first, no merge across it may have come earlier."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        bound = len(self.ids)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            inner_a, inner_b = self.right[a], self.left[b]
            if a > b and inner_a != a:
                bound, a = a, inner_a
            elif inner_b != b:
                bound, b = b + 1, inner_b
            elif inner_a != a:
                bound, a = a, inner_a
            else:
                return True

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, little-endian. At each position the longest token that fits
        its predecessor is tried first; a position without one is closed for good and the
        step before it taken back. Each position is closed at most once: linear time."""
        raw = word.encode()
        text = raw.decode("latin-1")
        if self.suffix:
            text = text[:-1] + chr(raw[-1] + LAST)
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, found in self.tokens.iter(text):
            starts[end - found[1] + 1].append(found)
        n = len(text)
        if len(starts[0]) and starts[0][-1][1] == n:
            return self.ids[starts[0][-1][0]].to_bytes(4, "little")
        closed = bytearray(n + 1)
        out: list[tuple[int, int]] = []
        at = 0
        while at < n:
            for token, length in reversed(starts[at]):
                if not closed[at + length] and (not out or self.compatible(out[-1][0], token)):
                    out.append((token, length))
                    at += length
                    break
            else:
                closed[at] = 1
                at -= out.pop()[1]
        return np.array([self.ids[t] for t, _ in out], "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if not text:
            return []
        if self.pieces and (text.isascii() or not BEYOND.search(text)):
            return self.pieces.findall(text.lower())
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.alphabet.__getitem__, w)).decode() for w, _ in found]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            # Where white space separates words, long texts are cut there.
            for piece in _slices(part) if self.pieces else [part]:
                known = self.words
                for w in self.split(piece):
                    if w not in known:
                        if len(known) >= CACHE_WORDS:
                            known = self.words = {}
                            self.fits = {}
                        known[w] = self.encode_word(w)
                    out.append(known[w])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids, a space between them, in UTF-8."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        begin = self.offsets[i]
        length = self.offsets[i + 1] - begin
        shift = begin - (np.cumsum(length) - length)
        return self.bytes[np.arange(length.sum()) + np.repeat(shift, length)][:-1].tobytes()


def _lower_pattern(spec: dict):
    """The pattern of a file that lower-cases NFC text and keeps the pattern's matches."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = spec["pre_tokenizer"].get("pretokenizers", [])
    if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]:
        for s in splits:
            if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]:
                return regex.compile(s["pattern"]["Regex"])
    return None


def _slices(text: str) -> Iterator[str]:
    """The text in slices that end before white space."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = BLANK.search(text, at + PIECE_CHARS)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def load(blob: bytes) -> Vocabulary:
    """The vocabulary, built once per Python worker."""
    return kept_by_worker("bpe", hashlib.sha256(blob).digest(), lambda: Vocabulary(blob))


def _shipped(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str):
    """Column function: text to its token ids. A null text counts as empty: no ids."""
    shipped = _shipped(spark, path)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = load(shipped.value)
        for texts in batches:
            ids = [np.frombuffer(vocab.encode(t.as_py() or ""), "<u4") for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(flat))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")


def decoder(spark: SparkSession, path: str):
    """Column function: token ids to text; null and empty give the empty text."""
    shipped = _shipped(spark, path)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = load(shipped.value)
        for lists in batches:
            yield pa.array(
                [vocab.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode() for x in lists],
                pa.string(),
            )

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")


ROUND_TRIP = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def round_trip(spark: SparkSession, path: str):
    """Column function: text to the number of its tokens and the SHA-256 of their ids and of
    what they decode to, so neither has to leave the task."""
    shipped = _shipped(spark, path)

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = load(shipped.value)
        for texts in batches:
            rows = []
            for t in texts:
                ids = vocab.encode(t.as_py() or "")
                rows.append(
                    {
                        "n_tokens": len(ids) // 4,
                        "ids_sha256": hashlib.sha256(ids).hexdigest(),
                        "decoded_sha256": hashlib.sha256(vocab.decode(ids)).hexdigest(),
                    }
                )
            yield pa.array(rows, ROUND_TRIP)

    digest.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_table(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row of `df` as a struct `row`, with `ids` (array<int>) and `n_tokens`.

    The ids are those of the vocabulary file at `path` (BPE over bytes, with or without word
    ends) without special tokens added; a special token's own text in a document is that
    token. Null texts count as empty. Rows are independent, so repeats, ties and an empty
    table need no rule; other columns pass in `row`, whatever their names. Nothing shuffles.
    """
    encode = encoder(df.sparkSession, path)
    rows = df.select(F.struct("*").alias("row"), encode(F.col(f"`{text_col}`")).alias("ids"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = round_trip(spark, default_path())
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
