"""Op 5, language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import kept_by_worker, table
from hourloom.llm.texts import CODE_POINTS, blocks

SAMPLE_DOCS = 256  # labelled documents looked at per language, at most
SAMPLE_CHARS = 24_000  # characters of an automaton, at most
STRETCH = 3_000  # characters that one document gives to a sample, at most
SYMBOLS = 62  # letters of a language with a symbol of their own, the most frequent ones
SHARED = 16  # symbols that its other letters share
CHUNK = 256  # a text is parsed in pieces of this many symbols, all of them
LANES = 16_384  # pieces parsed side by side
SHARPNESS = 12.0


def labelled_sample(
    df: DataFrame, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS
) -> dict[str, str]:
    """Training text per language: stretches of the documents of a bounded sample, `chars`
    characters in all. Of each language's rows with a letter one is taken per hash bucket,
    `docs` buckets, whatever its length, so every language gets a sample; a document longer
    than `STRETCH` gives a stretch that begins at a place drawn by its hash. Only hashes are
    looked at for that, and only the stretches come to the driver."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    lettered = text.rlike(r"\p{L}")
    rows = df.filter(lang.isNotNull() & lettered).select(
        lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")
    )
    picked = rows.groupBy("lang", F.pmod(F.col("h"), F.lit(docs)).alias("bucket"))
    chosen = [(r.lang, r.h) for r in picked.agg(F.min("h").alias("h")).collect()]
    # No further than a stretch before the end.
    room = F.greatest(F.length("text") - STRETCH + 1, F.lit(1))
    begin = F.pmod(F.xxhash64(F.lit(3), "h"), room.cast("long")).cast("int") + 1
    stretch = F.substring("text", begin, F.lit(STRETCH)).alias("text")
    wanted = rows.filter(F.col("h").isin([h for _, h in chosen])).select("lang", "h", stretch)
    found = wanted.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    keys, out = set(chosen), {}
    for r in found:
        if (r.lang, r.h) in keys:
            out[r.lang] = (out.get(r.lang, "") + "\n" + r.text)[:chars]
    return {k: v for k, v in out.items() if any(map(str.isalpha, v))}


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of all factors of a symbol sequence; -1 where none."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        now = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
        last = now
    out = np.full((len(nxt), width), -1, np.int32)
    for state, moves in enumerate(nxt):
        for s, t in moves.items():
            out[state, s] = t
    return out


class Parser:
    """Cross-parses texts with the automata of all languages at once.

    Letters are numbered over all samples, lower-cased: 0 is anything but a letter (runs are
    one), 1 a letter that no sample has; the last number pads. Each language has symbols of
    its own for them: 0 and the padding as above, 1 for letters its sample lacks, which no
    phrase contains, then its most frequent letters one by one, then the others, several to
    a symbol. A table entry is twice the next state's offset, plus 1 where the longest match
    ended and a new phrase begins.
    """

    def __init__(self, samples: dict[str, str], symbols: int = SYMBOLS, shared: int = SHARED):
        self.langs = sorted(samples)
        letters = {x: Counter(c for c in samples[x].lower() if c.isalpha()) for x in self.langs}
        number = {c: i + 2 for i, c in enumerate(sorted(set().union(*letters.values())))}
        self.pad = len(number) + 2
        self.symbol = np.zeros(CODE_POINTS, np.uint32)
        for cp in range(CODE_POINTS):
            c = chr(cp)
            if c.isalpha():
                self.symbol[cp] = number.get(c) or number.get(c.lower(), 1)
        width = symbols + shared + 3
        self.of = np.ones((len(self.langs), len(number) + 3), np.int32)
        self.of[:, 0], self.of[:, -1] = 0, width - 1
        for i, lang in enumerate(self.langs):
            for place, (c, _) in enumerate(letters[lang].most_common()):
                own = place if place < symbols else symbols + ord(c) % shared
                self.of[i, number[c]] = own + 2
        tables, self.starts, self.bits, base = [], [], [], 0
        for i, lang in enumerate(self.langs):
            moves = suffix_automaton(self.of[i, self.fold(samples[lang])].tolist(), width)
            # One more state follows a symbol the sample does not have: a phrase by itself.
            alone = len(moves)
            states = alone + 1
            moves = np.vstack([moves, np.full(width, -1, np.int32)])
            again = np.where(moves[0] >= 0, moves[0], alone)
            offset = np.arange(states, dtype=np.int64) * width + base
            target = np.where(moves >= 0, moves, again) * np.int64(width) + base
            fresh = moves < 0
            fresh[0] = False  # the first phrase has begun
            entry = target * 2 + fresh
            entry[:, width - 1] = offset * 2
            tables.append(entry.astype(np.int32).reshape(-1))
            self.starts.append(base)
            self.bits.append(np.log2(max(2, len(samples[lang]))))
            base += states * width
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def fold(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.squeeze(self.symbol[codes])[0]

    @staticmethod
    def squeeze(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of non-letters become one symbol; also where the kept ones stood."""
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        at = np.flatnonzero(keep)
        return s[at], at

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane (column of symbols) by language."""
        n, k = lanes.shape[1], len(self.langs)
        state = np.repeat(np.array(self.starts, np.int32), n)
        count = np.ones(n * k, np.int32)
        for row in lanes:
            entry = self.table.take(state + self.of[:, row].reshape(-1), mode="clip")
            count += entry & 1
            state = entry >> 1
        return count.reshape(k, n)

    def judge(self, codes: np.ndarray, ends: np.ndarray) -> tuple[list, np.ndarray]:
        """Language (None: no letter) and score of each text of a block."""
        symbols, at = self.squeeze(self.symbol[codes])
        ends = np.searchsorted(at, ends)
        begins = np.concatenate([[0], ends[:-1]])
        pieces = np.maximum(1, -(-(ends - begins) // CHUNK))
        first = np.cumsum(pieces) - pieces
        start = np.repeat(begins, pieces) + CHUNK * (
            np.arange(pieces.sum()) - np.repeat(first, pieces)
        )
        size = np.minimum(CHUNK, np.repeat(ends, pieces) - start)
        padded = np.append(symbols, np.zeros(CHUNK, np.uint32))
        steps = np.arange(CHUNK)
        found = []
        for i in range(0, len(start), LANES):
            s, n = start[i : i + LANES], size[i : i + LANES]
            lanes = padded[s[None, :] + steps[: n.max(initial=0), None]].astype(np.int32)
            lanes[steps[: n.max(initial=0), None] >= n[None, :]] = self.pad
            found.append(self.phrases(lanes))
        per_text = np.add.reduceat(np.concatenate(found, 1), first, axis=1)
        cost = per_text * np.array(self.bits)[:, None] / np.maximum(1, ends - begins)
        has = np.append(np.add.reduceat(np.append(symbols > 0, False), begins), 0)[: len(ends)]
        has = np.where(ends > begins, has, 0)
        best = cost.argmin(axis=0)
        ratio = np.exp(SHARPNESS * (1 - cost / cost.min(axis=0)))
        score = 1 / ratio.sum(axis=0)
        langs = [self.langs[b] if h else None for b, h in zip(best, has)]
        return langs, np.where(has > 0, score, 0.0)


def _parser(samples: dict[str, str]) -> Parser:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).digest()
    return kept_by_worker("language", key, lambda: Parser(samples))


def language_column(samples: dict[str, str]):
    """Column function: text to (lang_pred, score)."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(samples) if samples else None
        for texts in batches:
            langs, scores = [], [np.zeros(0)]
            for n, codes, ends in blocks(texts):
                if parser is None:
                    found, score = [None] * n, np.zeros(n)
                else:
                    found, score = parser.judge(codes, ends)
                langs += [x if x is not None else "und" for x in found]
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(scores))],
                names=["lang_pred", "score"],
            )

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "lang_pred string, score double")


def identify(df: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """Every row of `df` as a struct `row`, with `lang_pred` and `score`.

    A text is parsed greedily, per language, into the longest pieces that occur in that
    language's sample; phrases times the bits to point into the sample, per symbol, is the
    cost, and the cheapest language wins (the first by name on a tie). The whole text counts;
    it is parsed in pieces of `CHUNK` symbols so that many run side by side. `score` is 1 for
    a clear win and near 1 / languages for a toss-up. A text that is null or has no letter is
    `und` with score 0; so is every text if nothing was learned. Rows are independent, other
    columns pass in `row` whatever their names, an empty table stays empty, nothing shuffles.
    """
    predict = language_column(samples)
    rows = df.select(F.struct("*").alias("row"), predict(F.col(f"`{text_col}`")).alias("p"))
    return rows.select("row", "p.lang_pred", "p.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held_out = F.crc32(key) % 3 == 1
    samples = labelled_sample(docs.filter(~held_out), "text", "lang")
    judged = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples)
    return judged.select("row.doc_id", "row.held_out", "lang_pred", "score")
