"""Op 4, toxicity: a noisy channel restores disguised words, then the restored text is scored."""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import kept_by_worker, stored, table
from hourloom.llm.texts import CODE_POINTS, blocks

SAMPLE_ROWS = 20_000  # labelled rows the classifier is fitted on, about, at most
LEXICON = 4_000  # features of the lexicon, at most
EVIDENCE = 28.0  # least G-test statistic of a feature
LIFT = 4.0  # a feature is at least so many times likelier in toxic text
FOLDS = 4  # parts of the sample for the calibration
PREFIXES = (4, 5, 6, 7)
CAP = 6.0  # most log-odds of one word

LETTERS = "abcdefghijklmnopqrstuvwxyz"
FULL_WIDTH = [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]  # wide forms of A-Z and a-z
SPACE = 26  # symbol of anything but a letter in the character model
SYMBOLS = 27
#: What a disguising character may stand for; fixed values.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "€": "e",
    "£": "l", "¡": "i", "(": "c",
}
#: Letters of other scripts that are drawn like a Latin one; fixed values.
SAME_SHAPE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y",
    "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SIGNS = LOOKS_LIKE | SAME_SHAPE
#: Characters that are not drawn at all: soft hyphen, zero-width space and joiners, marks.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DROPPED = ".-_*~'`^" + UNSEEN  # characters that may stand for nothing between letters
COST_LOOK, COST_DROP, COST_RUN = 1.0, 0.3, 0.3  # of the channel, in nats
LONGEST = 48  # characters of a spot whose readings are remembered


def letter_symbols() -> np.ndarray:
    """Symbol of each code point: letters fold to a-z by their base letter."""
    out = np.full(CODE_POINTS, SPACE, np.uint8)
    for cp in [*range(0x250), *FULL_WIDTH]:
        base = unicodedata.normalize("NFKD", chr(cp)).lower()[:1]
        if base in LETTERS and base:
            out[cp] = LETTERS.index(base)
    out[ord("ß")] = LETTERS.index("s")
    return out


def lower_letters() -> np.ndarray:
    """Lower-case code point of each letter; a blank for anything else."""
    out = np.full(CODE_POINTS, ord(" "), np.uint32)
    for cp in range(CODE_POINTS):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    for cp in FULL_WIDTH:
        out[cp] = ord(unicodedata.normalize("NFKC", chr(cp)).lower())
    return out


def fold(text: str) -> str:
    """Lower-case, without diacritics."""
    plain = unicodedata.normalize("NFKD", text.lower().replace("ß", "s"))
    return "".join(c for c in plain if not unicodedata.combining(c))


# ------------------------------------------------------------- character model


def trigram_counts(df: DataFrame, text_col: str = "text") -> list[int]:
    """Counts of the symbol trigrams of all whole texts. Each task adds up its own and gives
    at most 27 ** 3 rows; the sum, as small, comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = letter_symbols().astype(np.int32)
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, codes, ends in blocks(batch.column(0)):
                s = np.insert(symbol[codes], np.concatenate([[0], ends]), SPACE)
                if len(s) > 2:
                    tri = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    total += np.bincount(tri, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"]
        )

    grams = df.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "gram int, n long")
    out = [0] * SYMBOLS**3
    for row in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third symbol given two, interpolated down to uniform."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in (n3.sum((0, 1)), n3.sum(0), n3):
        kinds = (n > 0).sum(-1, keepdims=True)
        p = (n + kinds * p) / np.maximum(n.sum(-1, keepdims=True) + kinds, 1) + (kinds == 0) * p
    return np.log(p)


# ------------------------------------------------------------- lexicon


def part_of(folds: int) -> Column:
    """The part of the sample a text is dealt to."""
    return F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(folds)).cast("int")


def context_counts(sample: DataFrame, folds: int = 1) -> DataFrame:
    """(word, n1, n0) from (text, label): in how many distinct contexts, the word before it, a
    word stands in toxic and in other text. Copies of a text add nothing. For each part k
    also `n1_k`, `n0_k`: the contexts that other parts have, too."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "), lambda w: w != "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("words")),
        lambda i: F.struct(
            F.element_at("words", i).alias("word"),
            F.when(i > 1, F.element_at("words", F.greatest(i - 1, F.lit(1)))).alias("before"),
        ),
    )
    # One bit per part, so that a context's parts add up.
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(folds)]), part_of(folds) + 1)
    each = (
        sample.select(words.alias("words"), "label", mask.alias("mask"))
        .filter(F.size("words") > 0)
        .select("label", "mask", F.explode(pairs).alias("p"))
        .select("label", "mask", "p.word", F.xxhash64("p.before").alias("before"))
        .filter(F.length("word").between(3, 40))
    )
    contexts = each.groupBy("word", "label", "before").agg(F.bit_or("mask").alias("mask"))
    counted = {f"n{y}": F.col("label") == y for y in (1, 0)}
    for k in range(folds if folds > 1 else 0):
        elsewhere = F.col("mask").bitwiseAND(F.lit(~(1 << k))) != 0
        counted |= {f"n{y}_{k}": (F.col("label") == y) & elsewhere for y in (1, 0)}
    return contexts.groupBy("word").agg(*[F.count_if(c).alias(n) for n, c in counted.items()])


def lexicon(words: DataFrame) -> dict[str, float]:
    """Features and their log-odds: whole words (`word `) and beginnings of words that stand
    in toxic text far more often than chance. Bounded, so it comes to the driver."""
    every = words.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    all1, all0 = every.n1 or 0, every.n0 or 0
    if not all1 or not all0:
        return {}
    parts = F.array_distinct(
        F.concat(
            F.array(F.concat("word", F.lit(" "))),
            F.filter(
                F.array(*[F.substring("word", 1, n) for n in PREFIXES]),
                lambda p: F.length(p) >= PREFIXES[0],
            ),
        )
    )
    each = words.select(F.explode(parts).alias("feature"), "n1", "n0").groupBy("feature")
    sums = each.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter("n1 >= 4")
    share = all1 / (all1 + all0)
    n = F.col("n1") + F.col("n0")
    plogp = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (plogp(F.col("n1"), n * share) + plogp(F.col("n0"), n * (1 - share)))
    odds = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))
    strong = sums.withColumn("g", g).withColumn("odds", odds)
    strong = strong.filter((F.col("g") >= EVIDENCE) & (F.col("odds") >= math.log(LIFT)))
    top = strong.orderBy(F.desc("g"), "feature").limit(LEXICON).collect()
    return {r.feature: min(CAP, r.odds) for r in top}


# ------------------------------------------------------------- decoding and scoring


@dataclass
class ToxicModel:
    """What scoring needs; small, and shipped with the tasks."""

    trigrams: list[int]
    features: dict[str, float]
    knots: tuple[list[float], list[float]] = ((0.0,), (0.1,))


class Scorer:
    """Finds disguised spots, restores them and adds up the lexicon's words."""

    def __init__(self, model: ToxicModel):
        counts = np.array(model.trigrams, np.float64)
        folded: dict[str, float] = defaultdict(float)
        for f, w in model.features.items():
            folded[fold(f)] = max(folded[fold(f)], w)
        # The prior of disguised words: the corpus, and the lexicon at a tenth of its weight.
        extra = np.zeros_like(counts)
        for f in folded:
            s = [SPACE, SPACE, *(LETTERS.index(c) if c in LETTERS else SPACE for c in f)]
            for a, b, c in zip(s, s[1:], s[2:]):
                extra[(a * SYMBOLS + b) * SYMBOLS + c] += 1
        if extra.sum():
            extra *= max(1.0, 0.1 * counts.sum() / extra.sum())
        self.logp = log_model(counts + extra).tolist()
        # Plain text is matched with its diacritics, restored text without.
        self.words, self.folded = _automaton(model.features), _automaton(folded)
        self.symbol = letter_symbols()
        self.kind = np.zeros(CODE_POINTS, np.uint8)  # 0 other, 1 letter, 2 may disguise, 3 drops
        self.kind[self.symbol < SPACE] = 1
        for c in SIGNS:
            if self.kind[ord(c)] == 0:
                self.kind[ord(c)] = 2
            if c.upper() != c and self.kind[ord(c.upper())] == 0:
                self.kind[ord(c.upper())] = 2
        for c in DROPPED:
            self.kind[ord(c)] |= 0 if self.kind[ord(c)] else 3
        self.plain = lower_letters()
        self.known: dict[str, tuple[str, ...]] = {}

    def spots(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges that look disguised: a sign inside a word or before it, a letter three times
        running, single letters in a row. A 0 stands before, between and after texts."""
        n = len(codes)
        if n < 3:
            return []
        kind = self.kind[codes]
        letter = kind == 1
        blank = codes <= 32
        sign = (kind >= 2) & ~letter
        word = letter | sign
        odd = np.zeros(n, bool)
        odd[1:-1] = sign[1:-1] & word[:-2] & word[2:] & (letter[:-2] | letter[2:])
        odd[1:-1] &= (codes[1:-1] != codes[:-2]) & (codes[1:-1] != codes[2:])
        odd[1:-1] |= (kind[1:-1] == 2) & blank[:-2] & letter[2:]
        odd[2:] |= letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
        single = np.zeros(n, bool)
        single[1:-1] = ~letter[:-2] & word[1:-1] & ~letter[2:] & ~blank[1:-1]
        between = ~word & (codes != 0)
        row = np.zeros(n, bool)
        row[4:] = single[4:] & single[2:-2] & single[:-4] & between[3:-1] & between[1:-3]
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(odd | row).tolist():
            if out and i < out[-1][1]:
                continue
            if row[i]:
                begin, end = i - 4, i + 1
                while end + 1 < n and single[end + 1] and between[end]:
                    end += 2
            else:
                begin, end = i, i + 1
                while not blank[begin - 1]:
                    begin -= 1
                while not blank[end]:
                    end += 1
            out.append((begin, end))
        return out

    def readings(self, spot: str) -> tuple[str, ...]:
        """What a spot may say: its likeliest word, and where single letters stand in a row
        also the likeliest words, with the signs between letters as possible word breaks."""
        if spot in self.known:
            return self.known[spot]
        out = (self.decode(spot),)
        if _spaced(fold(spot)):
            out = tuple(dict.fromkeys((*out, self._viterbi(spot, True))))
        if len(spot) <= LONGEST:
            if len(self.known) > 50_000:
                self.known = {}
            self.known[spot] = out
        return out

    def decode(self, spot: str) -> str:
        """The likeliest word behind a spot, in folded letters: Viterbi over the lattice of
        what each character may stand for. States are the last two letters."""
        return self._viterbi(spot, False)

    def _viterbi(self, spot: str, breaks: bool) -> str:
        text = fold(spot)
        spaced = _spaced(text)
        between = (("", COST_DROP), (" ", COST_DROP)) if spaced and breaks else (("", COST_DROP),)
        lattice: list[tuple[tuple[str, float], ...]] = []
        i = 0
        while i < len(text):
            c, run = text[i], 1
            while i + run < len(text) and text[i + run] == c:
                run += 1
            i += run
            if c in LETTERS:
                if run > 2:
                    lattice.append(((c, COST_RUN), (c + c, COST_RUN)))
                elif run == 2:
                    lattice.append(((c + c, 0.0), (c, COST_RUN)))
                else:
                    lattice.append(((c * run, 0.0),))
            elif c in SIGNS:
                arcs = [(x * min(run, 2), COST_LOOK) for x in SIGNS[c]]
                if c in DROPPED:
                    arcs.append(("", COST_DROP))
                lattice.append(tuple(arcs))
            elif c in DROPPED or (spaced and c in " /\\,;:"):
                lattice.append(between)
            else:
                lattice.append(((" ", 0.0),))
        # A path is a chain of what was said, last first: linear in the spot.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(SPACE, SPACE): (0.0, None)}
        for arcs in [*lattice, ((" ", 0.0),)]:
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, said) in best.items():
                for letters, channel in arcs:
                    x, y, total = a, b, cost + channel
                    for c in letters:
                        z = LETTERS.find(c) if c != " " else SPACE
                        total -= self.logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in step or total < step[x, y][0]:
                        step[x, y] = (total, (said, letters) if letters else said)
            best = step
        path, said = [], min(best.values(), key=lambda v: v[0])[1]
        while said is not None:
            said, letters = said
            path.append(letters)
        return "".join(reversed(path)).strip()

    def evidence(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of the log-odds of the lexicon's words in each text, plain and restored."""
        out = np.zeros(len(ends))
        if not len(self.words):
            return out
        codes = np.insert(codes, np.concatenate([[0], ends]), 0)
        place = ends + np.arange(1, len(ends) + 1)  # of the 0 after each text
        whole = self.plain[codes].tobytes().decode("utf-32-le")
        _add(self.words, whole, place, out)
        spots = self.spots(codes)
        owner = np.searchsorted(place, [b for b, _ in spots], side="right")
        for (begin, end), i in zip(spots, owner.tolist()):
            more = 0.0
            for restored in self.readings(codes[begin:end].tobytes().decode("utf-32-le", "surrogatepass")):
                found = np.zeros(1)
                _add(self.folded, f" {restored} ", np.array([len(restored) + 1]), found)
                more = max(more, found[0])
            if more:
                already = np.zeros(1)
                _add(self.words, f" {whole[begin:end]} ", np.array([end - begin + 1]), already)
                out[i] += max(0.0, more - already[0])
        return out


def _spaced(text: str) -> bool:
    """Whether all letters and digits stand alone."""
    return not any(a.isalnum() and b.isalnum() for a, b in zip(text, text[1:]))


def _automaton(features: dict[str, float]) -> ahocorasick.Automaton:
    """Finds each feature at the beginning of a word."""
    out = ahocorasick.Automaton()
    for f, w in features.items():
        out.add_word(" " + f, (len(f) + 1, w))
    if features:
        out.make_automaton()
    return out


def _add(words: ahocorasick.Automaton, text: str, place: np.ndarray, out: np.ndarray) -> None:
    """Adds each word's strongest feature to the text the word stands in; `place` has where
    the texts end."""
    best: dict[int, float] = {}
    for end, (length, weight) in words.iter(text):
        begin = end - length + 1
        if weight > best.get(begin, 0.0):
            best[begin] = weight
    if best:
        owner = np.searchsorted(place, np.fromiter(best, np.int64, len(best)), side="right")
        np.add.at(out, np.minimum(owner, len(out) - 1), np.fromiter(best.values(), float))


def _scorer(model: ToxicModel) -> Scorer:
    key = hashlib.sha256(repr((model.trigrams, model.features)).encode()).digest()
    return kept_by_worker("toxicity", key, lambda: Scorer(model))


def evidence_column(spark: SparkSession, model: ToxicModel):
    """Column function: text to its evidence. A null text counts as empty: 0."""
    shipped = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shipped.value)
        for texts in batches:
            got = [scorer.evidence(codes, ends) for _, codes, ends in blocks(texts)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0))

    weigh.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(weigh, "double")


def calibration(bins: list[tuple[float, int, int]]) -> tuple[list[float], list[float]]:
    """Knots of a rising curve from evidence to the share of label 1, from (evidence, label,
    rows): neighbours that do not rise are pooled, and a curve runs through the pools."""
    share: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, label, n in bins:
        share[x][0] += n
        share[x][1] += n * label
    pools: list[list[float]] = []  # rows, ones, least and most evidence
    for x in sorted(share):
        pools.append([*share[x], x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, ones, _, most = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + ones, pools[-1][2], most]
    xs, ps = [], []
    for n, ones, least, most in pools:
        p = (ones + 0.1) / (n + 0.2)
        for x in dict.fromkeys((least, most)):
            xs.append(x)
            ps.append(p)
    return xs, np.maximum.accumulate(ps).tolist()


def fit(
    corpus: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicModel:
    """Learns from `labelled` (text, label 0/1) and from the characters of all of `corpus`.

    The character model counts every text of the corpus. Lexicon and calibration are fitted on
    a sample of about `sample_rows` labelled rows, drawn by a hash of the text. The curve from
    evidence to score comes from rows that the lexicon weighing them has not seen: the sample
    is dealt into `FOLDS` parts, and each is weighed with what the others teach.
    Rows without a label are left out, null texts are empty. With labels of one kind only,
    the lexicon is empty and every score is the same, 0.1.
    """
    rows = labelled.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{label_col}`").cast("int").alias("label"),
    ).filter(F.col("label").isin(0, 1))
    keep = min(1.0, sample_rows / max(1, rows.count()))
    scale = 1 << 20
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < int(keep * scale))
    sample = stored(sample, "toxicity-sample")
    words = stored(context_counts(sample, FOLDS), "toxicity-words")
    model = ToxicModel(trigram_counts(corpus, text_col), lexicon(words.select("word", "n1", "n0")))
    part = part_of(FOLDS)
    bins = []
    for k in range(FOLDS if model.features else 0):
        seen = words.select("word", F.col(f"n1_{k}").alias("n1"), F.col(f"n0_{k}").alias("n0"))
        others = lexicon(seen)
        weigh = evidence_column(corpus.sparkSession, ToxicModel(model.trigrams, others))
        x = F.least(F.round(weigh("text") * 4) / 4, F.lit(200.0)).alias("x")
        bins += sample.filter(part == k).select("label", x).groupBy("x", "label").count().collect()
    if {r.label for r in bins} == {0, 1}:
        model.knots = calibration([(r.x, r.label, r["count"]) for r in bins])
    return model


def score_column(spark: SparkSession, model: ToxicModel):
    """Column function: text to its score from 0 to 1, linear between the knots."""
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shipped.value)
        xs, ps = shipped.value.knots
        for texts in batches:
            got = [scorer.evidence(codes, ends) for _, codes, ends in blocks(texts)]
            x = np.concatenate(got) if got else np.zeros(0)
            yield pa.array(np.interp(x, xs, ps))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def toxicity(df: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """Every row of `df` as a struct `row`, with `score` and `predicted` (1 from 0.5 on).

    The whole text counts. Spots that look disguised (signs in place of letters, signs or
    blanks between letters, letters repeated) are decoded and scored as what they restore
    to, on top of the plain words. Null and empty texts have the score of no evidence. Rows
    are independent; other columns pass in `row` whatever their names; nothing shuffles.
    """
    score = score_column(df.sparkSession, model)
    rows = df.select(F.struct("*").alias("row"), score(F.col(f"`{text_col}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents."""
    marks = labels.filter("toxic IS NOT NULL").select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(marks, "doc_id")


def is_held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % 5 == 0


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicModel:
    """The model learned from the labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~is_held_out(F.col("doc_id")))
    return fit(docs, labelled_documents(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity(docs, learned(spark, docs, sf_dir))
    doc_id = F.col("row.doc_id")
    return judged.select(doc_id, is_held_out(doc_id).alias("held_out"), "score", "predicted")
