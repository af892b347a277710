"""Toxicity, language, BPE, URL filter, sharding, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import bpe, language_id, mixing, queries, sharding, toxicity, url_filter

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def vocabulary():
    path = bpe.default_path()
    with open(path, "rb") as f:
        return bpe.Vocabulary(f.read()), tokenizers.Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "don't I'VE we'll 's", "İ ΣΑΣ ς ǅ ß ẞ", "<|startoftext|>a <|endoftext|>b", "a\x1cb\x85c"]
    out += ["日本語 한국어 हिन्दी", "🙂👍🏽", "__x__ ### ***", "ab " * 500, "a" * 3000, "é ñ ü"]
    out += ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    ranges = [(32, 126), (160, 0x2FF), (0x300, 0x36F), (0x370, 0x2FFF), (0x1F300, 0x1F6FF)]
    out += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(50)) for _ in range(300)]
    return out


def test_encoding_is_the_library_s(vocabulary):
    ours, library = vocabulary
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert ours.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_long_text_in_pieces(vocabulary, monkeypatch):
    ours, _ = vocabulary
    text = "some words, and 12 more\n" * 50
    want = ours.encode(text)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    assert ours.encode(text) == want


def test_no_word_ends():
    """The same encoder on a byte-level vocabulary without word ends."""
    with open(bpe.default_path().replace("word_bpe_49k", "byte_bpe_50k"), "rb") as f:
        blob = f.read()
    library, ours = tokenizers.Tokenizer.from_str(blob.decode()), bpe.Vocabulary(blob)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == want, text


def test_encode_and_decode_columns(spark, vocabulary):
    ours, library = vocabulary
    texts = [None, "", "hello, world", "x" * 5000, "Ünïcode"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = bpe.encode_table(df, bpe.default_path())
    back = bpe.decoder(spark, bpe.default_path())
    for r in got.select("row.doc_id", "ids", "n_tokens", back("ids").alias("text")).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.text == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_table(df.limit(0), bpe.default_path()).count() == 0


def test_op7_digests(spark, vocabulary):
    import hashlib

    _, library = vocabulary
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# ------------------------------------------------------------- language


def phrases_by_hand(sample, text):
    """Greedy parse into the longest pieces that occur in the sample."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing():
    rng = random.Random(3)
    samples = {
        "aa": "".join(rng.choice("abcd ") for _ in range(900)),
        "bb": "".join(rng.choice("cdef ") for _ in range(700)),
    }
    parser = language_id.Parser(samples)
    for _ in range(40):
        text = "".join(rng.choice("abcdefq ") for _ in range(rng.randint(1, 200)))
        folded = parser.fold(text)
        for lang, got in zip(parser.langs, parser.phrases(folded[:, None].astype(np.int32))[:, 0]):
            of = lambda s: "".join(chr(65 + x) for x in s)
            assert got == max(1, phrases_by_hand(of(parser.fold(samples[lang])), of(folded)))


def test_identify(spark):
    samples = {"en": "the house and the garden of the old man " * 20, "de": "das haus und der garten des alten mannes " * 20}
    rows = [
        (1, "The garden and the house"), (2, "Der Garten und das Haus"), (3, None), (4, ""), (5, "123 !!"),
        (6, "das haus " * 40_000), (7, "The garden and the house"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = {r.row.doc_id: r for r in language_id.identify(df, samples).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert got[3].score == 0 and 0.5 < got[6].score <= 1 and got[1].row.score == "x"
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}
    assert language_id.identify(df.limit(0), samples).count() == 0


#: Letters of a script, and how many of them a made-up language uses.
SCRIPTS = {
    "ar": (0x627, 28), "el": (0x3B1, 24), "hy": (0x561, 36), "ka": (0x10D0, 33), "ko": (0xAC00, 900),
    "ru": (0x430, 32), "zh": (0x4E00, 2000), "en": (0x61, 26), "th": (0xE01, 40),
}


def script_text(rng, lang, words=60):
    first, many = SCRIPTS[lang]
    word = lambda: "".join(chr(first + min(many - 1, int(rng.expovariate(6 / many)))) for _ in range(rng.randint(2, 7)))
    return " ".join(word() for _ in range(words))


def test_scripts_are_told_apart(spark):
    rng = random.Random(21)
    rows = [(n, script_text(rng, lang), lang) for n, lang in enumerate([*SCRIPTS] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.labelled_sample(df.filter("doc_id < 180"), "text", "lang")
    assert sorted(samples) == sorted(SCRIPTS)
    for r in language_id.identify(df.filter("doc_id >= 180"), samples).collect():
        assert r.lang_pred == r.row.lang


def test_languages_of_long_documents_are_learned(spark):
    """Documents longer than a sample count as others do."""
    rng = random.Random(22)
    words = {"en": "the house and garden of old man with".split(), "de": "das haus und der garten alten mannes mit".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(n, text("en", 40), "en") for n in range(30)] + [(100 + n, text("de", 12_000), "de") for n in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.labelled_sample(df, "text", "lang")
    assert all(0 < len(t) <= language_id.SAMPLE_CHARS for t in samples.values())
    again = language_id.labelled_sample(df.repartition(7), "text", "lang")
    assert sorted(samples) == ["de", "en"] and samples == again
    assert all(r.lang_pred == r.row.lang for r in language_id.identify(df, samples).collect())


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = queries.QUERIES["op5_language_id"](spark, SF.replace("0.001", "0.01"))
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").collect()
    assert got.count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(out) / len(out) > 0.97


# ------------------------------------------------------------- toxicity


def test_decoding():
    words = "idiot scum moron trash clown loser worthless disgusting pathetic stupid".split()
    counts = [0] * 27**3
    text = " the thing and this other one is on the road to town and back "
    sym = [toxicity.LETTERS.find(c) if c != " " else 26 for c in text * 50]
    for a, b, c in zip(sym, sym[1:], sym[2:]):
        counts[(a * 27 + b) * 27 + c] += 1
    model = toxicity.ToxicModel(counts, {w + " ": 5.0 for w in words})
    scorer = toxicity.Scorer(model)
    disguised = "1d10t id1ot st*pid stuuupid w0rthl3ss $cum s.c.u.m d1sgust1ng p@thetic tr4sh cl0wn l-o-s-e-r M0R0N".split()
    for spot in [*disguised, "i d i o t", "1 d 1 0 t", "M O R O N", "l o s e r"]:
        for text in (f"so {spot} there", f"{spot}", f"a\n{spot}\nb"):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            assert scorer.evidence(codes, np.array([len(codes)]))[0] == 5.0, spot
    for clean in ("a b c d e", "the 3rd of 100 things", "idio ts", "t-shirt", "e.g. this", "www.ththe.com"):
        codes = np.frombuffer(clean.encode("utf-32-le"), np.uint32)
        assert scorer.evidence(codes, np.array([len(codes)]))[0] == 0, clean


def test_letter_spaced_phrases():
    """The model puts word breaks back, and a long spot is read in one piece."""
    words = "idiot scum moron trash clown loser worthless disgusting pathetic stupid".split()
    counts = [0] * 27**3
    text = " you are an idiot and a moron i see what a loser you are y o a you are "
    sym = [toxicity.LETTERS.find(c) if c != " " else 26 for c in text * 50]
    for a, b, c in zip(sym, sym[1:], sym[2:]):
        counts[(a * 27 + b) * 27 + c] += 1
    scorer = toxicity.Scorer(toxicity.ToxicModel(counts, {w + " ": 5.0 for w in words}))

    def evidence(spot):
        codes = np.frombuffer(spot.encode("utf-32-le"), np.uint32)
        return scorer.evidence(codes, np.array([len(codes)]))[0]

    phrases = "a i d i o t", "y m o r o n", "o l o s e r", "y o u i d i o t", "w h a t a l o s e r y o u a r e"
    for spot in (*phrases, "a 1 d 1 0 t", "a . m . o . r . o . n"):
        assert evidence(spot) == 5.0, spot
    assert evidence(" ".join("youareanidiotandamoron")) == 10.0
    for lead in range(1, 60):  # wherever a cut could fall
        assert evidence("x-" * lead + "x 1d10t") == 5.0
        assert evidence(" ".join("youare" * lead + "amoron")) == 5.0, lead
    assert evidence(" ".join("youare")) == 0


def test_letters_of_other_scripts_and_unseen_characters():
    """Look-alike letters, wide forms and characters that are not drawn hide no word, and
    texts in other scripts stay as they are."""
    words = "idiot scum moron trash clown loser worthless disgusting pathetic stupid".split()
    counts = [0] * 27**3
    text = " you are an idiot and a moron i see what a loser you are "
    sym = [toxicity.LETTERS.find(c) if c != " " else 26 for c in text * 50]
    for a, b, c in zip(sym, sym[1:], sym[2:]):
        counts[(a * 27 + b) * 27 + c] += 1
    scorer = toxicity.Scorer(toxicity.ToxicModel(counts, {w + " ": 5.0 for w in words}))

    def evidence(text):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return scorer.evidence(codes, np.array([len(codes)]))[0]

    wide = "".join(chr(ord(c) + 0xFEE0) for c in "idiot")
    hidden = ["idi\u200bot", "id\u00adiot", "st\u2060upid", "mor\u043en", "l\u043eser", "IDI\u041eT", "m\u03bfron", wide, wide.upper(), "1d\u200biot", "st\u200buppid"]
    for spot in hidden:
        assert evidence(f"so {spot} there") == 5.0, ascii(spot)
    for clean in ("это просто текст о том о сем", "και το κείμενο", "co\u00adoperate with them", "Хороший день for all"):
        assert evidence(clean) == 0, clean


def test_score_is_the_curve_over_the_evidence(spark):
    """Brute force: each word's strongest feature, summed, read off the calibration curve."""
    features = {"moron ": 4.0, "stupid": 3.0, "stupidly ": 5.0, "trash ": 2.0}
    model = toxicity.ToxicModel([0] * 27**3, features, ([0.0, 4.0, 9.0], [0.1, 0.5, 0.9]))
    texts = ["a moron", "Stupidly said, moron!", "stupidity and trash", "trashy morons", "", None, "TRASH trash"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def by_hand(text):
        total = 0.0
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            total += max([w for f, w in features.items() if (word + " ").startswith(f)], default=0.0)
        return float(np.interp(total, *model.knots))

    for r in toxicity.toxicity(df, model).collect():
        assert r.score == pytest.approx(by_hand(texts[r.row.doc_id])) and r.predicted == (r.score >= 0.5)


def test_evidence_of_a_small_sample(spark):
    """Brute force of context counts: distinct words before a word, by label."""
    rows = [("you moron you moron", 1), ("you moron", 1), ("a moron and a day", 0), ("day", 1), ("", 0)]
    got = {r.word: (r.n1, r.n0) for r in toxicity.context_counts(spark.createDataFrame(rows, "text string, label int")).collect()}
    # you: first and after moron; moron: after you, after a; and: after moron; day: first, after a.
    assert got == {"you": (2, 0), "moron": (1, 1), "and": (0, 1), "day": (1, 1)}
    # What the other parts teach equals what is counted without a part.
    rng = random.Random(3)
    many = [(" ".join(rng.choices("you moron and day the a".split(), k=6)), rng.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(many, "text string, label int")
    every = {r.word: r for r in toxicity.context_counts(df, 3).collect()}
    for k in range(3):
        rest = toxicity.context_counts(df.filter(toxicity.part_of(3) != k)).collect()
        assert {r.word: (r.n1, r.n0) for r in rest} == {w: (r[f"n1_{k}"], r[f"n0_{k}"]) for w, r in every.items()}


def test_viterbi_is_the_best_path():
    """Against all paths of small lattices."""
    from itertools import product

    rng = random.Random(6)
    counts = [rng.randint(0, 30) for _ in range(27**3)]
    scorer = toxicity.Scorer(toxicity.ToxicModel(counts, {"word ": 1.0}))

    def cost(parts):
        total, a, b = 0.0, 26, 26
        for letters, channel in [*parts, (" ", 0.0)]:
            total += channel
            for c in letters:
                z = toxicity.LETTERS.find(c) if c != " " else 26
                total -= scorer.logp[a][b][z]
                a, b = b, z
        return total

    for spot in ("1a0b", "x1y!", "a*b1", "8o9", "|e|"):
        arcs = []
        for c in spot:
            look = [(x, toxicity.COST_LOOK) for x in toxicity.LOOKS_LIKE.get(c, "")]
            drop = [("", toxicity.COST_DROP)] if c in toxicity.DROPPED else []
            arcs.append([(c, 0.0)] if c in toxicity.LETTERS else look + drop)
        best = min(product(*arcs), key=cost)
        assert scorer.decode(spot) == "".join(x for x, _ in best)


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_toxicity"](spark, sf).collect()
    held = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    hit = [r.predicted for r in held if labels[r.doc_id] == 1]
    alarm = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(hit) / len(hit) > 0.9 and sum(alarm) / len(alarm) < 0.02


def test_toxicity_edges(spark):
    rows = [(1, "fine words here and there", 0), (2, None, 0), (3, "", None), (4, "more fine words", 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic int, score string")
    model = toxicity.fit(df, df)  # one kind of label only
    got = toxicity.toxicity(df, model).collect()
    assert {(r.predicted, r.row.score) for r in got} == {(0, "x")} and len(got) == 4
    empty = toxicity.fit(df.limit(0), df.limit(0))
    assert toxicity.toxicity(df.limit(0), empty).count() == 0


def test_calibration_rises():
    xs, ps = toxicity.calibration([(0, 0, 90), (0, 1, 3), (2, 0, 10), (5, 1, 4), (5, 0, 4), (9, 1, 20)])
    assert xs == sorted(xs) and ps == sorted(ps) and ps[0] < 0.1 and ps[-1] > 0.9


# ------------------------------------------------------------- urls

URLS = [
    "https://a.example.org/es/1", "http://example.org/en/12?x=1", "http://EXAMPLE.org/en/2", "https://b.com/fr/x#f",
    "https://com/fr/", "https://c.com/de/9", "https://d.net/x", "https://org", "https://org/", "no scheme", None, "",
    "https://notorg/", "https://x.org?y=/z", "http://a://b/c", "https://a.example.org/es/1", "http://ü.org/ß",
    "https://d.net/" + "x" * 50_000, "ftp://h#/p", "https://a.b.com/de/", "https://a.b.com/DE/",
]


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:end]


def rule_by_hand(host, path):
    fits = []
    for action, rule in url_filter.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, action))
    return max(fits, default=(0, None, None))[1:]


def grams_by_hand(url):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    s = "".join("0" if "0" <= c <= "9" else c if c in url_filter.SYMBOLS else "*" for c in s)
    s = "^^^" + s + "$"
    return [s[i - 3 : i + 1] for i in range(3, len(s))]


def model_by_hand(urls):
    counts = Counter(g[3 - k :] for u in urls for g in grams_by_hand(u) for k in range(4))
    follow = defaultdict(list)
    for g, n in counts.items():
        follow[g[:-1]].append(n)

    def p(gram):
        out = 1 / url_filter.ALPHABET
        for k in range(4):
            g = gram[3 - k :]
            if follow[g[:-1]]:
                kinds, total = len(follow[g[:-1]]), sum(follow[g[:-1]])
                out = (counts[g] + kinds * out) / (total + kinds)
        return out

    return p


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.row.page_id: r for r in url_filter.url_filter(df).collect()}
    assert len(got) == len(URLS)
    accepted, rejected = [], []
    for i, url in enumerate(URLS):
        host, path = parts_by_hand(url)
        rule, action = rule_by_hand(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == action or action is None
        if action:
            (accepted if action == "allow" else rejected).append(url)
    a, r = model_by_hand(accepted), model_by_hand(rejected)
    for i, url in enumerate(URLS):
        grams = grams_by_hand(url)
        want = sum(math.log(a(g)) - math.log(r(g)) for g in grams) / len(grams)
        assert got[i].score == pytest.approx(want, abs=1e-9), url
    assert got[0].row.host == "h"


def test_url_verdicts_follow_the_models(spark):
    rng = random.Random(8)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    good = [f"https://{word('abcde')}.org/{word('abc')}" for _ in range(120)]
    bad = [f"https://{word('vwxyz')}.com/de/{word('xyz')}" for _ in range(120)]
    test = [f"https://{word('abcde')}.net/{word('abc')}" for _ in range(30)]
    test += [f"https://{word('vwxyz')}.net/de/{word('xyz')}" for _ in range(30)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + test)], "page_id long, url string")
    got = {r.row.page_id: r.verdict for r in url_filter.url_filter(df).collect()}
    assert [got[240 + i] for i in range(60)] == ["allow"] * 30 + ["block"] * 30


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "https://x.net/"), (2, None)], "page_id long, url string")
    assert {(r.score, r.verdict) for r in url_filter.url_filter(df).collect()} == {(0.0, "allow")}
    assert url_filter.url_filter(df.limit(0)).count() == 0


# ------------------------------------------------------------- shards

NAMED = "doc_id long, text string, source string, size string, shard int, k1 int, block int"


def sized(spark, rows):
    return spark.createDataFrame([(*r, "s", -1, -2, -3) for r in rows], NAMED)


def test_shards(spark):
    rng = random.Random(7)
    rows = [(i, "ä" * rng.randint(0, 400), "a") for i in range(500)]
    rows += [(i, "common text " * 9, "a") for i in range(600, 900)]  # a hot text
    rows += [(None, None, "a"), (None, "", "a"), (5, rows[5][1], "a")]
    got = sharding.shard_rows(sized(spark, rows), 7).collect()
    assert len(got) == len(rows)
    size = {s: 0 for s in range(7)}
    for r in got:
        text = r.row.text or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert (r.row.size, r.row.shard) == ("s", -1)
        size[r.shard] += r.size
    mean, most = sum(size.values()) / 7, max(r.size for r in got)
    assert all(abs(s - mean) <= most for s in size.values())
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    place = sorted((r.shard, r.slot, r.row.text or "") for r in got)
    seen = [t for i, (_, _, t) in enumerate(place) if i == 0 or place[i - 1][2] != t]
    assert len(seen) == len(set(seen))  # copies of a text are neighbours


def test_small_groups_of_copies_are_not_cut_apart(spark):
    """Triples of equal texts: each cut moves to the nearer end of the group it falls into."""
    rows = [(i, f"{i % 900:04d}" * 5, "a") for i in range(2700)]
    got = sharding.shard_rows(sized(spark, rows), 7).collect()
    homes, size = defaultdict(set), Counter()
    for r in got:
        homes[r.row.text].add(r.shard)
        size[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert max(size.values()) - min(size.values()) <= 2 * 3 * 36
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_a_hot_text_is_cut(spark):
    rows = [(i, "the same text", "a") for i in range(300)] + [(300 + i, f"other {i}", "a") for i in range(300)]
    size = Counter()
    for r in sharding.shard_rows(sized(spark, rows), 6).collect():
        size[r.shard] += r.size
    assert len(size) == 6 and max(size.values()) - min(size.values()) <= 2 * 29


def test_shards_of_little(spark):
    assert sharding.shard_rows(sized(spark, [])).count() == 0
    (row,) = sharding.shard_rows(sized(spark, [(1, "x", "a")])).collect()
    assert 0 <= row.shard < 40 and row.slot == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, "t" * i, "a") for i in range(50)]
    out = sharding.write_shards(sized(spark, rows), f"file://{tmp_path}/out", 4)
    assert out.count() == 50 and {r.shard for r in out.select("shard").collect()} == {0, 1, 2, 3}


def test_write_shards_keeps_null_empty_and_hot_texts(spark, tmp_path):
    """Every row once, in its shard, in the order of its slot; columns may clash."""
    rows = [(None, None, "a"), (1, "", None), (2, None, "b"), (3, "x" * 9000, "b")]
    rows += [(10 + i, "the same text " * 5, "hot") for i in range(120)] + [(10, "the same text " * 5, "hot")]
    df = sized(spark, rows).withColumn("shard", F.lit(7)).withColumn("slot", F.lit("s"))
    out = sharding.write_shards(df, f"file://{tmp_path}/out", 5).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.source or "", r.shard, r.slot)
    assert sorted(map(key, (r.row for r in out))) == sorted(map(key, df.collect()))
    for shard in range(5):
        mine = [r.slot for r in out if r.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert sum(sizes.values()) == sum(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert sharding.write_shards(df.limit(0), f"file://{tmp_path}/none", 5).count() == 0


# ------------------------------------------------------------- mixing


def targets_by_hand(sizes):
    """Shares by weight, the excess over the caps shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def mixed_rows():
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", "c", "é"])) for i in range(300)]
    rows += [(400, "tiny one", "z"), (401, "no source " * 30, None), (402, None, "a"), (None, "no id " * 8, "b")]
    return rows + [(7, rows[7][1], rows[7][2]), (500, "", "nothing"), (501, "long " * 20_000, "c")]


def test_mixing_plan(spark):
    rows = mixed_rows()
    df = sized(spark, rows)
    got = mixing.mixing_plan(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets_by_hand(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    taken = Counter()
    for r in got:
        taken[names[r.place]] += r.taken
        assert r.source_size == sizes[names[r.place]]
        assert r.target == pytest.approx(want[names[r.place]])
        assert 0 <= r.taken <= 3 * r.size
    for s in names:
        assert taken[s] == math.floor(want[s] + 1e-9)
    key = lambda r: (r.place, r.nth, r.id, r.size, r.taken)
    again = mixing.mixing_plan(df.repartition(5)).collect()
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, got)))


def test_schedule_is_even(spark):
    """In any stretch of the schedule each source has about its share of slots."""
    sources = spark.createDataFrame(
        [(False, f"s{i}", i, 1, w, float(w), w) for i, w in enumerate((5000, 2000, 1000, 137))],
        "no_source boolean, source_key string, place int, weight long, source_size long, target double, wanted long",
    )
    slots = mixing.schedule(spark, sources, 8137, 4).orderBy("slot").collect()
    for place, wanted in enumerate((5000, 2000, 1000, 137)):
        mine = [r for r in slots if r.place == place]
        assert sorted(r.block for r in mine) == list(range(-(-wanted // 4)))
        assert [r.block for r in mine] == sorted(r.block for r in mine)
        for n in range(100, 2000, 150):
            have = sum(r.place == place for r in slots[:n])
            assert abs(have - n * wanted / 8137) < 5


def test_mix(spark):
    rows = mixed_rows()
    df = sized(spark, rows + [rows[9], rows[9]])  # rows alike in every column
    out = mixing.mix(df)
    assert out.columns == ["slot", "offset", "row"] and out.select("row.*").columns == df.columns
    plan = Counter()
    for r in mixing.mixing_plan(df).collect():
        plan[r.id] += r.taken
    words = Counter()
    for r in out.select("row.*").collect():
        words[r.doc_id] += len(r.text.split())
        assert (r.size, r.k1, r.block) == ("s", -2, -3)
    assert words == Counter({k: v for k, v in plan.items() if v})
    again = mixing.mix(df.repartition(7)).collect()
    assert again == out.collect()


def many_rows():
    rng = random.Random(13)
    sizes = {"a": 900, "b": 500, "c": 400}
    return [(n, "w " * rng.randint(1, 30), s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]


def test_mix_comes_in_an_even_order(spark):
    """What mix() returns is in schedule order: any stretch has about each source's share."""
    df = sized(spark, many_rows())
    out = [(r.slot, r.offset, r.row.source, len(r.row.text.split())) for r in mixing.mix(df).collect()]
    assert [o[:2] for o in out] == sorted(o[:2] for o in out) and len({o[:2] for o in out}) == len(out)
    total = sum(o[3] for o in out)
    share = Counter()
    for _, _, source, n in out:
        share[source] += n / total
    seen, sofar = Counter(), 0
    for _, _, source, n in out:
        seen[source] += n
        sofar += n
        if sofar < 0.9 * total:
            assert all(abs(seen[s] - sofar * share[s]) < 200 for s in share)


def test_the_schedule_decides_places(spark, monkeypatch):
    df = sized(spark, many_rows()[::9])
    keys = ["id", "taken", "first_slot", "slot_offset"]
    before = sorted(map(str, mixing.mixing_plan(df).select(*keys).collect()))
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).withColumn("slot", F.lit(0).cast("long")))
    assert sorted(map(str, mixing.mixing_plan(df).select(*keys).collect())) != before
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).filter("block > 0"))
    assert sorted(map(str, mixing.mixing_plan(df).select("taken").collect())) != before


def test_a_row_is_told_from_its_twin_by_all_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b c", "s", {"x": i}) for i in range(4)], "doc_id long, text string, source string, extra map<string,int>"
    )
    out = mixing.mix(df).select("row.*").collect()
    assert sorted(r.extra["x"] for r in out) == [0, 1, 2, 3]


def test_mixing_nothing(spark):
    assert mixing.mixing_plan(sized(spark, [])).count() == 0
    assert mixing.mix(sized(spark, [])).count() == 0
    (row,) = mixing.mixing_plan(sized(spark, [(1, None, None)])).collect()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)


# ------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == names, name
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= ids
        ids = now
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, labels without documents."""
    rows = {
        "doc_id": [1, 2, None, 4, 4, 6],
        "text": ["some words", None, "no id", "", "", "long " * 50_000],
        "lang": ["en", None, None, "en", "en", "de"],
        "source": ["a", "b", None, "c", "c", None],
        "n_chars": [10, None, 5, 0, 0, 250_000],
    }
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("text", "lang", "source")), ("n_chars", pa.int64())])
    pq.write_table(pa.table(rows, schema), tmp_path / "documents.parquet")
    labels = pa.table({"doc_id": [1, 99, 6], "quality": [1, 0, 1], "toxic": [0, 1, 0]})
    pq.write_table(labels, tmp_path / "labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, None, 6} and got
    pq.write_table(pa.table({c: [] for c in rows}, schema), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
