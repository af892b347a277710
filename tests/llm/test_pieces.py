"""Op 12 against the library that piece models are made for."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from hourloom.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    path = pieces.default_path()
    with open(path, "rb") as f:
        return pieces.PieceModel(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(library):
    rng = random.Random(5)
    letters = "".join(library.id_to_piece(i) for i in range(259, library.get_piece_size()))
    out = ["", *(" " * n + "the" + " " * k + "x" for n in range(9) for k in range(9))]
    out += ["\n\n a\tb\r\n  c", "<s> a </s> <unk> <0x41>", "▁▁ ▁a", "😀 x\x00y", "日本語 한국어 " * 30]
    out += ["a" * 3000, "the" * 1000, "x" + " " * 500]
    out += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(2000)]
    out += ["".join(rng.choices("abdehint ▁\n", k=rng.randint(1, 50))) for _ in range(2000)]
    return out


def test_ids_and_texts(both):
    ours, library = both
    for text in odd_texts(library):
        want = library.encode(text)
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert ours.decode(ids).decode() == library.decode(want)


def test_any_ids_decode(both):
    ours, library = both
    rng = random.Random(6)
    few = [*range(263), 13, 260]
    for n in range(3000):
        ids = rng.choices(few if n % 2 else range(32000), k=rng.randint(1, 8))
        got = ours.decode(np.array(ids, "<u4").tobytes()).decode()
        assert got == library.decode(ids), ids


def test_forgetting_words_changes_nothing(both, monkeypatch):
    _, library = both
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 5)
    with open(pieces.default_path(), "rb") as f:
        ours = pieces.PieceModel(f.read())
    for text in odd_texts(library)[-200:]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


def test_columns(spark, both):
    _, library = both
    texts = [None, "", "hello, world", "x" * 5000, "Ünïcode 日本", "hello, world"]
    df = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int"
    )
    path = pieces.default_path()
    got = pieces.encode_table(df, path)
    back = pieces.decoder(spark, path)
    rows = got.select("row.doc_id", "row.ids", got.ids.alias("found"), "n_tokens", back("ids").alias("text"))
    for r in rows.collect():
        want = library.encode(texts[r.doc_id] or "")
        assert (r.found, r.n_tokens, r.ids) == (want, len(want), 1)
        assert r.text == library.decode(want)
    assert pieces.encode_table(df.limit(0), path).count() == 0


def test_op12_digests(spark, both):
    _, library = both
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
