"""Token counts and the piece codec against another implementation of the unigram model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternflow.llm import piece_codec, token_counts, vocabulary

from .conftest import ROWS

MARKER = vocabulary.MARKER


@pytest.fixture(scope="module")
def pieces():
    return vocabulary.load()


@pytest.fixture(scope="module")
def other(pieces):
    from tokenizers import Tokenizer, models

    table = [(p, pieces.scores.get(i, 0.0)) for i, p in enumerate(pieces.pieces)]
    return Tokenizer(models.Unigram(table, unk_id=pieces.unknown, byte_fallback=True))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    alphabet = "aàé  \n\tñ中😀thein▁g0123.,!"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    return made + [t for _, t, *_ in ROWS if t] + ["", " ", "  ", "\n", "\n\n a", "a" * 3000, "😀" * 200, "▁▁x ▁"]


def expected(other, text):
    return other.encode(MARKER + text.replace(" ", MARKER)).ids if text else []


def test_encoding_counts_and_decoding(pieces, other, texts):
    encoder = piece_codec.Encoder(pieces, piece_codec.build_trie(pieces))
    decoder, counts = piece_codec.Decoder(pieces), token_counts.SegmentCounts(pieces)
    ids, n = encoder.encode(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        want = expected(other, text)
        assert mine.tolist() == want
        assert counts.of(text) == len(want)
        assert decoder.decode(mine) == text.replace(MARKER, " ")


def test_ties_go_to_the_piece_that_starts_first():
    from tokenizers import Tokenizer, models

    table = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abb", -3.0), ("bb", -2.0), (MARKER, -1.0), (MARKER + "a", -2.0)]
    tied = vocabulary.Vocabulary(tuple(p for p, _ in table), {i: s for i, (_, s) in enumerate(table) if i}, (), 0)
    reference = Tokenizer(models.Unigram(table, unk_id=0, byte_fallback=False))
    encoder = piece_codec.Encoder(tied, piece_codec.build_trie(tied))
    counts = token_counts.SegmentCounts(tied)
    for n in range(1, 8):
        for k in range(2**n):
            text = "".join("ab"[k >> j & 1] for j in range(n))
            want = expected(reference, text)
            assert encoder.encode([text])[0].tolist() == want
            assert counts.of(text) == len(want)


def test_forgetting_changes_nothing(pieces, texts, monkeypatch):
    trie = piece_codec.build_trie(pieces)
    want = piece_codec.Encoder(pieces, trie).encode(texts)
    monkeypatch.setattr(piece_codec, "REMEMBERED", 10)
    monkeypatch.setattr(piece_codec, "ROUND", 50)
    got = piece_codec.Encoder(pieces, trie).encode(texts)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_tables(spark, pieces, other, messy, nothing):
    encoded = piece_codec.encode(messy, pieces)
    back = encoded.withColumn("text", piece_codec.decoded(encoded, pieces)).collect()
    key = lambda x: (repr(x[0]), x[1])
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(
        ((i, (t or "").replace(MARKER, " ")) for i, t, *_ in ROWS), key=key
    )
    counted = token_counts.count_tokens(messy, pieces)
    assert sorted(map(repr, counted.collect())) == sorted(
        map(repr, encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens")).collect())
    )
    assert piece_codec.encode(nothing, pieces).count() == token_counts.count_tokens(nothing, pieces).count() == 0


def test_odd_ids_decode(spark, pieces):
    lists = [None, [], [None, 5], [-1, 10**6, 0, 1], [pieces.bytes_[0xC3], pieces.bytes_[0xA9]], [pieces.bytes_[0xC3]]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>")
    got = [r[0] for r in df.orderBy("n").select(piece_codec.decoded(df, pieces)).collect()]
    assert got == [None, "", "\x02", "", "é", "�"]


def test_pieces_across_segments_are_refused():
    odd = vocabulary.Vocabulary(("<unk>", "a" + MARKER + "b"), {1: -1.0}, (), 0)
    with pytest.raises(ValueError, match="reach over"):
        vocabulary.check_segmentable(odd)
