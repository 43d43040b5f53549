"""Language ID, quality classifier and language model: held-out accuracy, brute force, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patternflow.llm import context_mixing, language_id, quality_classifier, word_unigrams
from patternflow.llm.common import fold
from patternflow.llm.queries import QUERIES

from .conftest import ROWS, frame

TABLES = "/root/testdata/sf0.01"


def test_language_on_the_held_out_fold(spark):
    truth = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language_id"](spark, TABLES).join(truth, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert [r["held_out"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_chunks_do_not_change_counts(spark):
    texts = ["Ein Text, der länger ist. " * 40, "", None, "kürzer", "x" * 700]
    whole = [language_id._hashed(c) for c in language_id._chunks(texts, 1 << 20)]
    cut = [language_id._hashed(c) for c in language_id._chunks(texts, 97)]
    count = lambda parts: Counter((int(t), int(b)) for bs, ts, _ in parts for b, t in zip(bs, ts, strict=True))
    assert count(whole) == count(cut)


def test_language_scores_match_naive_bayes_by_hand(spark):
    train = frame(spark, [(1, "aab", "x", None), (2, "bbc", "y", None), (3, "bcb", "y", None), (4, None, "y", None), (5, "q", None, None)])
    model = language_id.train(train)
    assert model.languages == ("x", "y")

    def grams(text):
        return [b for bs, _, _ in map(language_id._hashed, language_id._chunks([text])) for b in bs.tolist()]

    counts = {"x": Counter(grams("aab")), "y": Counter(grams("bbc") + grams("bcb"))}
    logs = []
    for lang, docs in (("x", 1), ("y", 2)):
        n = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
        logs.append(math.log(docs / 3) + sum(math.log((counts[lang][g] + language_id.SMOOTHING) / n) for g in grams("abb")))
    want = math.exp(max(logs)) / sum(map(math.exp, logs))
    got = language_id.identify(frame(spark, [(7, "abb", None, None)]), model).first()
    assert got["lang_pred"] == ["x", "y"][int(np.argmax(logs))]
    assert got["score"] == pytest.approx(want, rel=1e-4)


def test_language_of_messy_and_empty_tables(spark, messy, nothing):
    model = language_id.train(messy)
    got = {repr(r["doc_id"]): r for r in language_id.identify(messy, model).collect()}
    for i in (3, 4, 5):
        assert (got[repr(i)]["lang_pred"], got[repr(i)]["score"]) == ("und", 0.0)
    empty = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.identify(messy, empty).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_quality_on_the_held_out_fold(spark):
    truth = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op5_quality_classifier"](spark, TABLES).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    bad = [r["score"] for r in got if r["quality"] == 0]
    good = [r["score"] for r in got if r["quality"] == 1]
    assert sum(b < g for b in bad for g in good) >= 0.98 * len(bad) * len(good)


def test_quality_of_messy_and_empty_tables(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(messy, labels)
    got = quality_classifier.score(messy, model)
    assert got.count() == len(ROWS)
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    none = quality_classifier.train(messy, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(messy, none).collect()} == {0.5}
    assert quality_classifier.score(nothing, model).count() == 0


def test_training_sample_is_bounded(spark, messy):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    assert np.any(quality_classifier.train(messy, labels, most_rows=3).weights)
    assert not np.any(quality_classifier.train(messy, labels, most_rows=0).weights)


def base_by_hand(rows, trained):
    words = [(t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() for t in rows]
    c, ends = Counter(), 0
    for w, t in zip(words, trained, strict=True):
        if t:
            c.update(w)
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + (ends > 0)
    log_total = math.log10(total + 0.5 * (distinct + 1))
    return [
        (
            len(w) + 1,
            sum(x in c for x in w) + (ends > 0),
            total,
            sum(math.log10(c[x] + 0.5) for x in w) + math.log10(ends + 0.5) - (len(w) + 1) * log_total,
        )
        for w in words
    ]


@pytest.mark.parametrize("common", [2, word_unigrams.COMMON])
def test_base_score_by_hand(spark, messy, monkeypatch, common):
    monkeypatch.setattr(word_unigrams, "COMMON", common)
    monkeypatch.setattr(context_mixing, "train", lambda docs, weights: context_mixing.MixingModel(context_mixing.huffman(weights), UNTAUGHT))
    trained = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = context_mixing.score_documents(messy, trained=trained).collect()
    want = base_by_hand([t for _, t, *_ in ROWS], [i is not None and i % 2 == 0 for i, *_ in ROWS])
    key = lambda x: (repr(x[0]), x[1:3], round(x[4], 6))
    assert sorted(
        ((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], pytest.approx(r["base_score"])) for r in got),
        key=lambda x: key((*x[:4], x[4].expected)),
    ) == sorted(((i, *w) for (i, *_), w in zip(ROWS, want, strict=True)), key=key)


UNTAUGHT = np.tile(context_mixing._packed(np.zeros((1, 2))), (context_mixing.CONTEXTS, context_mixing.SLOTS))


def taught(texts):
    code = context_mixing.huffman(np.ones(257))
    tables = np.zeros((context_mixing.CONTEXTS, context_mixing.SLOTS * 2), np.int32)
    context_mixing._counted(code, pa.array(texts), tables)
    return context_mixing.MixingModel(code, np.stack([context_mixing._packed(t.reshape(-1, 2)) for t in tables]))


def test_next_bytes_share_one():
    """After any beginning the probabilities of all bytes and the end add up to one."""
    model = taught(["the cat sat on the mat", "the dog sat"] * 20)
    for begin in (b"", b"the ", b"the cat sat on the mat and the dog " * 3):
        total = 0.0
        for symbol in range(257):
            symbols = np.array([*begin, symbol], np.int32)
            weights = np.full((context_mixing.CONTEXTS, 16), context_mixing.FIRST_WEIGHT / context_mixing.STEP, np.float32)
            stretch = lambda s: context_mixing.Stretch(s, np.array([0]), np.array([len(s)]))
            whole = context_mixing.Mixer(model)._cost(stretch(symbols), weights.copy())[0]
            before = context_mixing.Mixer(model)._cost(stretch(symbols[:-1]), weights.copy())[0] if begin else 0.0
            total += math.exp(before - whole)
        assert total == pytest.approx(1, rel=1e-3)


def test_texts_do_not_touch_each_other():
    model = taught(["the cat sat on the mat", "the dog sat"] * 20)
    texts = ["the cat sat", None, "", "a dog " * 5000, "THE CAT SAT", "zzz"]
    together = context_mixing.Mixer(model).score(pa.array(texts))
    alone = [context_mixing.Mixer(model).score(pa.array([t], pa.string()))[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)
    assert together[0] == pytest.approx(together[4])
    assert together[0] > together[5] * 3


def test_model_on_the_held_out_fold(spark):
    """Two megabytes teach words better than bytes; the byte model is ahead from ten times that."""
    got = QUERIES["op8_context_mixing"](spark, TABLES).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 1.03 * got[1]


def test_scores_of_an_empty_table(spark, nothing):
    assert context_mixing.score_documents(nothing, trained=fold("doc_id", 5) != 1).count() == 0


def test_counts_of_chunks_and_parts_are_exact(spark, messy, monkeypatch):
    """Scores are those of counts in a dictionary, by whole context and node, wherever chunks are cut."""
    trained = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    with monkeypatch.context() as whole:  # texts in one stretch each, the longest of which the operator reads in two
        whole.setattr(context_mixing, "STRETCH", 1 << 30)
        want = scores_by_dictionary([t for _, t, *_ in ROWS], [i is not None and i % 2 == 0 for i, *_ in ROWS])
    for chunk, part in ((1 << 22, 1 << 24), (100, 1 << 12)):
        monkeypatch.setattr(context_mixing, "CHUNK", chunk)
        monkeypatch.setattr(context_mixing, "PART", part)
        got = context_mixing.score_documents(messy, trained=trained).collect()
        assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), rel=1e-5)


def scores_by_dictionary(texts, trained):
    weights = np.zeros(257)
    n_words = 0
    for text, t in zip(texts, trained, strict=True):
        if t:
            words = word_unigrams.lowered_words((text or "").encode())
            n_words += len(words)
            for w in words:
                np.add.at(weights, np.frombuffer(w, np.uint8), 1)
    weights[32] += n_words
    weights[10] += n_words / 20
    weights[256] += sum(trained)
    code = context_mixing.huffman(weights)

    def met(s):
        """(context, node, bit) of every decision, by context."""
        length, at = context_mixing._decisions(code, s.symbols)
        owner = np.repeat(np.arange(len(s.symbols)), length)
        raw, starts = s.symbols.tolist(), np.repeat(s.start, s.length).tolist()
        space = {9, 10, 11, 12, 13, 32}
        keys = [[], [], [], []]
        for i, a in enumerate(starts):
            w = i
            while w > a and raw[w - 1] not in space:
                w -= 1
            for held, first in zip(keys, (i - 2, w, i - 4, i - 6), strict=True):
                held.append(tuple(raw[max(a, first) : i]))
        nodes, bits = code.node[at].tolist(), code.bit[at].tolist()
        return [[(k[o], n, b) for o, n, b in zip(owner.tolist(), nodes, bits, strict=True)] for k in keys]

    counts = [Counter() for _ in range(4)]
    for text, t in zip(texts, trained, strict=True):
        if t:
            for _, stretches in context_mixing._groups(pa.array([text], pa.string())):
                for s in stretches:
                    for k, found in enumerate(met(s)):
                        counts[k].update(found)

    class ByDictionary(context_mixing.Mixer):
        def _inputs(self, s, order, length, at):
            inner = context_mixing.Stretch(s.symbols, s.start, s.length)
            own, _ = context_mixing._decisions(code, s.symbols)
            first = np.cumsum(own) - own
            places = context_mixing._stretched(first[order], length)
            for k, found in enumerate(met(inner)):
                n = np.array([[counts[k][c, node, 0], counts[k][c, node, 1]] for c, node, _ in found])
                yield context_mixing._packed(n)[places]

    mixer = ByDictionary(context_mixing.MixingModel(code, None))
    return [mixer.score(pa.array([t], pa.string()))[0] for t in texts]


def test_quality_trains_on_one_row_of_an_identifier(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"bad junk there {i}", None, None) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = quality_classifier.train(frame(spark, rows), labels)
    often = quality_classifier.train(frame(spark, rows + [(3, "good words here 3 again", None, None)] * 50), labels)
    assert often.bias == once.bias
    assert (often.weights == once.weights).all()


def test_any_number_of_languages(spark, monkeypatch):
    """Languages in blocks of three, two held at once in training, score as all in one block."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20 + "the end", f"l{i:03}", None) for i in range(300)]
    one = language_id.train(frame(spark, rows).repartition(2))
    assert len(one.languages) == 300 and [b.shape[1] for b in one.blocks] == [256, 44]
    asked = frame(spark, rows[::30] + [(900, "123", None, None), (901, None, None, None), (902, "zz the end", None, None)])
    want = language_id.identify(asked, one).collect()
    assert [r["lang_pred"] for r in want[:10]] == [r[2] for r in rows[::30]]
    few = [r for r in rows if r[0] < 8]
    whole = language_id.identify(asked, language_id.train(frame(spark, few))).collect()
    monkeypatch.setattr(language_id, "BLOCK", 3)
    monkeypatch.setattr(language_id, "HELD", 2)
    cut = language_id.train(frame(spark, few))
    assert [b.shape[1] for b in cut.blocks] == [3, 3, 2]
    for a, b in zip(whole, language_id.identify(asked, cut).collect(), strict=True):
        assert (a["lang_pred"], a["score"]) == (b["lang_pred"], pytest.approx(b["score"]))


def test_equally_likely_languages(spark, monkeypatch):
    """The first in code point order, in one block or in two."""
    model = language_id.train(frame(spark, [(1, "abc", "y", None), (2, "abc", "x", None), (3, "abc", "z", None)]))
    got = language_id.identify(frame(spark, [(7, "abc", None, None)]), model).first()
    assert (got["lang_pred"], got["score"]) == ("x", pytest.approx(1 / 3))
    monkeypatch.setattr(language_id, "BLOCK", 1)
    parts = language_id.LanguageModel(model.languages, tuple(model.blocks[0][:, k : k + 1] for k in range(3)), model.priors)
    again = language_id.identify(frame(spark, [(7, "abc", None, None)]), parts).first()
    assert (again["lang_pred"], again["score"]) == ("x", pytest.approx(1 / 3))


def quality_features(text):
    """Tokens and pairs by plain Python, before hashing."""
    kind = lambda ch: 0 if ch.isspace() else 1 if ch.isalnum() else 2
    tokens, last = [], 0
    for ch in text:
        if kind(ch) and kind(ch) == last:
            tokens[-1] += ch
        elif kind(ch):
            tokens.append(ch)
        last = kind(ch)
    named = ["<SHOUT>" if len(t) > 1 and t.isalpha() and t.isupper() else t for t in tokens]
    return Counter(named) + Counter("<AGAIN>" if a == b else (a, b) for a, b in zip(named, named[1:], strict=False))


def test_where_a_text_is_cut_changes_no_feature():
    texts = ["Some words, and MORE words!! " * 60, "", None, "  ", "x" * 300 + " y  \n\n z", "a " * 90 + " " * 200 + "b", "?!" * 70 + " end"]
    count = lambda limit: Counter((int(o), int(b)) for bs, os in quality_classifier._features(texts, limit) for b, o in zip(bs, os, strict=True))
    whole = count(1 << 19)
    for limit in (1, 7, 40, 333):
        assert count(limit) == whole
    for number, text in enumerate(texts):
        want = quality_features(text or "")
        assert sum(want.values()) == sum(n for (o, _), n in whole.items() if o == number)
        assert sorted(want.values()) == sorted(n for (o, _), n in whole.items() if o == number)


def test_training_matches_the_rule_by_hand(spark, monkeypatch):
    """FTRL-proximal one coordinate at a time, over the same rows in the same order."""
    rows = [(i, f"good words here {i % 3}" if i % 2 else f"BAD junk, there {i % 5}", None, None) for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    monkeypatch.setattr(quality_classifier, "SHARDS", 1)
    model = quality_classifier.train(frame(spark, rows), labels)
    turns = {r["id"]: r["turn"] for r in spark.range(24).select("id", F.xxhash64("id").alias("turn")).collect()}
    z, n, c = Counter(), Counter(), quality_classifier

    def weight(k):
        if abs(z[k]) <= c.L1:
            return 0.0
        return (math.copysign(c.L1, z[k]) - z[k]) / ((c.BETA + math.sqrt(n[k])) / c.ALPHA + c.L2)

    for _ in range(c.EPOCHS):
        for i in sorted(range(24), key=turns.get):
            counts = quality_features(rows[i][1])
            x = {k: v * c.SCALE / sum(counts.values()) for k, v in counts.items()} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            wrong = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - i % 2
            for k, v in x.items():
                g = wrong * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / c.ALPHA * w[k]
                n[k] += g * g
    assert model.bias == pytest.approx(weight("bias"), rel=1e-4)
    got = sorted(float(w) for w in model.weights if w)
    assert got == pytest.approx(sorted(weight(k) for k in z if k != "bias" and weight(k)), rel=1e-4)
    asked = "good junk words"
    counts = quality_features(asked)
    margin = weight("bias") + c.SCALE * sum(weight(k) * v for k, v in counts.items()) / sum(counts.values())
    score = quality_classifier.score(frame(spark, [(1, asked, None, None)]), model).first()["score"]
    assert score == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)


def contexts_by_hand(text):
    """The six bytes before every byte and the end, and the word so far, as plain bytes."""
    raw = text.encode().lower()
    return [(raw[max(0, i - 6) : i], re.split(rb"[\x20\x09-\x0d]", raw[:i])[-1]) for i in range(len(raw) + 1)]


@pytest.mark.parametrize("text", ["The cat sat. " * 700, "longword" * 900 + " end", " \n" * 3000, "a", ""])
def test_stretches_carry_their_context(monkeypatch, text):
    """Contexts are equal exactly where they are by hand, and scores the same, wherever a text is cut."""
    model = taught(["the cat sat on the mat. the cat"] * 20)
    scores, seen = [], []
    for stretch in (1 << 17, 1024, 3000):
        monkeypatch.setattr(context_mixing, "STRETCH", stretch)
        (_, parts), = context_mixing._groups(pa.array([text]))
        found = [np.concatenate(k) for k in zip(*map(context_mixing._contexts, parts), strict=True)]
        seen.append(found)
        scores.append(context_mixing.Mixer(model).score(pa.array([text]))[0])
    for found in seen[1:]:
        assert all((a == b).all() for a, b in zip(seen[0], found, strict=True))
    assert scores == pytest.approx([scores[0]] * 3, rel=1e-6)
    by_hand = contexts_by_hand(text)
    for key, hand in ((seen[1][3], [six for six, _ in by_hand]), (seen[1][1], [word for _, word in by_hand])):
        assert len(set(key.tolist())) == len(set(hand)) == len(set(zip(key.tolist(), hand, strict=True)))


def test_pairs_are_not_kept_and_texts_are_dealt_to_chunks_once(spark):
    """The table of chunks holds texts alone; naming pairs and scoring share one shuffle of them."""
    from tests.conftest import plan

    rows = [(i, f"some words of text {i % 7} and {i}") for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("trained", F.col("id") % 5 != 1)
    chunks = context_mixing.cut_texts(docs)
    assert chunks.columns == ["row", "chunk", "id", "text", "trained"] and chunks.count() == len(rows)
    scores = context_mixing.train(chunks, np.ones(257)).scores(chunks)
    assert len({r["row"] for r in scores.collect() if r["score"] < 0}) == len(rows)
    assert "ReusedExchange" in plan(scores)


def test_answers_hold_each_node_of_a_context_once():
    """Logits come back whole from what is sent, which is fewer than the steps of all paths; chunks' texts are shuffled compressed."""
    rng = np.random.default_rng(7)
    code = context_mixing.huffman(rng.integers(1, 1000, 257))
    symbols, _, _ = context_mixing._ranges(code)
    meeting = context_mixing._meeting(code)
    keys = np.unique((rng.integers(0, 50, 2000).astype(np.uint64) << np.uint64(9)) | rng.integers(0, 257, 2000).astype(np.uint64))
    n = rng.integers(0, 90, len(keys))
    first, length, logits = context_mixing._flat_logits(code, keys, n)
    for asked in (keys, keys[::3], keys[:1], keys[:0]):
        at = np.searchsorted(keys, asked)
        shared = context_mixing._shared_steps(meeting, asked)
        sent = context_mixing._packed_logits(logits[context_mixing._stretched(first[at] + shared, length[at] - shared)])
        own = context_mixing._unpacked_logits(pa.scalar(sent, pa.binary()))
        assert len(asked) < 2 or len(own) < 0.8 * length[at].sum()
        got = context_mixing._whole_paths(code, symbols, meeting, asked, own)
        assert (got == logits[context_mixing._stretched(first[at], length[at])]).all()
    # By hand: a decision's logit is that of the counts of all symbols of the context beyond either way.
    paths = [code.bit[a : a + k].tolist() for a, k in zip(code.start, code.length, strict=True)]
    counts = {}
    for key, c in zip(keys.tolist(), n.tolist(), strict=True):
        path = tuple(paths[symbols[key & 511]])
        for d in range(1, len(path) + 1):
            counts[key >> 9, path[:d]] = counts.get((key >> 9, path[:d]), 0) + c
    for i in range(0, len(keys), 7):
        path = tuple(paths[symbols[int(keys[i]) & 511]])
        for d in range(len(path)):
            taken, other = (counts.get((int(keys[i]) >> 9, (*path[:d], w)), 0) for w in (path[d], 1 - path[d]))
            assert logits[first[i] + d] >> 2 == pytest.approx(1024 * np.clip(math.log((taken + 0.3) / (other + 0.3)), -7.9, 7.9), abs=0.51)
    for step in (0, 64):
        sorted_keys = keys[keys >> np.uint64(9) == 3] if not step else np.unique(((keys >> np.uint64(9)) * np.uint64(64) + np.uint64(5)) << np.uint64(9) | (keys & np.uint64(511)))
        assert (context_mixing._unpacked_keys(pa.scalar(context_mixing._packed_keys(sorted_keys, step), pa.binary())) == sorted_keys).all()


def test_texts_are_shuffled_compressed(spark):
    """Texts of a chunk go to the shuffle as one compressed row per batch."""
    docs = spark.createDataFrame([(i, "the same words again " * 200) for i in range(40)], "id long, text string").withColumn("trained", F.lit(True))
    chunks = context_mixing.cut_texts(docs.coalesce(1))
    (held,) = context_mixing._packed_texts(iter(chunks.select("chunk", "row", "text", "trained").toArrow().combine_chunks().to_batches()))
    assert held.num_rows == 1 and len(held["texts"][0].as_py()) < 40 * 4200 / 10
    assert context_mixing._opened(pa.Table.from_batches([held]))["row"].to_pylist() == list(range(40))
