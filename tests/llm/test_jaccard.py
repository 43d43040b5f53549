"""The Jaccard join, its components and the pipeline against brute force."""

import random

import pytest

import corpus_pipeline
from patternflow.llm import components, jaccard_join, piece_codec, vocabulary
from patternflow.llm.queries import ORACLES, QUERIES

from .conftest import COPY, ROWS, frame

SMALL = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_force(rows, words, percent):
    """(size, smallest identifier reachable) of every (identifier, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[top(i)] = min(least.get(top(i), name), name)
    return [(name, len(s), least.get(top(i)) if s else name) for i, ((name, _), s) in enumerate(zip(rows, sets, strict=True))]


def agree(spark, rows, words, percent):
    df = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = jaccard_join.similar_groups(df, words=words, percent=percent).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_force(rows, words, percent)))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 60)])
def test_components_match_brute_force(spark, prose, words, percent):
    agree(spark, list(enumerate(prose)), words, percent)


def test_with_frequent_grams_and_small_blocks(spark, prose, monkeypatch):
    """Combination signatures, stars and several blocks, as large tables have them."""
    monkeypatch.setattr(jaccard_join, "LEAST_MET", 2)
    monkeypatch.setattr(jaccard_join, "EVERYWHERE", 0.03)
    monkeypatch.setattr(jaccard_join, "PAIRED", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_SKETCHES", 7)
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", (6, 7))
    rnd = random.Random(5)
    base = prose[0].split() + prose[4].split() + prose[9].split()
    many = []
    for _ in range(60):
        near = list(base)
        for _ in range(rnd.randrange(6)):
            near[rnd.randrange(len(near))] = f"x{rnd.randrange(9)}"
        many.append(" ".join(near))
    agree(spark, list(enumerate(prose + many)), 4, 85)


def test_messy_and_empty_tables(spark, nothing):
    agree(spark, [(i, t) for i, t, *_ in ROWS], 4, 85)
    assert jaccard_join.similar_groups(nothing).count() == 0


def test_long_chains_end_in_one_component(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (600, 602)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(201), 0), 600: 600, 601: 600, 602: 600}


def test_pipeline_stage_by_stage(spark, prose):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(prose + [COPY, COPY.upper(), "12 34", None, ""])]
    docs = frame(spark, rows)
    kept = {n for n, t, *_ in rows if t and any(ch.isalpha() for ch in t)}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language ID"](spark, docs, SMALL)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == kept
    two = stage["exact dedup"](spark, one, SMALL)
    first = {}
    for n, t, *_ in rows:
        if n in kept:
            first.setdefault(t.encode().translate(LOWER), n)
    assert {r["doc_id"] for r in two.select("doc_id").collect()} == set(first.values())
    three = stage["n-gram Jaccard join"](spark, two, SMALL)
    left = [(n, t) for n, t, *_ in rows if n in set(first.values())]
    stays = {c for _, _, c in brute_force(left, 5, 80)}
    assert sorted(r["doc_id"] for r in three.select("doc_id").collect()) == sorted(stays)
    four = stage["mixing sources to target weights"](spark, three, SMALL)
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = stage["SentencePiece encoding and decoding"](spark, four, SMALL)
    assert five.count() == four.count() > 0
    back = five.select("doc_id", piece_codec.decoded(five, vocabulary.load()).alias("text")).distinct().collect()
    assert all(dict(left)[r["doc_id"]] == r["text"] for r in back)


def test_pipeline_of_messy_and_empty_tables(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    from checks.compare import bag, connect

    con = connect(SMALL)
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, got) == bag(names, con.fetchall())
