"""N-gram Jaccard join: documents linked where their sets of word n-grams nearly agree.

Two sets can only reach the similarity if they share enough n-grams, so each set is looked up by a
prefix of it, rare n-grams first. A rare n-gram is a signature by itself. Frequent ones
are dealt to classes and count only in combinations of k from one class: a class with c
n-grams in the prefix covers c - k + 1 of the n-grams that a partner may lack, so the
prefix is extended until all classes together cover one more than that. Sets that agree
in no signature can't be linked; those that do are verified in full.

Sets that are equal are one node from the start. Nodes of a signature are compared by
parity sketches, which bound the difference of two sets from below. The components of what may be similar are
cells; a cell's sets are then compared in full.

Small groups are compared pair by pair. The members of a large one first meet a few centres of it, which costs in
proportion to the group. Whatever that connects needs no more comparing among itself; only the members
outside the largest connected part meet all others, block against block. Of a
comparison of blocks only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref, staged
from patternflow.llm.components import connected

#: Frequent n-grams that are told apart, the fewest times one is met in a part of the input to be considered.
FREQUENT, LEAST_MET = 1 << 17, 4
#: Combination size of frequent n-grams, and of those in more than a hundredth of all sets.
K_FREQUENT, K_EVERYWHERE, EVERYWHERE = 2, 3, 0.01
#: Sets smaller than this are looked up by single n-grams only.
SMALLEST_COMBINED = 32
#: Signature groups up to this size give pairs.
PAIRED = 64
#: Bits of the parity sketch that bounds two sets' difference: as many as n-grams, between these powers of two.
SKETCH_BITS = (10, 17)
#: Members of a block of sketches; members and n-grams of a block of sets.
BLOCK_SKETCHES = 512
BLOCK_MEMBERS, BLOCK_GRAMS = 256, 1 << 19
#: Members of a large group that all its others are compared with first.
CENTRES = 8
#: Bits, a power of two, of the filter that turns away texts whose set is in no cell: at least as many as FILTER_SPARE times
#: the sets in cells, within these bounds. It is broadcast. Beyond the upper one it lets more texts pass, to a join that drops them.
FILTER_BITS, FILTER_SPARE = (16, 30), 16
_FILTER_PAGE = 20
SALTS = 32
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Sets:
    """Distinct n-grams of some texts, ascending within each; ``first`` and ``size`` by text."""

    grams: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.grams[self.first[i] : self.first[i] + self.size[i]]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word, A-Z lower-cased."""
    visible = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(visible[1:] != visible[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(raw)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(_LOWER[raw] + np.uint64(1)) * power)])
    return _mixed((sums[end] - sums[start]) * back[start], 1) if len(start) else np.zeros(0, np.uint64), start


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, Sets]]:
    """(number of its first text, sets) for runs of texts of about ``CHUNK`` bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, len(texts))
        yield at, _sets_of(data, offsets[at : end + 1], words)
        at = end


def _sets_of(data: np.ndarray, offsets: np.ndarray, words: int) -> Sets:
    # A space between texts keeps their words apart.
    sizes = np.diff(offsets)
    raw = np.insert(data[offsets[0] : offsets[-1]], np.cumsum(sizes), 32)
    word, start = _word_hashes(raw)
    ends = np.cumsum(sizes + 1)
    owner = np.searchsorted(ends, start, "right")
    n_words = np.bincount(owner, minlength=len(sizes))
    first_word = np.cumsum(n_words) - n_words
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        gram += word[k : k + len(gram)] * np.uint64(pow(_BASE, k + 1, 1 << 64) | 1)
    whole = owner[: len(gram)] == owner[words - 1 :] if len(gram) else np.zeros(0, bool)
    grams, owners = gram[whole], owner[: len(gram)][whole]
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    short = np.array(
        [
            np.bitwise_xor.reduce(_mixed(word[first_word[i] : first_word[i] + n_words[i]], 7) * (np.arange(n_words[i], dtype=np.uint64) * np.uint64(2) + np.uint64(3)))
            for i in few
        ],
        np.uint64,
    )
    grams = _mixed(np.concatenate([grams, short]), 2)
    owners = np.concatenate([owners, few])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    grams, owners = grams[fresh], owners[fresh]
    size = np.bincount(owners, minlength=len(sizes))
    return Sets(grams, np.cumsum(size) - size, size)


def _digests(sets: Sets) -> list[bytes]:
    """16 bytes that name a set: two sums over its mixed n-grams."""
    halves = []
    for salt in (3, 5):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(sets.grams, salt))])
        halves.append(sums[sets.first + sets.size] - sums[sets.first])
    both = np.stack(halves, axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def _sketches(sets: Sets) -> list[np.ndarray]:
    """For each set the parity of its n-grams in every slot, as longs.

    The slot is the lower bits of a hash, so that folding a sketch in half gives the one of half the bits.
    """
    low, high = SKETCH_BITS
    power = np.clip(np.ceil(np.log2(np.maximum(sets.size, 1))), low, high).astype(np.int64)
    first = np.cumsum(1 << power) - (1 << power)
    hashed = _mixed(sets.grams, 11).astype(np.int64)
    slot = np.repeat(first, sets.size) + (hashed & np.repeat((1 << power) - 1, sets.size))
    odd = (np.bincount(slot, minlength=int((1 << power).sum())) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64)
    return np.split(longs, np.cumsum((1 << power) >> 6)[:-1])


@dataclass(frozen=True)
class Frequent:
    """Frequent n-grams ascending, with rank (0 the rarest of them) and combination size."""

    grams: np.ndarray
    rank: np.ndarray
    k: np.ndarray

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, combination size) of each n-gram."""
        if not len(self.grams):
            return np.full(len(grams), -1), np.ones(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        return np.where(hit, self.rank[at], -1), np.where(hit, self.k[at], 1)


def _signatures(sets: Sets, frequent: Frequent, percent: int) -> list[np.ndarray]:
    """The signatures of every set with at least two n-grams; others have no partner but their equals."""
    rank, k = frequent.look_up(sets.grams)
    lacking = sets.size - (percent * sets.size + 99) // 100
    owner = np.repeat(np.arange(len(sets.size)), sets.size)
    rare = rank < 0
    before = np.concatenate([[0], np.cumsum(rare)])
    n_rare = before[sets.first + sets.size] - before[sets.first]
    place = before[:-1] - before[sets.first][owner]
    # Where rare n-grams suffice, the first of them are the prefix.
    plain = (n_rare > lacking) & (sets.size > 1)
    chosen = rare & (place <= lacking[owner]) & plain[owner]
    out = np.split(sets.grams[chosen], np.cumsum(np.bincount(owner[chosen], minlength=len(sets.size)))[:-1])
    for i in np.flatnonzero(plain):
        out[i] = np.concatenate([_mixed(out[i], 100 + band) for band in _bands(int(sets.size[i]), percent)])
    for i in np.flatnonzero(~plain & (sets.size > 1)):
        cut = slice(sets.first[i], sets.first[i] + sets.size[i])
        order = np.lexsort((sets.grams[cut], rank[cut]))
        grams, ks = sets.grams[cut][order], k[cut][order]
        found = [_combined(grams, ks, int(lacking[i]), b) for b in _bands(int(sets.size[i]), percent)]
        out[i] = np.unique(np.concatenate(found))
    return out


def _bands(size: int, percent: int) -> list[int]:
    """Bands of sizes, a doubling each, in which a set is looked up: its own, and that of its smallest partner."""
    least = (percent * size + 99) // 100
    return sorted({size.bit_length(), max(1, least).bit_length()})


def _combined(grams: np.ndarray, ks: np.ndarray, lacking: int, band: int) -> np.ndarray:
    """The signatures of one set, whose n-grams come rarest first, in one band.

    Which class an n-gram is in depends on nothing but itself and the band, so
    partners agree on it.
    """
    low = 1 << (band - 1)
    combined = low >= SMALLEST_COMBINED
    classes = max(1, low // 16)
    covered, singles, parts = 0, [], {}
    for gram, k in zip(grams.tolist(), ks.tolist(), strict=True):
        if k == 1 or not combined:
            singles.append(gram)
            covered += 1
        else:
            held = parts.setdefault((k, gram % classes), [])
            held.append(gram)
            covered += len(held) >= k
        if covered > lacking:
            break
    else:
        raise AssertionError("a prefix always covers what a partner may lack")
    out = [_mixed(np.array(singles, np.uint64), 100 + band)]
    for (k, part), held in parts.items():
        if len(held) >= k:
            sets = np.array(list(combinations(sorted(held), k)), np.uint64)
            key = np.zeros(len(sets), np.uint64)
            for j in range(k):
                key = _mixed(key * np.uint64(31) + sets[:, j], part + k)
            out.append(_mixed(key, 100 + band))
    return np.concatenate(out)


def _all_sets(docs: DataFrame, words: int) -> tuple[DataFrame, Frequent]:
    """(id, size, digest) of every row, and the frequent n-grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at, sets in _sets(batch.column("text"), words):
                n = len(sets.size)
                ids = batch.column("id").slice(at, n)
                yield _scanned(ids, pa.array(sets.size, pa.int64()), pa.array(_digests(sets), pa.binary()), None, None)
                held.append(sets.grams)
                size += len(sets.grams)
                if size > 1 << 22:
                    yield _often(held, batch.column("id").type)
                    held, size = [], 0
        if held:
            yield _often(held, batch.column("id").type)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, size long, digest binary, gram long, met long"
    scanned = staged(docs.mapInArrow(scan, schema), "gram-sets")
    rows = scanned.filter("digest IS NOT NULL").select("id", "size", "digest")
    total = rows.count()
    # At most FREQUENT rows of two numbers reach the driver.
    top = (
        scanned.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("met").alias("met"))
        .orderBy(F.col("met").desc(), "gram").limit(FREQUENT).toArrow()
    )
    grams = np.array(top["gram"], np.int64).astype(np.uint64)
    met = np.array(top["met"], np.int64)
    rank = np.arange(len(grams))[::-1]
    order = np.argsort(grams)
    k = np.where(met > EVERYWHERE * total, K_EVERYWHERE, K_FREQUENT)
    return rows, Frequent(grams[order], rank[order], k[order])


def _scanned(ids, size, digest, gram, met) -> pa.RecordBatch:
    n = len(ids)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, size, digest, none if gram is None else gram, none if met is None else met],
        ["id", "size", "digest", "gram", "met"],
    )


def _often(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    grams, met = np.unique(np.concatenate(held), return_counts=True)
    use = met >= LEAST_MET
    n = int(use.sum())
    return _scanned(
        pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(grams[use].astype(np.int64)), pa.array(met[use])
    )


def _nodes(docs: DataFrame, frequent: Frequent, words: int, percent: int) -> DataFrame:
    """One row per distinct set: node, digest, size, sketch, signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), words):
                signed = _signatures(sets, shared.value, percent)
                use = np.flatnonzero(sets.size > 1)
                digests, sketches = _digests(sets), _sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[i] for i in use], pa.binary()),
                        pa.array(sets.size[use], pa.int64()),
                        pa.array([sketches[i] for i in use], pa.list_(pa.int64())),
                        pa.array([signed[i].astype(np.int64) for i in use], pa.list_(pa.int64())),
                    ],
                    ["digest", "size", "sketch", "signatures"],
                )

    rows = docs.select("text").mapInArrow(sign, "digest binary, size long, sketch array<long>, signatures array<long>")
    one_each = rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "signatures")])
    return staged(one_each.withColumn("node", F.monotonically_increasing_id()), "gram-nodes")


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between nodes that may be similar, enough to hold every similar pair in one component."""
    signed = nodes.select("node", "size", F.explode("signatures").alias("signature"))
    groups = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre")).filter("members > 1")
    met = staged(signed.join(groups, "signature").select("signature", "node", "size", "members", "centre"), "gram-members")

    listed = (
        met.filter(F.col("members") <= PAIRED)
        .groupBy("signature")
        .agg(F.array_sort(F.collect_list(F.struct("size", "node"))).alias("all"))
    )
    near = F.flatten(
        F.transform(
            "all",
            lambda x, i: F.transform(
                F.filter(F.slice("all", i + 2, PAIRED), lambda y: 100 * x["size"] >= percent * y["size"]),
                lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")),
            ),
        )
    )
    pairs = listed.select(F.explode(near).alias("p")).select("p.a", "p.b").distinct()
    side = nodes.select("node", "size", "sketch")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a")), "a").join(
        side.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")), "b"
    )

    def folded(x: Column, y: Column) -> Column:
        """``x`` as short as ``y``: partners' sizes, and so their sketches, differ by a doubling at most."""
        n = F.size(y)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    halves = F.zip_with(
        folded(F.col("sketch_a"), F.col("sketch_b")), folded(F.col("sketch_b"), F.col("sketch_a")), lambda x, y: F.bit_count(x.bitwiseXOR(y))
    )
    # Slots of odd difference are at most as many as n-grams that only one of the two has.
    odd = F.aggregate(halves, F.lit(0), lambda s, n: s + n)
    sizes = F.col("size_a") + F.col("size_b")
    close = both.filter(odd <= sizes - 2 * F.ceil(percent * sizes / (100 + percent))).select("a", "b")

    # Large groups with the same smallest node are one group: groups of near copies mostly have the same few.
    large = met.filter(F.col("members") > PAIRED).select(F.col("centre").alias("key"), "node").distinct()
    large = staged(large.join(side, "node").select("key", "node", "size", F.col("sketch").alias("body")), "gram-large")
    wide = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK_SKETCHES).cast("int").alias("blocks"))

    def judge(left: _Side, right: _Side) -> np.ndarray:
        # Unsigned: numpy counts the bits of a signed number's absolute value.
        held = [[np.asarray(x.values).view(np.uint64) for x in side.bodies] for side in (left, right)]
        return _close(left.size, held[0], right.size, held[1], percent)

    return close.unionByName(_group_links(large, wide, judge)).distinct()


@dataclass(frozen=True)
class _Side:
    """Some members of a group: numbers, sizes, and what they are compared by."""

    node: np.ndarray
    size: np.ndarray
    bodies: list

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch | pa.StructArray, names: tuple[str, str, str] = ("node", "size", "body")) -> _Side:
        node, size, body = (rows.field(n) if isinstance(rows, pa.StructArray) else rows.column(n) for n in names)
        return cls(np.array(node, np.int64), np.array(size, np.int64), list(body))


Judge = Callable[[_Side, _Side], np.ndarray]


def _group_links(members: DataFrame, wide: DataFrame, judge: Judge) -> DataFrame:
    """(a, b) links that connect in each group what ``judge`` finds alike.

    ``members`` holds key, node, size and body, ``wide`` each key's number of blocks. A node's own keys may be several.
    """
    stars = staged(_star_links(members, judge), "gram-stars")
    labels = connected(stars)
    placed = members.select("key", "node").join(labels, "node", "left")
    main = placed.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", F.col("label").isNotNull(), "label")).alias("main"))
    rest = placed.join(main, "key").filter(F.col("label").isNull() | (F.col("label") != F.col("main"))).select("key", "node")
    units = _cross_units(members, staged(rest, "gram-rest"), wide)

    def compare(table: pa.Table) -> pa.Table:
        first, second = (_Side.of(table.filter(pa.compute.equal(table["side"], i))) for i in (0, 1))
        if not len(first.node) or not len(second.node):
            return _forest(first.node[:0], second.node[:0], np.zeros((0, 0), bool))
        return _forest(first.node, second.node, judge(first, second))

    return stars.unionByName(units.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"))


def _star_links(members: DataFrame, judge: Judge) -> DataFrame:
    """(a, b): every member with those of its group's centres that it is like."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    # Spark keeps CENTRES rows a task and key before it deals them out.
    few = members.withColumn("place", place).filter(F.col("place") <= CENTRES)
    centres = few.groupBy("key").agg(F.collect_list(F.struct("node", "size", "body")).alias("centres"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            keys = np.array(batch.column("key"), np.int64)
            # Rows of a key come on end, as the join leaves them: its centres are unpacked once for each run.
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for low, high in zip(cuts, cuts[1:]):
                run = batch.slice(low, high - low)
                own, hearts = _Side.of(run), _Side.of(run.column("centres")[0].values)
                for i, j in zip(*np.nonzero(judge(own, hearts)), strict=True):
                    a.append(int(hearts.node[j]))
                    b.append(int(own.node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.join(centres, "key").mapInArrow(meet, "a long, b long").filter("a <> b")


def _cross_units(members: DataFrame, rest: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows of units (key, x, y): side 0 holds a block of the rest, side 1 a block of all members, for each pair of such blocks."""
    some = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n_rest")).join(wide, "key")
    # Blocks of the rest are as large as the others.
    some = some.select("key", "blocks", F.ceil(F.col("n_rest") * F.col("blocks") / F.col("n")).cast("int").alias("rest_blocks"))
    dealt = members.join(some, "key")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    shown = ["key", "x", "y", "side", "node", "size", "body"]
    first = dealt.join(rest, ["key", "node"], "left_semi").withColumn("x", block("rest_blocks")).withColumn("y", every("blocks"))
    second = dealt.withColumn("y", block("blocks")).withColumn("x", every("rest_blocks"))
    return first.withColumn("side", F.lit(0)).select(shown).unionByName(second.withColumn("side", F.lit(1)).select(shown))


def _close(
    size: np.ndarray, sketches: list[np.ndarray], other_size: np.ndarray, others: list[np.ndarray], percent: int
) -> np.ndarray:
    """Which pairs the sketches and sizes leave possible."""
    sizes = size[:, None] + other_size[None, :]
    allowed = sizes - 2 * -(-percent * sizes // (100 + percent))
    near = np.zeros(sizes.shape, bool)
    length, other_length = (np.array([len(s) for s in x]) for x in (sketches, others))

    def stack(held: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([held[i] if len(held[i]) == n else held[i][:n] ^ held[i][n:] for i in at])

    for n in np.unique(np.concatenate([length, other_length])):
        # Partners' lengths are the same or differ by a doubling; n is the shorter one.
        for here, there in ((n, n), (n, 2 * n), (2 * n, n)):
            at, to = np.flatnonzero(length == here), np.flatnonzero(other_length == there)
            if not len(at) or not len(to):
                continue
            a, b = stack(sketches, at, n), stack(others, to, n)
            odd = np.zeros((len(at), len(to)), np.int64)
            for word in range(n):
                odd += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
            near[np.ix_(at, to)] = odd <= allowed[np.ix_(at, to)]
    smaller, larger = np.minimum(size[:, None], other_size[None, :]), np.maximum(size[:, None], other_size[None, :])
    return near & (100 * smaller >= percent * larger)


def _filter(members: DataFrame) -> tuple[np.ndarray, int]:
    """(packed bits, their number as a power of two): the digests that occur, by their first bits."""
    n = members.count()
    low, high = FILTER_BITS
    power = min(high, max(low, (FILTER_SPARE * n).bit_length()))
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    slot = F.shiftright(head, 32 - power)
    slots = members.select(F.shiftright(slot, _FILTER_PAGE).alias("page"), (slot % (1 << _FILTER_PAGE)).cast("int").alias("bit"))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _FILTER_PAGE, bool)
        bits[np.asarray(table["bit"])] = True
        return pa.table({"page": table["page"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    packed = np.zeros(max(1, (1 << power) >> 3), np.uint8)
    # One row per 2^20 bits, and 2^30 bits at most.
    for page, bits in slots.distinct().groupBy("page").applyInArrow(pack, "page long, bits binary").collect():
        part = np.frombuffer(bits, np.uint8)
        at = page << (_FILTER_PAGE - 3)
        packed[at : at + len(part)] = part[: len(packed) - at]
    return packed, power


def _verified(docs: DataFrame, nodes: DataFrame, cells: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links inside the cells that connect all that reach the similarity."""
    members = staged(
        cells.join(nodes.select("node", "digest", "size"), "node").withColumnRenamed("label", "key"), "gram-cells"
    )
    packed, power = _filter(members)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, sets in _sets(batch.column("text"), words):
                digests = _digests(sets)
                slot = np.array([int.from_bytes(d[:4]) >> (32 - power) for d in digests], np.int64)
                wanted = ((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool) if len(slot) else np.zeros(0, bool)
                use = np.flatnonzero(wanted & (sets.size > 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in use], pa.binary()), pa.array([sets.of(i).tobytes() for i in use], pa.binary())],
                    ["digest", "body"],
                )

    grams = docs.select("text").mapInArrow(gather, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body"))
    held = staged(members.join(grams, "digest").select("key", "node", "size", "body"), "gram-held")
    wide = held.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"),
    )
    wide = staged(wide, "gram-wide")

    def judge(left: _Side, right: _Side) -> np.ndarray:
        a, b = ([np.frombuffer(g.as_buffer(), np.uint64) for g in side.bodies] for side in (left, right))
        return _linked(a, b, percent)

    def link(table: pa.Table) -> pa.Table:
        all_of_it = _Side.of(table)
        return _forest(all_of_it.node, all_of_it.node, judge(all_of_it, all_of_it))

    small = held.join(wide.filter("blocks = 1").select("key"), "key", "left_semi").groupBy("key").applyInArrow(link, "a long, b long")
    large = held.join(wide.filter("blocks > 1").select("key"), "key", "left_semi")
    return small.unionByName(_group_links(large, wide, judge))


def _linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of a set and another reach the similarity, exactly."""
    size, other_size = (np.array([len(s) for s in x], np.int64) for x in (sets, others))
    both, n = [*sets, *others], len(sets)
    _, inverse, met = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.cumsum(met > 1) - 1  # n-grams of a single set are in no intersection
    use = met[inverse] > 1
    owner, gram = np.repeat(np.arange(len(both)), np.concatenate([size, other_size]))[use], number[inverse[use]]
    shared = np.zeros((n, len(others)), np.float32)
    total = int((met > 1).sum())
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for low in range(0, total, 4096):
        a, b = np.searchsorted(gram, [low, low + 4096])
        held = np.zeros((len(both), min(4096, total - low)), np.float32)
        held[owner[a:b], gram[a:b] - low] = 1
        shared += held[:n] @ held[n:].T
    shared = shared.astype(np.int64)  # whole numbers below 2 ** 24: exact
    return 100 * shared >= percent * (size[:, None] + other_size[None, :] - shared)


def _forest(node: np.ndarray, others: np.ndarray, linked: np.ndarray) -> pa.Table:
    """(a, b): a spanning forest of the linked pairs of a node and another."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = int(node[i]), int(others[j])
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            kept.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: identifier, n_shingles, component_id.

    A text's set holds its distinct ``words``-word n-grams, A-Z lower-cased; with fewer words the
    whole sequence is its one member. Texts link where the intersection is at least ``percent``
    per cent of the union; a component is what links reach. Its identifier is the smallest of
    its rows'. Null and blank texts have an empty set and are linked with nothing, so
    they keep their own identifier. Rows that repeat, or whose sets are equal, share a
    component. A null identifier counts only where a component has no other. Other columns are ignored.
    ``percent`` must be above 50: then a set of one member has no partner but its equals, and
    partners differ in size by less than a doubling.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"percent must be above 50 and at most 100, not {percent}")
    ensure_on_executors(df.sparkSession)
    docs = df.select(ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))
    rows, frequent = _all_sets(docs, words)
    nodes = _nodes(docs, frequent, words, percent)
    cells = connected(_candidates(nodes, percent))
    links = staged(_verified(docs, nodes, cells, words, percent), "gram-links")
    labels = connected(links).join(nodes.select("node", "digest"), "node").select("digest", "label")

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    classes = (
        salted.filter("size > 0").groupBy("digest")
        .agg(F.min("id").alias("least"), F.collect_set("salt").alias("salt"))  # at most SALTS numbers
        .join(labels, "digest", "left")
    )
    of_label = classes.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component"))
    placed = classes.join(of_label, "label", "left").select(
        "digest", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), F.explode("salt").alias("salt")
    )
    return salted.join(placed, ["digest", "salt"], "left").select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
