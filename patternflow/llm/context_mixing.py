"""Language-model scoring by online logistic context mixing over bits.

A byte is spelled as decisions in a Huffman tree, so frequent bytes take few.
Every decision is predicted under several contexts: from how often each of its two ways
was taken in all training texts where the context was the same. The logits are
combined by weights, of which a set is gated by how well the contexts are known. The weights
start equal in every text and are refined while it is read: a block of bytes is
predicted with the weights so far, then they take a gradient step. A text's score is the
log10 probability of its bytes, A-Z lower-cased, and of its end.

The counts are exact at any size of input. Texts are dealt to chunks, once, and a chunk names its distinct pairs of a
context and the byte that follows. The pairs of all chunks meet in parts dealt by context, where they
are summed; back goes what each chunk asked for. Parts and chunks are of bounded size, their
numbers grow with the input, and nothing is gathered on the driver. Texts of a chunk are
read side by side in numpy, one block of each per step.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref, staged
from patternflow.llm.word_unigrams import count_words, score_texts

#: Contexts, in the order of the tables: two bytes before, the word so far, four bytes, six.
CONTEXTS = 4
#: Slots of a context's table in a model that is held in memory (``MixingModel``).
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: Bytes of text in a chunk, and those whose pairs of one context a part holds on average; the fewest parts of a context.
CHUNK = 28 << 20
PART = 1 << 24
FEWEST_PARTS = 64
END = 256
#: Added to both counts of a slot.
PRIOR = 0.3
#: Logits are stored in steps of 1/1024 in the upper 14 of 16 bits; the lower two say how often the slot was met.
STEP, LIMIT = 1024.0, 7.9
FIRST_WEIGHT = 0.35
RATE, DAMPING = 2.5, 60.0
FIRST_BLOCK, LAST_BLOCK = 32, 1024
_DOUBLINGS = (LAST_BLOCK // FIRST_BLOCK).bit_length() - 1
#: Bytes read side by side. A longer text is read in stretches that end where blocks do and carry their context on, so this changes no score.
STRETCH = 1 << 17
#: Bytes of a chunk whose pairs are told apart at once.
SEGMENT = 1 << 20

_LOWER = np.arange(257, dtype=np.int32)
_LOWER[65:91] += 32
_SPACE = np.zeros(257, bool)
_SPACE[[9, 10, 11, 12, 13, 32, END]] = True


@dataclass(frozen=True)
class Code:
    """The Huffman tree of 257 symbols, flat: each symbol's nodes and decisions one after another."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(weights: np.ndarray) -> Code:
    """The code for the symbols' weights, each at least 1."""
    heap = [(float(max(1, w)), s, None) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    inner = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], 257 + inner, (inner, a, b)))
        inner += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0], [])]
    while stack:
        (_, symbol, parts), path = stack.pop()
        if parts is None:
            paths[symbol] = path
        else:
            stack.append((parts[1], [*path, (parts[0], 0)]))
            stack.append((parts[2], [*path, (parts[0], 1)]))
    length = np.array([len(paths[s]) for s in range(257)])
    steps = np.array([step for s in range(257) for step in paths[s]])
    return Code(np.cumsum(length) - length, length, steps[:, 0].astype(np.uint32), steps[:, 1].astype(np.int8))


@dataclass(frozen=True)
class Carried:
    """What the bytes before a stretch leave to it: their number, the last six, and the word so far with the power its hash has come to."""

    read: int = 0
    last: tuple[int, ...] = ()
    word: np.uint64 = np.uint64(0)
    power: np.uint64 = np.uint64(1)


@dataclass(frozen=True)
class Stretch:
    """Bytes of several texts behind one another; ``start`` and ``length`` by text, ends included.

    A stretch that goes on with a text holds that one alone.
    """

    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    carried: Carried = Carried()

    def passes_on(self) -> Carried:
        """What the stretch, of one text, leaves to the next."""
        n = len(self.symbols)
        spaces = np.flatnonzero(_SPACE[self.symbols])
        code = self.symbols[spaces[-1] + 1 if len(spaces) else 0 :].astype(np.uint64) + np.uint64(1)
        power = np.concatenate([np.ones(1, np.uint64), _powers(1 << len(code).bit_length())[0][: len(code)]])
        word, scale = (np.uint64(0), np.uint64(1)) if len(spaces) else (self.carried.word, self.carried.power)
        word = (np.array([word]) + np.array([scale]) * (code * power[:-1]).sum(dtype=np.uint64))[0]
        last = (*self.carried.last, *self.symbols[-6:].tolist())[-6:]
        return Carried(self.carried.read + n, last, word, (np.array([scale]) * power[-1])[0])


def _groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[Stretch]]]:
    """(numbers of texts, their stretches in order), all bytes lower-cased; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)

    def stretch(first: int, last: int, begin: int, end: int, closes: bool) -> Stretch:
        """Texts ``first`` to ``last``, or with ``begin`` and ``end`` a part of one."""
        length = np.array([end - begin]) if first == last - 1 else sizes[first:last].copy()
        raw = _LOWER[data[offsets[first] + begin : offsets[first] + begin + int(length.sum())]]
        if closes:
            raw = np.insert(raw, np.cumsum(length), END)
            length = length + 1
        return Stretch(raw, np.cumsum(length) - length, length)

    at = 0
    while at < len(sizes):
        end, held = at + 1, sizes[at]
        while end < len(sizes) and held + sizes[end] <= STRETCH:
            held += sizes[end]
            end += 1
        if end > at + 1:
            yield np.arange(at, end), [stretch(at, end, 0, 0, True)]
        else:
            size, step = int(sizes[at]), max(1, STRETCH // LAST_BLOCK) * LAST_BLOCK
            cuts = [0, *range(FIRST_BLOCK * (2**_DOUBLINGS - 1) + step, size, step), size]
            parts, carried = [], Carried()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                parts.append(replace(stretch(at, end, a, b, b == size), carried=carried))
                carried = parts[-1].passes_on()
            yield np.array([at]), parts
        at = end


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a number and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def _contexts(s: Stretch) -> list[np.ndarray]:
    """Each context at every byte, in 54 bits but for the word, a hash of 64."""
    n, last = len(s.symbols), s.carried.last
    # Six places lie ahead of the stretch: what it goes on from, or nothing.
    code = np.zeros(n + 6, np.uint64)
    code[6 - len(last) : 6] = np.array(last, np.uint64) + np.uint64(1)
    code[6:] = s.symbols
    code[6:] += np.uint64(1)
    twos = code[1:] | (code[:-1] << np.uint64(9))
    pair = twos[4 : 4 + n]
    four = pair | (twos[2 : 2 + n] << np.uint64(18))
    six = four | (twos[:n] << np.uint64(36))
    if not s.carried.read:
        for j in range(6):  # what lies before a text is not its own
            at = s.start[s.length > j] + j
            for key in (pair, four, six):
                key[at] &= np.uint64((1 << 9 * j) - 1)
    code = code[6:]
    # The word so far: running sums of code * base^place since the last white space, shifted back.
    power, back = _powers(1 << max(0, n - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:n])])
    opens = np.zeros(n, bool)
    opens[1:] = _SPACE.take(s.symbols[:-1])
    opens[s.start[s.length > 0]] = True
    opens = np.flatnonzero(opens)
    each = np.diff(opens, append=n)
    word = sums[:-1] - np.repeat(sums[opens], each)
    word *= np.repeat(back[opens], each)
    if s.carried.read and n:
        word[: each[0]] = s.carried.word + s.carried.power * word[: each[0]]
    return [pair, word, four, six]


def _context_hashes(s: Stretch) -> list[np.ndarray]:
    """A 32-bit hash of each context at every byte."""
    keys = _contexts(s)
    mixed = [(key + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9) for k, key in enumerate(keys)]
    return [((m ^ (m >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32) for m in mixed]


def _decisions(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of decisions of every symbol, place in the flat code of every decision), in order."""
    length = code.length[symbols]
    shift = code.start[symbols] - np.cumsum(length) + length
    return length, np.arange(int(length.sum())) + np.repeat(shift, length)


def _slots(hashes: np.ndarray, length: np.ndarray, node_key: np.ndarray) -> np.ndarray:
    """The slot of every decision, from its symbol's hash. Made in place: arrays of decisions are long."""
    slot = np.repeat(hashes, length)
    slot += node_key
    slot *= np.uint32(0x85EBCA6B)
    slot >>= np.uint32(32 - SLOT_BITS)
    return slot


def _node_keys(code: Code, at: np.ndarray) -> np.ndarray:
    return (code.node * np.uint32(0x9E3779B1)).take(at)


def _counted(code: Code, texts: pa.Array, tables: np.ndarray) -> None:
    """Add the decisions of all texts to ``tables`` (contexts x slots x 2)."""
    one = tables.dtype.type(1)
    for _, stretches in _groups(texts):
        for s in stretches:
            length, at = _decisions(code, s.symbols)
            keys, bit = _node_keys(code, at), code.bit.astype(np.uint32).take(at)
            for k, hashes in enumerate(_context_hashes(s)):
                slot = _slots(hashes, length, keys)
                slot <<= np.uint32(1)
                slot |= bit
                np.add.at(tables[k], slot, one)


def _packed(counts: np.ndarray) -> np.ndarray:
    """Slots x 2 counts as logits and how often they were met, in 16 bits."""
    n = counts.astype(np.float64) + PRIOR
    logit = np.clip(np.log(n[:, 1] / n[:, 0]), -LIMIT, LIMIT)
    met = counts.sum(axis=1)
    known = (met > 0).astype(np.int16) + (met > 3) + (met > 30)
    return (np.round(logit * STEP).astype(np.int16) << np.int16(2)) | known.astype(np.int16)


def _ranges(code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by their place among the tree's leaves, places by symbol, and three bounds of every flat decision.

    Between the first and second bound lie the leaves of its way 0, then up to the third those of way 1.
    """
    paths = [code.bit[a : a + n].tolist() for a, n in zip(code.start, code.length, strict=True)]
    symbols = np.array(sorted(range(257), key=lambda s: paths[s]))
    places = np.argsort(symbols)
    place = np.repeat(places, code.length)
    bounds = np.full((3, int(code.node.max()) + 1), 257)
    np.minimum.at(bounds[0], code.node, place)
    np.minimum.at(bounds[1], code.node[code.bit == 1], place[code.bit == 1])
    bounds[2] = 0
    np.maximum.at(bounds[2], code.node, place + 1)
    return symbols, places, bounds[:, code.node].astype(np.uint64)


def _pair_keys(s: Stretch, places: np.ndarray) -> list[np.ndarray]:
    """Context and following symbol's place at every byte in one number: 54 and 9 bits. Only the word is hashed."""
    keys = _contexts(s)
    word = keys[1] * np.uint64(0xBF58476D1CE4E5B9)
    keys[1] = ((word ^ (word >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(10)
    place = places.astype(np.uint64)[s.symbols]
    return [(key << np.uint64(9)) | place for key in keys]


def _counted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each stands there)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _index_in(asked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of every one that is asked for among distinct keys."""
    return pc.index_in(pa.array(asked), value_set=pa.array(keys)).to_numpy(zero_copy_only=False)


def _numbered(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted distinct keys, index among them of every key, array by array); ``keys`` is emptied, for it may be long."""
    found = np.concatenate([np.zeros(0, np.uint64), *keys])
    found.sort()
    found = found[np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]])]
    numbers = []
    while keys:
        own = keys.pop(0)
        order = np.argsort(own)  # those looked for lie side by side then
        numbers.append(np.empty(len(own), np.int32))
        numbers[-1][order] = np.searchsorted(found, own[order])
    return found, numbers


def _shortened(keys: np.ndarray, bytes_kept: int) -> np.ndarray:
    """Keys of the longest context as those of a shorter one, the last ``bytes_kept`` bytes."""
    context = (keys >> np.uint64(9)) & np.uint64((1 << 9 * bytes_kept) - 1)
    return (context << np.uint64(9)) | (keys & np.uint64(511))


def _dealt(keys: np.ndarray, parts: int, hashed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order of the sorted keys by part, part of each then): all symbols of a context have one part."""
    part = keys >> np.uint64(9)
    if not hashed:
        part *= np.uint64(0xD6E8FEB86659FD93)
        part = ((part ^ (part >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
    part %= np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint64), kind="stable")
    return order, part[order]


_ZSTD = pa.Codec("zstd", compression_level=6)
#: Of tables of texts: what is compressed at once, and how hard.
_LARGE_PAGES = {"parquet.page.size": 8 << 20, "parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": 9}
_ZSTD_OF_TEXTS = pa.Codec("zstd", compression_level=9)


def _squeezed(data: np.ndarray) -> bytes:
    """The bytes, compressed, behind their number."""
    raw = np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unsqueezed(raw: pa.Buffer) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd", asbytes=True)


def _planes(data: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones and so on."""
    return np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize).T.ravel()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray, step: int = 0) -> bytes:
    """Sorted keys in few bytes: distinct contexts, or how many times ``step`` they lie apart, symbols' places, each context's symbols."""
    context, n = _counted_runs(keys >> np.uint64(9))
    inner = (keys & np.uint64(511)).astype("<u2")
    head = np.array([len(context), len(keys), step, context[0] % np.uint64(step) if step else 0], "<u8").view(np.uint8)
    columns = np.diff(context // np.uint64(step), prepend=np.uint64(0)) if step else context
    return _squeezed(np.concatenate([head, _planes(columns.astype(">u8")), _planes(inner), n.astype("<u2").view(np.uint8)]))


def _unpacked_keys(data: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(_unsqueezed(data.as_buffer()), np.uint8)
    contexts, n, step, rest = raw[:32].view("<u8").tolist()
    columns, inner, each = np.split(raw[32:], [8 * contexts, 8 * contexts + 2 * n])
    context = _from_planes(columns, ">u8").astype(np.uint64)
    context = np.cumsum(context, dtype=np.uint64) * np.uint64(step) + np.uint64(rest) if step else context
    place = _from_planes(inner, "<u2").astype(np.uint64)
    return (np.repeat(context, np.frombuffer(each.tobytes(), "<u2")) << np.uint64(9)) | place


def _turned(packed: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Packed logits, those to ``turn`` of the other way."""
    return np.where(turn, (-(packed >> np.int16(2)) << np.int16(2)) | (packed & np.int16(3)), packed)


def _meeting(code: Code) -> np.ndarray:
    """How many nodes the paths of two symbols share, by their places."""
    symbols, _, _ = _ranges(code)
    paths = np.full((257, int(code.length.max())), -1)
    for row, s in zip(paths, symbols.tolist(), strict=True):
        row[: code.length[s]] = code.bit[code.start[s] : code.start[s] + code.length[s]]
    return (paths[:, None] != paths[None]).argmax(axis=2) + 1


def _shared_steps(meeting: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many first nodes of each pair's path are those of the pair before it; ``keys`` are sorted within contexts."""
    place = (keys & np.uint64(511)).astype(np.int64)
    shared = np.zeros(len(keys), np.int64)
    context = keys >> np.uint64(9)
    shared[1:] = np.where(context[1:] == context[:-1], meeting[place[:-1], place[1:]], 0)
    return shared


def _packed_logits(logits: np.ndarray) -> bytes:
    """Logits in few bytes: which differ from the one before, and those."""
    new = np.concatenate([np.ones(min(1, len(logits)), bool), logits[1:] != logits[:-1]])
    flags = _squeezed(np.packbits(new))
    return len(logits).to_bytes(8, "little") + len(flags).to_bytes(8, "little") + flags + _squeezed(logits[new].astype("<i2"))


def _unpacked_logits(data: pa.Scalar) -> np.ndarray:
    raw = data.as_buffer()
    n, size = np.frombuffer(raw[:16], "<u8").tolist()
    new = np.unpackbits(np.frombuffer(_unsqueezed(raw[16 : 16 + size]), np.uint8), count=n)
    return np.frombuffer(_unsqueezed(raw[16 + size :]), "<i2")[np.cumsum(new, dtype=np.int64) - 1]


def _whole_paths(code: Code, symbols: np.ndarray, meeting: np.ndarray, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The packed logits on every pair's path, of the way taken, from those that the pair before does not share."""
    length, at = _decisions(code, symbols[(keys & np.uint64(511)).astype(np.int64)])
    first, shared = np.cumsum(length) - length, _shared_steps(meeting, keys)
    turn = code.bit.take(at) == 0
    places = _stretched(first + shared, length - shared)
    out = np.empty(len(at), np.int16)
    out[places] = _turned(own, turn[places])
    for step in range(int(shared.max(initial=0))):
        pairs = np.flatnonzero(length > step)
        source = np.maximum.accumulate(np.where(shared[pairs] <= step, np.arange(len(pairs)), 0))
        place = first[pairs] + step
        out[place] = out[place[source]]
    return _turned(out, turn)


class _Pairs:
    """The distinct pairs of a chunk in each context, with how often training texts hold them.

    Those of two and four bytes follow from those of six.
    """

    def __init__(self) -> None:
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 3: []}

    def add(self, texts: pa.Array, trained: bool, places: np.ndarray) -> None:
        waiting: dict[int, list[np.ndarray]] = {1: [], 3: []}
        size = 0
        for _, stretches in _groups(texts):
            for s in stretches:
                keys = _pair_keys(s, places)
                size += len(s.symbols)
                for k in waiting:
                    waiting[k].append(keys[k])
                if size > 2 * SEGMENT:
                    self._counted(waiting, trained)
                    size = 0
        if size:
            self._counted(waiting, trained)

    def _counted(self, waiting: dict[int, list[np.ndarray]], trained: bool) -> None:
        for k, keys in waiting.items():
            found, n = _counted_runs(np.concatenate(keys))
            self.held[k].append((found, n if trained else np.zeros(len(found), np.int64)))
            keys.clear()

    def merged(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sorted distinct keys, counts) by context."""
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        word, six = (_summed(*map(np.concatenate, zip(none, *self.held[k], strict=True))) for k in (1, 3))
        four = _summed(_shortened(six[0], 4), six[1])
        return [_summed(_shortened(four[0], 2), four[1]), word, four, six]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # quick where sorted runs stand behind one another
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _narrowest(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they fit; their number tells which."""
    top = int(n.max(initial=0))
    return n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max))


def _flat_logits(code: Code, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number, and all of them) of the packed logits on every pair's path; ``keys`` are all of their contexts.

    A logit is that of the way which the pair's symbol takes.
    """
    symbols, _, bounds = _ranges(code)
    length, at = _decisions(code, symbols[(keys & np.uint64(511)).astype(np.int64)])
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    counts = np.zeros((len(at), 2), np.int64)
    bit = code.bit.take(at).astype(np.int64)
    # The one pair of a context takes every way on its path as often as it stands there.
    context = keys >> np.uint64(9)
    opens = np.concatenate([np.ones(min(1, len(keys)), bool), context[1:] != context[:-1]])
    alone = np.repeat(opens & np.concatenate([opens[1:], np.ones(min(1, len(keys)), bool)]), length)
    single, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
    counts[single, bit[single]] = np.repeat(n, length)[single]
    below, at = np.repeat(context << np.uint64(9), length)[rest], at[rest]
    low, middle, high = (total[np.searchsorted(keys, below | b[at])] for b in bounds)
    counts[rest, 0], counts[rest, 1] = middle - low, high - middle
    return np.cumsum(length) - length, length, _turned(_packed(counts), bit == 0)


def _stretched(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``length`` of them, one after another."""
    return np.arange(int(length.sum())) + np.repeat(first - np.cumsum(length) + length, length)


def cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, trained) as one written table, with row and chunk."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = chunk = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                done = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + CHUNK - held, side="right")))
                part = batch.slice(at, end - at)
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), pa.array(np.full(n, chunk)), *(part.column(c) for c in ("id", "text", "trained"))],
                    ["row", "chunk", "id", "text", "trained"])
                held, row, at = held + int(sizes[end - 1]) - done, row + n, end
                if held >= CHUNK or end < len(batch):
                    held, chunk = 0, chunk + 1

    schema = f"row long, chunk long, id {kind}, text string, trained boolean"
    rows = docs.select("id", ref("text").cast("string").alias("text"), ref("trained").cast("boolean").alias("trained"))
    return staged(rows.mapInArrow(cut, schema), "chunks", compression="zstd", **_LARGE_PAGES)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a).select(["row", "text", "trained"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD_OF_TEXTS)) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[a : a + 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])


def _opened(rows: pa.Table) -> pa.Table:
    """row, text and trained of a chunk."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["texts"]]).combine_chunks()


def _by_chunk(chunks: DataFrame) -> GroupedData:
    """Texts dealt by chunk, many in one compressed row: in one form, so that the two steps that need them share a shuffle."""
    rows = chunks.select("chunk", "row", "text", "trained")
    return rows.mapInArrow(_packed_texts, "chunk long, texts binary").groupBy("chunk")


def named_pairs(chunks: DataFrame, code: Code, parts: int) -> DataFrame:
    """chunk, parts of a context, part, keys and counts: the distinct pairs of every chunk."""
    places = _ranges(code)[1]

    def name(rows: pa.Table) -> pa.Table:
        own = _opened(rows)
        pairs, text, trained = _Pairs(), own["text"].combine_chunks(), own["trained"].combine_chunks().fill_null(False)
        pairs.add(text.filter(trained), True, places)
        pairs.add(text.filter(pc.invert(trained)), False, places)
        out = {"part": [], "keys": [], "counts": []}
        for k, (keys, n) in enumerate(pairs.merged()):
            order, part = _dealt(keys, parts, hashed=k == 1)
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
            keys, n = keys[order], n[order]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out["part"].append(k * parts + int(part[a]))
                out["keys"].append(_packed_keys(keys[a:b], parts if k == 1 else 0))
                out["counts"].append(_squeezed(_narrowest(n[a:b])))
        made, chunk = len(out["part"]), rows["chunk"][0].as_py()
        return pa.table(
            {"chunk": pa.array([chunk] * made, pa.int64()), "parts": pa.array([parts] * made, pa.int32()), "part": pa.array(out["part"], pa.int32()),
             "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return _by_chunk(chunks).applyInArrow(name, "chunk long, parts int, part int, keys binary, counts binary")


def answered(pairs: DataFrame, code: Code) -> DataFrame:
    """chunk, parts, part and the packed logits of every pair that the chunk named there, of all chunks' counts."""
    meeting = _meeting(code)

    def answer(rows: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(x) for x in rows["keys"]]
        counts = []
        for x, k in zip(rows["counts"], keys, strict=True):
            raw = _unsqueezed(x.as_buffer())
            kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // len(k)]
            counts.append(np.frombuffer(raw, kind).astype(np.int64))
        every, n = _summed(np.concatenate(keys), np.concatenate(counts))
        first, length, logits = _flat_logits(code, every, n)
        out = []
        for k in keys:
            at = np.searchsorted(every, k)
            shared = _shared_steps(meeting, k)
            out.append(_packed_logits(logits[_stretched(first[at] + shared, length[at] - shared)]))
        return pa.table({"chunk": rows["chunk"], "parts": rows["parts"], "part": rows["part"], "logits": pa.array(out, pa.binary())})

    asked = pairs.select("chunk", "parts", "part", "keys", "counts")
    return asked.groupBy("part").applyInArrow(answer, "chunk long, parts int, part int, logits binary")


@dataclass(frozen=True)
class PairModel:
    """What every chunk asked for, ``answers``, of exact counts that never leave the executors."""

    code: Code
    answers: DataFrame

    def scores(self, texts: DataFrame) -> DataFrame:
        """row and score of ``texts`` (row, chunk, text, trained)."""
        code = self.code

        def score(own: pa.Table, answers: pa.Table) -> pa.Table:
            own = _opened(own)
            text = own["text"].combine_chunks()
            mixer = ChunkMixer(code, answers["parts"][0].as_py(), text, zip(answers["part"].to_pylist(), answers["logits"], strict=True))
            return pa.table({"row": own["row"], "score": pa.array(mixer.score(text), pa.float64())})

        return _by_chunk(texts).cogroup(self.answers.groupBy("chunk")).applyInArrow(score, "row long, score double")


@dataclass(frozen=True)
class MixingModel:
    """A model of few texts, in memory: by context, packed logits in hashed slots."""

    code: Code
    tables: np.ndarray

    def scores(self, texts: DataFrame) -> DataFrame:
        """row and score of ``texts`` (row, text)."""
        shared = texts.sparkSession.sparkContext.broadcast(self)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mixer = Mixer(shared.value)
            for batch in batches:
                scores = pa.array(mixer.score(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("row"), scores], ["row", "score"])

        return texts.select("row", "text").mapInArrow(score, "row long, score double")


def train(chunks: DataFrame, byte_weights: np.ndarray) -> PairModel:
    """The model of the training texts in ``chunks``. No row, no knowledge."""
    code = huffman(byte_weights)
    held = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return PairModel(code, answered(named_pairs(chunks, code, max(FEWEST_PARTS, -(-held // PART))), code))


class Mixer:
    """Scores texts with a model; each text has weights of its own."""

    def __init__(self, model: MixingModel) -> None:
        self.code, self.tables = model.code, model.tables
        self.sign = 1 - 2 * self.code.bit.astype(np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The log10 probability of every text."""
        out = np.zeros(len(texts))
        for numbers, stretches in _groups(texts):
            weights = np.full((CONTEXTS, len(numbers) * 16), FIRST_WEIGHT / STEP, np.float32)
            for s in stretches:
                out[numbers] -= self._cost(s, weights) / np.log(10)
        return out

    def _inputs(self, s: Stretch, order: np.ndarray, length: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """By context, the packed logit of every decision, the symbols in ``order``."""
        keys = _node_keys(self.code, at)
        for k, hashes in enumerate(_context_hashes(s)):
            yield self.tables[k].take(_slots(hashes[order], length, keys))

    def _cost(self, s: Stretch, weights: np.ndarray) -> np.ndarray:
        """The stretch's cost by text in nats; ``weights`` (contexts x 16 a text) are refined on the way.

        Logits stay in steps here, and weights in their inverse.
        """
        text = np.repeat(np.arange(len(s.start)), s.length)
        block = _block_of(np.arange(len(text)) - s.start[text] + s.carried.read)
        block -= block.min(initial=int(block[0]) if len(block) else 0)
        # Sixteen bits, where they suffice, are sorted by counting.
        order = np.argsort(block.astype(np.int16) if block.max(initial=0) < 1 << 15 else block, kind="stable")
        length, at = _decisions(self.code, s.symbols[order])
        sign = None if self.sign is None else self.sign.take(at)
        inputs = np.empty((CONTEXTS, len(at)), np.float32)
        known = np.zeros(len(at), np.int16)
        for k, slot in enumerate(self._inputs(s, order, length, at)):
            if k in (1, 2):
                known <<= np.int16(2)
                known |= slot & np.int16(3)
            slot >>= np.int16(2)
            inputs[k] = slot
        gate = np.repeat(text[order] * 16, length)
        gate += known
        cost = np.empty(len(at), np.float32)
        ends = np.cumsum(length)
        last = np.flatnonzero(np.diff(block[order], append=-1))
        low = 0
        for high in ends[last].tolist():
            self._block(inputs[:, low:high], gate[low:high], None if sign is None else sign[low:high], weights, cost[low:high])
            low = high
        return np.bincount(np.repeat(text[order], length), weights=cost, minlength=len(s.start))

    @staticmethod
    def _block(x: np.ndarray, gate: np.ndarray, sign: np.ndarray | None, weights: np.ndarray, cost: np.ndarray) -> None:
        """Predict one block's decisions with the weights so far, then refine these. Without ``sign``, logits are those of the way taken."""
        logit = weights[0].take(gate)
        logit *= x[0]
        for k in range(1, CONTEXTS):
            part = weights[k].take(gate)
            part *= x[k]
            logit += part
        np.negative(logit, out=logit) if sign is None else np.multiply(logit, sign, out=logit)
        odds = np.exp(np.minimum(logit, np.float32(20), out=logit), out=logit)
        total = odds + np.float32(1)
        np.log(total, out=cost)
        error = np.divide(odds, total, out=odds)
        np.negative(error, out=error) if sign is None else np.multiply(error, sign, out=error)
        first = int(gate.min())
        gate = gate - first
        n = np.bincount(gate)
        rate = RATE / (STEP * STEP) / (n + DAMPING)
        for k in range(CONTEXTS):
            weights[k, first : first + len(n)] -= rate * np.bincount(gate, weights=error * x[k])


class ChunkMixer(Mixer):
    """Scores the texts of one chunk, once, with the (part, packed logits) that answer its pairs."""

    def __init__(self, code: Code, parts: int, texts: pa.Array, answers: Iterator[tuple[int, pa.Scalar]]) -> None:
        self.code, self.sign = code, None
        self.symbols, self.places, _ = _ranges(code)
        meeting = _meeting(code)
        segments = list(self._segments(texts))
        keys, stretches = [[s[k] for s in segments] for k in (0, 1)], [s[2] for s in segments]
        del segments
        (six, sixes), (word, words) = map(_numbered, keys)
        four = np.unique(_shortened(six, 4))
        pair = np.unique(_shortened(four, 2))
        by_part = dict(answers)
        first, self.logits = [], []
        for k, keys in enumerate((pair, word, four, six)):
            order, part = _dealt(keys, parts, hashed=k == 1)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            held = [np.zeros(0, np.int16)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = _unpacked_logits(by_part.pop(k * parts + int(part[a])))
                held.append(_whole_paths(code, self.symbols, meeting, keys[order[a:b]], own))
            length = code.length[self.symbols[(keys[order] & np.uint64(511)).astype(np.int64)]]
            place = np.empty(len(keys), np.int64)
            place[order] = np.cumsum(length) - length
            first.append(place)
            self.logits.append(np.concatenate(held))
        # Where a pair of the longest context has its logits in the two that follow from it.
        first[0] = first[0][_index_in(_shortened(six, 2), pair)]
        first[2] = first[2][_index_in(_shortened(six, 4), four)]
        length = code.length[self.symbols[(six & np.uint64(511)).astype(np.int64)]]
        self.stretches = self._located(zip(sixes, words, stretches, strict=True), length, first)

    def _segments(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of many stretches, keys of the longest context and of the word in distinct pairs of both, and each stretch's pairs as numbers."""
        waiting: list[list[np.ndarray]] = []
        for _, stretches in _groups(texts):
            for s in stretches:
                waiting.append(_pair_keys(s, self.places)[3:0:-2])
                if sum(len(w[0]) for w in waiting) > SEGMENT:
                    yield self._told_apart(waiting)
        if waiting:
            yield self._told_apart(waiting)

    @staticmethod
    def _told_apart(waiting: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        ends = np.cumsum([len(w[0]) for w in waiting])[:-1]
        six, word = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        salt = np.uint64(0xD6E8FEB86659FD93)
        while True:
            both = (word >> np.uint64(9)) * salt + six
            both *= np.uint64(0x94D049BB133111EB)
            both ^= both >> np.uint64(29)
            index = pa.array(both).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            last = np.empty(int(index.max(initial=-1)) + 1, np.int64)
            last[index] = np.arange(len(index))
            pa.default_memory_pool().release_unused()
            if (six[last][index] == six).all() and (word[last][index] == word).all():
                return six[last], word[last], np.split(index, ends)
            salt += np.uint64(2)  # two pairs shared a number

    def _located(self, segments: Iterator[tuple], lengths: np.ndarray, first: list[np.ndarray]) -> Iterator[tuple]:
        """By stretch: where the logits of its segment's pairs begin, these logits by context side by side, its pairs as numbers."""
        for by_six, by_word, stretches in segments:
            length = lengths[by_six]
            table = np.empty((int(length.sum()), CONTEXTS), np.int16)
            for k, logits in enumerate(self.logits):
                table[:, k] = logits.take(_stretched(first[k][by_word if k == 1 else by_six], length))
            start, table = np.cumsum(length) - length, table.view(np.uint64).ravel()
            for index in stretches:
                yield start, table, index

    def _inputs(self, s: Stretch, order: np.ndarray, length: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        first, table, index = next(self.stretches)
        rows = table.take(_stretched(first[index[order]], length)).view(np.int16).reshape(-1, CONTEXTS)
        yield from rows.T


def _block_of(inside: np.ndarray) -> np.ndarray:
    """The number of a byte's block: blocks double from ``FIRST_BLOCK`` up to ``LAST_BLOCK`` bytes."""
    doubling = _DOUBLINGS
    early = np.floor(np.log2(inside / FIRST_BLOCK + 1)).astype(np.int64)
    grown = FIRST_BLOCK * ((1 << doubling) - 1)
    return np.where(inside < grown, early, doubling + (inside - grown) // LAST_BLOCK)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, trained: Column
) -> DataFrame:
    """One row per input row: identifier, n_tokens, n_known, train_tokens, base_score, score.

    ``trained`` says which rows' texts train (null: not). ``score`` is the mixing model's
    log10 probability of the text, ``base_score`` that of a smoothed unigram model of
    words; both count the text's end. Null and empty texts have the end alone. Other
    columns of the input are ignored.
    """
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"), trained.alias("trained"))
    ensure_on_executors(docs.sparkSession)
    counts = count_words(rows, "text", "trained")
    weights = counts.byte_weights()
    chunks = cut_texts(rows)
    scored = score_texts(chunks, counts).join(train(chunks, weights).scores(chunks), "row")
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
