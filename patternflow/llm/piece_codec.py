"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A task splits texts into segments and encodes each distinct one once. All
segments of a round are walked through the trie and through the lattice side by side in numpy:
one step per piece length, then one per position. Characters that no piece covers become
byte pieces. Decoding gathers the pieces' bytes and turns markers back into spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref
from patternflow.llm.vocabulary import MARKER, Vocabulary, check_segmentable, segments

#: Segments a task remembers, the characters it encodes side by side, and those of a result batch.
REMEMBERED = 1 << 19
ROUND = 1 << 18
BATCH = 1 << 21


@dataclass(frozen=True)
class DoubleArray:
    """Children of state s under code c sit at ``base[s] + c`` where ``check`` says s. ``value``: piece or -1."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int


def build_trie(vocabulary: Vocabulary) -> DoubleArray:
    """The double-array trie of the pieces that text can match."""
    words = {vocabulary.pieces[i]: i for i in vocabulary.scores}
    codes = {ch: k + 1 for k, ch in enumerate(sorted({ch for w in words for ch in w}))}
    root: dict = {}
    for word, i in words.items():
        node = root
        for ch in word:
            node = node.setdefault(codes[ch], {})
        node[0] = i
    base, check, value = [0], [0], [-1]

    def grow(size: int) -> None:
        more = size - len(base)
        if more > 0:
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    free_from = 1
    waiting = [(0, root)]
    for state, node in waiting:  # grows while it is read: breadth first
        value[state] = node.get(0, -1)
        children = sorted(c for c in node if c)
        if not children:
            continue
        while free_from < len(check) and check[free_from] != -1:
            free_from += 1
        slot = max(free_from, children[0] + 1)
        tried = 0
        while True:
            grow(slot + children[-1] - children[0] + 1)
            if check[slot] == -1 and all(check[slot + c - children[0]] == -1 for c in children):
                break
            slot += 1
            tried += 1
        if tried > 1000:  # the front is nearly full: start further on from now
            free_from = slot
        base[state] = slot - children[0]
        for c in children:
            check[base[state] + c] = state
            waiting.append((base[state] + c, node[c]))
    grow(max(base) + len(codes) + 2)
    return DoubleArray(codes, np.array(base), np.array(check), np.array(value), max(map(len, words), default=0))


class Encoder:
    """Encodes texts with a vocabulary, remembering the segments it has met."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray) -> None:
        self.vocabulary, self.trie = vocabulary, trie
        self.score = np.zeros(len(vocabulary.pieces))
        self.score[list(vocabulary.scores)] = list(vocabulary.scores.values())
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(ch) for ch in trie.codes]] = list(trie.codes.values())
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _matches(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each length and start the matching piece, or -1."""
        found = np.full((self.trie.depth, len(codes)), -1, np.int32)
        at = np.arange(len(codes))
        state = np.zeros(len(codes), np.int64)
        for k in range(self.trie.depth):
            inside = at + k < end[at]
            at, state = at[inside], state[inside]
            code = codes[at + k]
            child = self.trie.base[state] + code
            ok = (code > 0) & (self.trie.check[child] == state)
            at, state = at[ok], child[ok]
            if not len(at):
                break
            found[k, at] = self.trie.value[state]
        return found

    def _segment_ids(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each segment, one after another, and their numbers."""
        points = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, batch), np.int64, len(batch))
        start = np.cumsum(length) - length
        match = self._matches(self.code[points], np.repeat(start + length, length))
        # A segment of n characters has n + 1 lattice nodes.
        first = start + np.arange(len(batch))
        best = np.full(len(points) + len(batch), -np.inf)
        best[first] = 0.0
        piece = np.full(len(best), -1, np.int32)
        step = np.ones(len(best), np.int64)
        lanes = np.argsort(-length, kind="stable")
        by_length = -length[lanes]
        unknown = self.vocabulary.unknown_score
        for p in range(int(length.max(initial=0))):
            open_ = lanes[: np.searchsorted(by_length, -p, "left")]
            char, node = start[open_] + p, first[open_] + p
            so_far = best[node]
            for k in range(self.trie.depth):
                ids = match[k, char]
                hit = np.flatnonzero(ids >= 0)
                if k == 0:
                    missed = np.flatnonzero(ids < 0)
                    self._offer(best, piece, step, node[missed] + 1, so_far[missed] + unknown, -1, 1)
                if len(hit):
                    total = so_far[hit] + self.score[ids[hit]]
                    self._offer(best, piece, step, node[hit] + k + 1, total, ids[hit], k + 1)
        owner, where, ids = self._trace(first, length, piece, step)
        order = np.lexsort((where, owner))
        owner, where, ids = owner[order], where[order], ids[order]
        return self._with_bytes(owner, ids, points[start[owner] + where - 1], len(batch))

    @staticmethod
    def _offer(best, piece, step, node, total, ids, width) -> None:
        better = total > best[node]
        at = node[better]
        best[at] = total[better]
        piece[at] = ids[better] if isinstance(ids, np.ndarray) else ids
        step[at] = width

    @staticmethod
    def _trace(first, length, piece, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, end, piece) of the best paths, from their ends back."""
        lane, at = np.flatnonzero(length > 0), length[length > 0]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(lane):
            node = first[lane] + at
            out.append((lane, at, piece[node]))
            at = at - step[node]
            lane, at = lane[at > 0], at[at > 0]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _with_bytes(self, owner, ids, points, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Uncovered characters as byte pieces, or as unknown ones."""
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            table = self.vocabulary.bytes_
            spelled = [
                [table[b] for b in chr(c).encode("utf-8", "surrogatepass")] if table else [self.vocabulary.unknown]
                for c in points[missing]
            ]
            width = np.ones(len(ids), np.int64)
            width[missing] = [len(x) for x in spelled]
            ids, owner = np.repeat(ids, width), np.repeat(owner, width)
            ids[ids < 0] = [b for x in spelled for b in x]
        return ids, np.bincount(owner, minlength=n)

    def _learn(self, batch: list[str]) -> None:
        ids, length = self._segment_ids(batch)
        n = len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(batch) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(batch)] = self.used + np.cumsum(length) - length
        self.length[n : n + len(batch)] = length
        self.used += len(ids)
        self.place.update(zip(batch, range(n, n + len(batch)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, one text after another, and how many each has."""
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            if len(self.place) > REMEMBERED:
                self.forget()
            self._learn_all(held)
            at = np.fromiter(map(self.place.__getitem__, held), np.int64, len(held))
            length = self.length[at]
            shift = np.repeat(self.start[at] - np.cumsum(length) + length, length)
            parts.append(self.ids[shift + np.arange(len(shift))])
            owner = np.repeat(*np.array(owners, np.int64).T)
            counts[:] += np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)

        for number, text in enumerate(texts):
            for segs in segments(text, ROUND):
                held += segs
                owners.append((number, len(segs)))
                size += len(text) if len(text) < ROUND else ROUND
                if size >= 4 * ROUND:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return np.concatenate(parts), counts

    def _learn_all(self, segs: list[str]) -> None:
        new = [s for s in dict.fromkeys(segs) if s not in self.place]
        held: list[str] = []
        size = 0
        for s in new:
            held.append(s)
            size += len(s)
            if size >= ROUND:
                self._learn(held)
                held, size = [], 0
        if held:
            self._learn(held)


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier and ids, an array of int.

    Null and empty texts have no ids. A marker in a text encodes as the space it stands
    for. Other columns are ignored.
    """
    check_segmentable(vocabulary)
    ensure_on_executors(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, build_trie(vocabulary)))
    rows = df.select(ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):  # results of bounded size, however large the batch
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                    size += len(texts[end])
                    end += 1
                ids, counts = encoder.encode(texts[at:end])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), listed], ["id", "ids"])
                at = end

    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        byte_of = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}
        known = [
            byte_of.get(i) or (p.replace(MARKER, " ").encode() if i in vocabulary.scores else b"")
            for i, p in enumerate(vocabulary.pieces)
        ]
        self.flat = np.frombuffer(b"".join(known), np.uint8)
        self.length = np.array([len(b) for b in known], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> str:
        """The text of one list of ids; ids out of range and control pieces are skipped.

        The space before a text that starts with a marker is not part of it. Bytes that
        are no UTF-8 become replacement characters.
        """
        ids = ids[(ids >= 0) & (ids < len(self.length))]
        length = self.length[ids]
        shift = np.repeat(self.start[ids] - np.cumsum(length) + length, length)
        raw = self.flat[shift + np.arange(len(shift))].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def decoded(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> Column:
    """The text of ``df``'s ids column; null for null, empty for no ids; null ids are skipped."""
    ensure_on_executors(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for lists in batches:
            yield pa.array(
                [None if not x.is_valid else decoder.decode(np.asarray(x.values.drop_null(), np.int64)) for x in lists],
                pa.string(),
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ref(ids_col).cast("array<int>"))
