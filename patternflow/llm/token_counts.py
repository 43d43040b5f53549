"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists all vocabulary matches of a segment; dynamic
programming over their ends carries the best score and its number of pieces. Ties go the
way the tokenizer's own lattice settles them: at each end the candidate that
starts first stays unless a later one is strictly better.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref
from patternflow.llm.vocabulary import Vocabulary, check_segmentable, segments

#: Segments whose count a task remembers, and their longest length.
REMEMBERED = 1 << 19
LONGEST_REMEMBERED = 64


class SegmentCounts(dict):
    """The number of pieces of each segment, worked out at first sight."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        super().__init__()
        self.vocabulary = vocabulary
        self.unknown = vocabulary.unknown_score
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for i, score in vocabulary.scores.items():
            piece = vocabulary.pieces[i]
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()

    def __missing__(self, segment: str) -> int:
        n = self._count(segment)
        if len(segment) <= LONGEST_REMEMBERED:
            self[segment] = n
        return n

    def _count(self, segment: str) -> int:
        best = [0.0] * (len(segment) + 1)
        count = [0] * (len(segment) + 1)
        done = 0

        def pass_over(until: int) -> None:
            # Ends that no match reaches: the character before can only be an uncovered one.
            nonlocal done
            while done < until:
                best[done + 1] = best[done] + self.unknown
                count[done + 1] = count[done] + self.vocabulary.cost_of(segment[done])
                done += 1

        # Matches arrive by end, at each end the longest, which starts first, before the others.
        for last, (length, score) in self.automaton.iter(segment):
            pass_over(last)
            start, end = last + 1 - length, last + 1
            if done == last:
                best[end], count[end] = best[start] + score, count[start] + 1
                done = end
                if segment[last] not in self.single:
                    uncovered = best[last] + self.unknown
                    if uncovered > best[end]:
                        best[end], count[end] = uncovered, count[last] + self.vocabulary.cost_of(segment[last])
            elif best[start] + score > best[end]:
                best[end], count[end] = best[start] + score, count[start] + 1
        pass_over(len(segment))
        return count[-1]

    def of(self, text: str | None) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        return sum(sum(map(self.__getitem__, part)) for part in segments(text or ""))


def token_count_of(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> Column:
    """The number of pieces of ``df``'s text column, as long; 0 for null and empty texts."""
    check_segmentable(vocabulary)
    ensure_on_executors(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = SegmentCounts(shared.value)
        for texts in batches:
            yield pa.array([counts.of(t.as_py()) for t in texts], pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "long")(ref(text_col).cast("string"))


def count_tokens(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, n_tokens; other columns are ignored."""
    return df.select(ref(id_col).alias(id_col), token_count_of(df, vocabulary, text_col).alias("n_tokens"))
