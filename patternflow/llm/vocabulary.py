"""A unigram vocabulary read from a SentencePiece model file, and the segments it encodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

#: White space in pieces.
MARKER = "▁"
#: Subtracted from the lowest score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. ``scores`` has those that text can match; ``bytes_`` the ids of <0x00> to <0xFF>, if any."""

    pieces: tuple[str, ...]
    scores: dict[int, float]
    bytes_: tuple[int, ...]
    unknown: int

    @property
    def unknown_score(self) -> float:
        return min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def cost_of(self, ch: str) -> int:
        """The pieces that an uncovered character becomes: its UTF-8 bytes, or one unknown."""
        return len(ch.encode()) if self.bytes_ else 1


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of the model file at ``path``, a file that the driver can open.

    Pieces keep their stored scores, whichever way the file's own trainer meant them.
    Control, unknown and byte pieces never match text. Meant for models that keep text
    as it is but for a space before it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(size))
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    return Vocabulary(
        pieces,
        {i: model.get_score(i) for i in range(size) if i not in special},
        tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (),
        model.unk_id(),
    )


def segments(text: str, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The text's segments, in lists of about ``limit`` characters' worth.

    A segment is a run of markers with what follows up to the next marker, and a line
    break is one by itself. No piece reaches over such a border (``check_segmentable``), so the
    best segmentation of a text is that of its segments in a row. A marker in the text itself
    reads as a space.
    """
    if not text:
        return
    # Spaces become markers, so the space is free to part the segments.
    marked = (MARKER + text.replace(" ", MARKER)).replace(MARKER, " " + MARKER)
    parted = marked.replace(MARKER + " ", MARKER).replace("\n", " \n ")
    at = 0
    while at < len(parted):
        cut = parted.find(" ", at + limit)
        end = len(parted) if cut < 0 else cut
        yield parted[at:end].split(" ")
        at = end + 1


def check_segmentable(vocabulary: Vocabulary) -> None:
    """Refuse a vocabulary with a piece that could reach over the border of two segments."""
    for i in vocabulary.scores:
        piece = vocabulary.pieces[i]
        if "\n" in piece or MARKER in piece.lstrip(MARKER):
            raise ValueError(f"{piece!r} can reach over two segments")
