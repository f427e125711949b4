"""The piece table: the vocabulary of a SentencePiece model with unigram scores.

The model file at hand is of the BPE kind, whose scores are merge ranks. A unigram score is
derived from the rank by Zipf's law: the piece of rank r has the share 1 / (r + 3) of the sum of
all such shares. Scores are natural logarithms in whole units of 1/64, so that sums are exact and ties
are ties; a unigram model with these scores in single precision gives the same segmentation
while a text's total stays below 2**18.

A text is escaped as the library does: a space is U+2581, one is put in front of a text that is not
empty. Pieces have U+2581 at their front only, so no piece crosses from one segment (a run of U+2581 and what
follows up to the next) to another, and the best path of a text is that of its segments. A line feed
that no longer piece holds is a segment of its own.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNITS = 64
#: An unknown character scores so many units below the worst piece.
UNKNOWN_PENALTY = 10 * UNITS
#: Pieces that a model may have: the table is broadcast.
MOST_PIECES = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (piece, id, score); unknown: the score of an unknown character; first_byte: id of byte 0 or None."""

    pieces: tuple[tuple[str, int, int], ...]
    unknown: int
    unknown_id: int
    first_byte: int | None
    longest: int
    feed_alone: bool

    def segment_pattern(self) -> str:
        """Segments of an escaped text, as a pattern for Python and Java."""
        return f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.feed_alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+"


def vocabulary(model_file: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if len(normal) > MOST_PIECES:
        raise ValueError(f"the model has {len(normal)} pieces; {MOST_PIECES} can be broadcast")
    whole = math.log(sum(1 / (r + 3) for r in range(len(normal))))
    pieces = tuple((m.id_to_piece(i), i, -round(UNITS * (math.log(r + 3) + whole))) for r, i in enumerate(normal))
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece has a space inside: segments would not be independent")
    bytes_ = [i for i in range(m.get_piece_size()) if m.is_byte(i)]
    feed_alone = not any("\n" in p for p, _, _ in pieces if len(p) > 1)
    return Vocabulary(pieces, min(s for _, _, s in pieces) - UNKNOWN_PENALTY, m.unk_id(), bytes_[0] if bytes_ else None, max(len(p) for p, _, _ in pieces), feed_alone)


def escape(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def segments(v: Vocabulary):
    """A function from a text to its segments."""
    find = re.compile(v.segment_pattern()).findall
    return lambda text: find(escape(text))
