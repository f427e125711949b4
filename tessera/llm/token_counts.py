"""Token counts: count-only Viterbi over the matches of an Aho-Corasick automaton.

The automaton of all pieces enumerates the matches that end at each character, longest first.
The fold carries the best score and the count of its pieces, nothing to trace the path back by. Ties go by the
tokenizer's rule: of equal scores at one end the earliest start wins, since only a strictly better one
replaces it. A character that no single-character piece covers is an unknown, which counts as its bytes if the
vocabulary has byte pieces, else as one.

Segments (words) repeat, so each Python worker keeps the counts of the last ones it met in a table of
bounded size; whole texts are counted, whatever their length.

Defined cases: a null or empty text has no pieces; a text of spaces has the pieces of its run; repeated rows give
a row each; columns besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .pieces import DEFAULT_MODEL, UNITS, Vocabulary, segments, vocabulary

#: Segments whose counts a worker keeps.
KEPT = 400_000
#: Count and score of a segment in one number, so that one sum adds both.
_SHIFT = 40


class Counter(dict):
    """segment -> pieces + (score << _SHIFT), worked out where it is missing."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in v.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def best(self, segment: str) -> tuple[int, int]:
        """(score, pieces) of the best path."""
        score: list[int | None] = [0] + [None] * len(segment)
        count = [0] * (len(segment) + 1)
        done = 0

        def close(end: int) -> None:
            # Ends before ``end`` get their unknown character if no single-character piece came.
            nonlocal done
            while done < end:
                done += 1
                if not single[done]:
                    s = score[done - 1] + self.v.unknown
                    if score[done] is None or s > score[done]:
                        score[done] = s
                        count[done] = count[done - 1] + (len(segment[done - 1].encode("utf-8", "surrogatepass")) if self.v.first_byte is not None else 1)

        single = bytearray(len(segment) + 1)
        for last, (n, piece_score) in self.automaton.iter(segment):
            end = last + 1
            if done < end - 1:
                close(end - 1)
            s = score[end - n] + piece_score
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - n] + 1
            if n == 1:
                single[end] = 1
        close(len(segment))
        return score[-1], count[-1]

    def __missing__(self, segment: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        score, count = self.best(segment)
        value = self[segment] = count + (score << _SHIFT)
        return value


_counters: dict[int, Counter] = {}


def _count_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    v: Vocabulary = shared.value
    counter = _counters.setdefault(hash(v), None) or Counter(v)
    _counters[hash(v)] = counter
    cut, of = segments(v), counter.__getitem__
    mask = (1 << _SHIFT) - 1
    for batch in batches:
        total = [sum(map(of, cut(t))) for t in batch.column(1).to_pylist()]
        counts = np.array([x & mask for x in total], dtype=np.int64)
        scores = np.array([(x >> _SHIFT) / UNITS for x in total], dtype=np.float64)
        yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(scores)], names=["id", "n", "s"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """id, n_tokens, score (the log probability of the best segmentation)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    d = docs.select(F.col(id_col).alias("id"), whole_text(docs, text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = d.mapInArrow(lambda it: _count_batches(it, shared), f"id {kind}, n bigint, s double")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("s").alias("score"))
