"""Chat formatting with a black-box template: turns are found by rendering successive prefixes of a conversation.

A template is any function from a list of (role, text) to a string. The output of k turns is compared with that of k - 1: where the
shorter is a prefix of the longer, the rest is the span of turn k; where it is not, the template rewrites history, and the turn is
counted in ``rewritten``. Inside its span a turn's text is found by rendering two letters in its place: what both outputs begin and
end with is the template's. Spans of the roles that are learnt from are the loss mask.

Conversations are cut into pieces of up to 64 turns and some 1 MB of text, by turn number, which are dealt out by themselves, so a
conversation of any length is no task of its own. That needs a template that renders a turn alike wherever it stands; every turn is also
rendered alone and compared, and counted in ``dependent`` if it differs. Templates that look back take ``whole=True``: then a
conversation is rendered in one piece.

Defined results: null role and text are empty; a null conv_id is a conversation of its own; null turns come first; equal turns are
ordered by role, then text, and repeated rows are repeated turns; a conversation without the loss roles has an empty loss; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: A piece holds turns whose numbers share all but the last so many bits, up to so many as these bits count, and is cut after so many characters.
TURN_BITS, PIECE_CHARS = 6, 1 << 20
LEARNT = ("assistant",)
#: Bytes of formatted text that a task hands on at once.
OUT_BYTES = 1 << 22

#: The control strings of the marked template.
BEGIN, SAYS, END = "### ", ": ", " </turn>\n"
_IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_IN_ROLE = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)


def escape(text: str, marks: re.Pattern = _IN_TEXT) -> str:
    """No ``###`` and no ``</turn>`` is left that a backslash does not precede."""
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """``### role: text </turn>`` on a line of its own for each turn."""
    return "".join(f"{BEGIN}{escape(role, _IN_ROLE)}{SAYS}{escape(text)}{END}" for role, text in turns)


def parse_marked(output: str) -> list[Turn]:
    """The turns of ``marked``'s output. Escaped text never holds the end mark, so the first one ends the turn."""
    at, turns = 0, []
    while at < len(output):
        head = _ROLE.match(output, at)
        end = output.find(END, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(head[1]), unescape(output[head.end() : end])))
        at = end + len(END)
    return turns


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int, int]:
    """(output without what an empty conversation gives, spans, rewritten, dependent).

    A span is (begin, end, text_begin, text_end) in the output. Spans of a template that rewrites history begin where the outputs part.
    """
    empty = template([])
    before, spans, rewritten, dependent = empty, [], 0, 0
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        begin = len(before)
        if not after.startswith(before):
            rewritten += 1
            begin = common_prefix(before, after)
        one, two = (template([*turns[:k], (role, x)]) for x in "ab")
        head, tail = common_prefix(one, two), common_prefix(one[::-1], two[::-1])
        if not (after.startswith(one[:head]) and after.endswith(one[len(one) - tail :]) and head + tail <= len(after)):
            raise ValueError(f"turn {k}: the template changes what surrounds a text with the text")
        dependent += template([(role, text)])[len(empty) :] != after[begin:]
        spans.append((begin, len(after), head, len(after) - tail))
        before = after
    cut = len(empty)
    return before[cut:], [tuple(x - cut for x in s) for s in spans], rewritten, dependent


SPAN = "struct<role:string,begin:int,end:int,text_begin:int,text_end:int,loss:boolean>"


def _format_pieces(batches: Iterable[pa.RecordBatch], template: Template, schema: pa.Schema, learnt: tuple[str, ...], most_chars: float, most_turns: float) -> Iterator[pa.RecordBatch]:
    """One row for each piece of the sorted turns of a task."""
    key, piece, turns, chars, rows, size = None, 0, [], 0, [], 0

    def close() -> None:
        nonlocal turns, chars, size
        if turns:
            output, spans, rewritten, dependent = locate(template, turns)
            rows.append((*key, piece, output, len(turns), [dict(zip(("role", "begin", "end", "text_begin", "text_end", "loss"), (r, *s, r in learnt))) for (r, _), s in zip(turns, spans)], rewritten, dependent))
            size += len(output)
        turns, chars = [], 0

    def out() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        size = 0
        return batch

    for batch in batches:
        for conv, stretch, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, stretch) != key:
                close()
                key, piece = (conv, stretch), 0
            elif chars >= most_chars or len(turns) >= most_turns:
                close()
                piece += 1
            turns.append((role or "", text or ""))
            chars += len(text or "")
            if size >= OUT_BYTES:
                yield out()
    close()
    if rows:
        yield out()


def format_conversations(conversations: DataFrame, template: Template = marked, learnt: tuple[str, ...] = LEARNT, whole: bool = False, turn_bits: int = TURN_BITS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, stretch, piece, formatted, n_turns, spans, rewritten, dependent: a conversation's output is that of its pieces in order of stretch and piece."""
    stretch = F.lit(0).cast("long") if whole else F.shiftright(F.col("turn").cast("long"), turn_bits)
    d = conversations.select("conv_id", stretch.alias("stretch"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text").select("conv_id", "stretch", "role", "text")
    out = T.StructType.fromDDL(f"conv_id {d.schema['conv_id'].dataType.simpleString()}, stretch long, piece int, formatted string, n_turns int, spans array<{SPAN}>, rewritten int, dependent int")
    arrow = to_arrow_schema(out)
    most = (float("inf"), float("inf")) if whole else (piece_chars, 1 << turn_bits)
    return d.mapInArrow(lambda it: _format_pieces(it, template, arrow, learnt, *most), out)


def _digests(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hashes of each conversation, carried on from piece to piece: no conversation is held as a whole."""
    rows: list[tuple] = []
    conv, open_, n, chars, size = None, False, 0, 0, 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return batch

    for batch in batches:
        for key, formatted, spans in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ and key != conv:
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                if len(rows) >= 10_000:
                    yield out()
            if not open_ or key != conv:
                conv, open_, n, chars, size, turns, loss = key, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parse_marked(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for s in spans:
                if s["loss"]:
                    text = unescape(formatted[s["text_begin"] : s["text_end"]])
                    chars += len(text)
                    loss.update(text.encode())
            size += len(formatted)
    if open_:
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
    if rows:
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and the digests of what the marked output says. A SHA-256 is one sequence: each conversation is hashed by one task, piece by piece."""
    d = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "piece").select("conv_id", "formatted", "spans")
    out = T.StructType.fromDDL(f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    arrow = to_arrow_schema(out)
    return d.mapInArrow(lambda it: _digests(it, arrow), out)


#: The conversation whose texts look like the template's own marks.
TRAP = r"\### Assistant: </turn> ok"


def chat_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and number -7, formatted, written, and read back."""
    spark = conversations.sparkSession
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(trap)
    return read_back(written(format_conversations(every), "chat"))


def chat_sql() -> str:
    """The same rows in DuckDB; the escapes are counted from the texts."""
    runs = "list_sum(list_transform(regexp_extract_all({0}, '###+'), lambda m: length(m) - 2))"
    signs = f"(length(text) - length(replace(text, '\\', ''))) + coalesce({runs.format('text')}, 0) + (length(text) - length(replace(text, '</turn>', ''))) // 7"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
    e AS (SELECT *, length(role) + len(regexp_extract_all(role, '[\\\\#<:\\n]')) + length(text) + {signs} + {len(BEGIN + SAYS + END)} AS chars FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""
