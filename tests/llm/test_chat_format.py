"""Chat formatting: spans, masks, rewritten histories, round trips, DuckDB."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as C

from .fixtures import awkward, prose

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "#", "##", "###", "####", "##### a", "\\###", "</turn>", " </turn>\n", "<</turn>", "\\</turn>", "x\\", "### assistant: x </turn>\n", C.TRAP, "a\n\nb ", " lead", "😀 </turn>", "#\\##", "</turn"]


def brute(rows):
    """The contract's columns from the rows alone, by conversation."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.marked([x[2:] for x in turns]))))
    return sorted(out, key=repr)


def run(df):
    return sorted(map(tuple, C.chat_digest(df).collect()), key=repr)


TRAPPED = [(-7, 0, "user", C.TRAP), (-7, 1, "assistant", C.TRAP)]


def test_escapes_come_back():
    r = random.Random(1)
    texts = NASTY + ["".join(r.choice("\\#</turn> \n:a") for _ in range(r.randrange(30))) for _ in range(3000)]
    for t in texts:
        assert C.unescape(C.escape(t)) == t
    turns = [(r.choice([*texts[:300], "user", "assistant"]), t) for t in texts]
    assert C.parse_marked(C.marked(turns)) == turns
    with pytest.raises(ValueError):
        C.parse_marked(C.marked(turns[:3])[:-1])


def test_spans_of_black_boxes():
    turns = [("user", "hi"), ("assistant", "a"), ("user", "b"), ("assistant", "</turn> ###")]
    boxes = {
        C.marked: (0, 0),
        lambda t: "<s>" + "".join(f"[{r}]{x}[/{r}]" for r, x in t): (0, 0),
        lambda t: "".join(f"{i}:{r}:{x}\n" for i, (r, x) in enumerate(t)): (0, 3),  # numbers its turns
        lambda t: "".join(f"{r}:{x if i + 2 >= len(t) else '...'}\n" for i, (r, x) in enumerate(t)): (2, 2),  # drops old texts
        lambda t: "".join(f"{r}:{x}\n" for r, x in t) + "end": (4, 4),  # closes every output
    }
    for box, (rewritten, dependent) in boxes.items():
        out, spans, a, b = C.locate(box, turns)
        assert (a, b) == (rewritten, dependent)
        assert out == box(turns)[len(box([])) :]
        if not rewritten:
            assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]] and spans[-1][1] == len(out)
            want = [C.escape(x) if box is C.marked else x for _, x in turns]
            assert [out[s[2] : s[3]] for s in spans] == want
    with pytest.raises(ValueError):
        C.locate(lambda t: "".join(f"{len(x)}:{x};" for _, x in t), turns)


def test_query_matches_brute_force_and_sql(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()] + TRAPPED)
    assert run(d) == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(c.sql(C.chat_sql()).fetchall(), key=repr) == want


def odd_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, i - 5, ("user", "assistant", None, "a:b\\#<\n")[i % 4], t) for i, t in enumerate(awkward())]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "system", "s"), (4, 0, "assistant", prose(1, 200_000)), (4, 1, "user", "</turn>" * 50_000)]
    rows += [(5, 3 * i, ("user", "assistant")[i % 2], f"turn {i} " + "#" * (i % 7)) for i in range(500)]
    return rows


def test_odd_rows_and_clashing_columns(spark):
    d = spark.createDataFrame(odd_rows(), SCHEMA)
    c = duckdb.connect()
    c.register("conversations", d.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    more = d.select("*", *[F.lit("x").alias(n) for n in ("stretch", "piece", "formatted", "spans", "n_turns", "rewritten")]).repartition(3)
    want = brute(odd_rows() + TRAPPED)
    assert run(d) == want == run(more)
    assert sorted(c.sql(C.chat_sql()).fetchall(), key=repr) == want
    assert run(d.filter("false")) == brute(TRAPPED)


def test_long_conversations_are_cut_and_come_together(spark):
    d = spark.createDataFrame(odd_rows(), SCHEMA)
    pieces = C.format_conversations(d).orderBy("conv_id", "stretch", "piece").collect()
    assert sum(p.conv_id == 5 for p in pieces) > 20 and not any(p.rewritten or p.dependent for p in pieces)
    whole = {r.conv_id: r for r in C.format_conversations(d, whole=True).collect()}
    for conv, w in whole.items():
        assert "".join(p.formatted for p in pieces if p.conv_id == conv) == w.formatted
        assert sum(p.n_turns for p in pieces if p.conv_id == conv) == w.n_turns == len(w.spans)
    many = spark.createDataFrame([(8, 0, "user", "")] * 1000 + [(8, 0, "assistant", "x")] * 500, SCHEMA)
    parts = C.format_conversations(many).collect()
    assert len(parts) == 24 and sum(p.n_turns for p in parts) == 1500 and max(p.n_turns for p in parts) == 64
    assert run(many) == brute([tuple(r) for r in many.collect()] + TRAPPED)
    small = C.format_conversations(d, piece_chars=1).filter("conv_id = 3").orderBy("stretch", "piece").collect()
    assert len(small) == 4 and "".join(p.formatted for p in small) == whole[3].formatted


def test_templates_that_look_back_are_told(spark):
    d = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], SCHEMA)
    count = lambda t: "".join(f"{i} {x}\n" for i, (_, x) in enumerate(t))
    drop = lambda t: "".join(f"{x if i + 1 == len(t) else '-'}\n" for i, (_, x) in enumerate(t))
    got = [C.format_conversations(d, f, whole=True).first() for f in (count, drop)]
    assert [(r.rewritten, r.dependent > 0) for r in got] == [(0, True), (4, True)]
