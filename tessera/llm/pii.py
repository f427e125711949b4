"""Personal data: regular expressions propose, checksums confirm, context adjusts the score.

Only DataFrame functions run here. Matches are leftmost and do not overlap within
a kind. Positions come from the pieces between matches (``split`` and
``regexp_extract_all`` walk a text alike), so offsets count code points.

Defined cases: a null text is the empty text; an empty text has no spans; equal
texts give equal rows, one for each input row; columns besides the id and the text
are ignored; an empty table gives an empty result. Loops in the patterns are
possessive, so that a text of a million digits neither overflows the stack nor
backtracks, and a match starts only where a run starts or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# National lengths of an IBAN.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Code points before a span that are searched for context words.
CONTEXT_BEFORE = 48


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``score`` is in hundredths; ``boost`` is added near a context word."""

    name: str
    pattern: str
    may_match: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    context: str
    score: int
    boost: int = 15
    base: bool = True


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the moved and spelled-out account number leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(moved, i, F.lit(1))) - 1
        return F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _digits_between(m: Column, others: str, low: int, high: int) -> Column:
    return F.length(F.translate(m, others, "")).between(low, high)


def _ip_parts(m: Column) -> Column:
    def small(p: Column) -> Column:
        z = F.ltrim(p, F.lit("0"))
        return F.coalesce(F.when(F.length(z) == 0, True).when(F.length(z) <= 3, z.cast("int") <= 255), F.lit(False))

    return F.forall(F.split(m, r"\."), small)


def _iban_length(m: Column) -> Column:
    country = F.substring(m, 1, 2)
    want = None
    for c, n in IBAN_LENGTHS.items():
        want = F.when(country == c, n) if want is None else want.when(country == c, n)
    return F.coalesce(F.length(m) == want, F.lit(False))


KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        lambda m: F.lit(True),
        r"mail|contact|write|address|kontakt|correo|courriel",
        85,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        _ip_parts,
        r"\bip\b|host|server|address|login",
        60,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9][0-9\x20-]{14,}[0-9]"),
        lambda m: F.when(_digits_between(m, " -", 16, 19), luhn(F.translate(m, " -", ""))).otherwise(False),
        r"card|visa|credit|payment|karte|tarjeta|carte",
        80,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        lambda m: _digits_between(m, "+ ().-", 8, 15),
        r"phone|call|tel|mobile|fax",
        60,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
        lambda m: F.when(_iban_length(m), mod97(m)).otherwise(False),
        r"iban|account|bank|konto|cuenta|compte",
        85,
        base=False,
    ),
)

_SPANS = "array<struct<kind:string,s:int,e:int,score:int>>"


def _spans_of(text: Column, kind: Kind) -> Column:
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["g"])
        e = s + F.coalesce(F.length(x["h"]), F.lit(0))
        near = F.lower(F.substring(text, F.greatest(s - CONTEXT_BEFORE, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT_BEFORE))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.boost).otherwise(0)
        span = F.struct(F.lit(kind.name).alias("kind"), s.alias("s"), e.alias("e"), score.alias("score"))
        keep = x["h"].isNotNull() & kind.confirm(x["h"])
        return F.struct(e.alias("pos"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, start, add, lambda acc: acc["out"])
    return F.when(kind.may_match(text), found).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: its id and, for each kind, ``<kind>_spans`` (start, end exclusive, score)."""
    t = docs.select(F.col(id_col), whole_text(docs, text_col).alias("t"))
    return t.select(id_col, *[_spans_of(F.col("t"), k).alias(f"{k.name}_spans") for k in kinds])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """The documents with every confirmed span replaced by a mark of its kind."""
    t = docs.select(F.col(id_col), whole_text(docs, text_col).alias("t"))
    spans = F.array_sort(F.concat(*[F.transform(_spans_of(F.col("t"), k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))) for k in KINDS]))
    t = t.select(id_col, "t", spans.alias("spans"))
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("t"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        new = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, F.format_string(mark.replace("{}", "%s"), x["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    done = F.aggregate("spans", init, step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length(F.col("t")))))
    return t.select(id_col, done.alias(text_col))


def _joined(spans: Column, with_score: bool = False) -> Column:
    parts = lambda x: [x["kind"], x["s"].cast("string"), (x["score"] if with_score else x["e"]).cast("string")]
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", *parts(x))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns over ``find_pii``; ``scores`` and ``n_iban`` are added."""
    found = find_pii(docs)
    base = F.concat(*[F.col(f"{k.name}_spans") for k in KINDS if k.base])
    every = F.concat(*[F.col(f"{k.name}_spans") for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        _joined(every, with_score=True).alias("scores"),
    )


def pii_sql() -> str:
    """The same rows in DuckDB, whose engine has the contract's patterns as they stand."""
    rx = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    }
    countries = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items())
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": """length(translate(m, ' -', '')) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(translate(m, ' -', '')) + 1), lambda j:
            CASE WHEN j % 2 = 0 THEN (CASE WHEN try_cast(reverse(translate(m, ' -', ''))[j] AS INT) > 4 THEN 2 * try_cast(reverse(translate(m, ' -', ''))[j] AS INT) - 9
            ELSE 2 * try_cast(reverse(translate(m, ' -', ''))[j] AS INT) END) ELSE try_cast(reverse(translate(m, ' -', ''))[j] AS INT) END)) % 10 = 0""",
        "phone": "length(translate(m, '+ ().-', '')) BETWEEN 8 AND 15",
        "iban": f"""coalesce(length(m) = (CASE substr(m, 1, 2) {countries} END), false) AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c:
            (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::BIGINT)), lambda a, v: (CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END) % 97) = 1""",
    }
    names = [k.name for k in KINDS]
    each = " UNION ALL ".join(f"SELECT doc_id, t, {o} AS ord, '{n}' AS kind, regexp_extract_all(t, '{rx[n]}') AS h, string_split_regex(t, '{rx[n]}') AS g FROM d" for o, n in enumerate(names))
    check = " ".join(f"WHEN '{n}' THEN ({valid[n]})" for n in names)
    score = " ".join(
        f"WHEN '{k.name}' THEN {k.score} + CASE WHEN regexp_matches(lower(substr(t, greatest(s - {CONTEXT_BEFORE}, 0) + 1, least(s, {CONTEXT_BEFORE}))), '{k.context}') THEN {k.boost} ELSE 0 END" for k in KINDS
    )
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{n}'), 0)::BIGINT AS n_{n}" for n in names)
    base = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    k AS ({each}),
    x AS (SELECT doc_id, t, ord, kind, h[i] AS m,
        (list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0))::BIGINT AS s
        FROM (SELECT doc_id, t, ord, kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM k)),
    v AS (SELECT doc_id, ord, kind, s, s + length(m) AS e, (CASE kind {score} END) AS score FROM x WHERE (CASE kind {check} END)),
    a AS (SELECT doc_id, {counts},
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (WHERE kind IN ({base})) AS b,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans,
        string_agg(kind || ':' || s || ':' || score, ',' ORDER BY ord, s) AS scores FROM v GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in names)}, sha256(coalesce(b, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
    FROM d LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM d.doc_id"""
