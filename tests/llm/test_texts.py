"""Line dedup, decontamination, personal data, licences, archives, classifier and near copies against brute force."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm import licences, line_dedup, pii, pu_quality, similar, warc

from .fixtures import WORD, awkward, docs, prose, table_docs


def brute_lines(texts, t=line_dedup.GUARANTEE):
    """Kept text of each document by the rules of the module: windows, minima and runs as lists of lines, in plain Python."""
    lines = {i: [(p, x, len(WORD.findall(x))) for p, x in enumerate((s or "").split("\n")) if WORD.search(x)] for i, s in texts.items()}
    weight = lambda x: xxhash.xxh3_128_digest(x.encode())
    occurrences = collections.defaultdict(list)
    for i in lines:
        a = lines[i]
        chosen = set()
        for k in range(len(a)):
            for m in range(k + 1, len(a) + 1):
                if sum(n for _, _, n in a[k:m]) >= t:
                    chosen.add(max(j for j in range(k, m) if weight(a[j][1]) == min(weight(x) for _, x, _ in a[k:m])))
                    break
        for f in chosen:
            for k in range(len(a)):
                lo, hi = min(f, k), max(f, k)
                if sum(n for _, _, n in a[lo + 1 : hi]) < t and (k == f or a[k][2] < t):
                    occurrences[k > f, k < f, tuple(x for _, x, _ in a[lo : hi + 1])].append((i, a[k][0]))
    gone = {x for places in occurrences.values() for x in places if x != min(places)}
    return {i: "\n".join(x for p, x in enumerate((s or "").split("\n")) if (i, p) not in gone) for i, s in texts.items()}


def lines_table(spark):
    head = "a header line that all of them share"
    poem = "one two\nthree\nfour five\nsix\nseven\n" * 6
    passage = "\n".join(prose(70 + i, 9) for i in range(8))
    texts = [
        f"{head}\n{prose(1, 30)}\nshort\n{poem}", f"{prose(2, 30)}\n{head}\nshort", f"x\n{poem}\ny", f"{head}\n\n  \nthree\nfour five\nsix\nseven eight",
        f"{head}\n{head}\n{head}", poem, "", None, "word", f"{prose(2, 30)}", "\n".join(["a b"] * 40), "\n".join(["a b"] * 7),
        f"{prose(5, 12)}\n{passage}\n{prose(6, 12)}", f"other\n{passage}", f"{prose(7, 40)}\nA b", f"{prose(7, 40)}\nC d", f"{prose(7, 40)}\nC d", *awkward(),
    ]
    return docs(spark, texts)


def test_line_dedup_matches_brute_force(spark, sf):
    for df in (lines_table(spark), table_docs(spark, sf)):
        want = brute_lines({r.doc_id: r.text for r in df.collect()})
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
        assert got == want
    assert line_dedup.line_digest(docs(spark, [])).count() == 0


def test_repeated_passages_go_wherever_they_stand(spark):
    passage = "\n".join(prose(70 + i, 9) for i in range(8))
    texts = [f"{prose(1, 12)}\n{passage}\n{prose(2, 12)}", f"{prose(3, 40)}\n{passage}\n{prose(4, 7)}", passage]
    # The run of the second and third text is not beside the first occurrence of its long line.
    texts += [f"{prose(7, 40)}\nA b", f"{prose(7, 40)}\nC d", f"{prose(7, 40)}\nC d"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: f"{prose(3, 40)}\n{prose(4, 7)}", 2: "", 3: texts[3], 4: "C d", 5: ""}


def test_footers_and_short_copies_go(spark):
    """One footer of fifteen words between lines of 40 or 12 words, and copies of a text of ten words: the first one stays alone."""
    footer = prose(60, 15)
    for words in (40, 12):
        texts = [f"{prose(1000 + 2 * i, words)}\n{footer}\n{prose(1001 + 2 * i, words)}" for i in range(200)]
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
        assert got == {i: t if i == 0 else t.replace(f"{footer}\n", "") for i, t in enumerate(texts)}
    assert sorted(r.text for r in line_dedup.dedup_lines(docs(spark, [prose(61, 10)] * 50)).collect()) == [""] * 49 + [prose(61, 10)]


def test_line_dedup_of_odd_rows(spark):
    a, b = prose(3, 40), prose(4, 40)
    rows = [(None, a), (5, a), (7, b), (7, f"{a}\n{b}"), (7, b), (9, b)]
    df = spark.createDataFrame(rows, "doc_id int, text string").select("*", *[F.lit("x").alias(c) for c in ("n_lines", "n_removed", "lines", "gone", "id", "sum", "key", "c0")])
    out = line_dedup.dedup_lines(df)
    assert out.dtypes == df.dtypes
    first = min((xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 for t in (b, f"{a}\n{b}")) == (xxhash.xxh64_intdigest(b.encode(), 42) + 2**63) % 2**64
    want = [(None, a), (5, ""), (7, b if first else ""), (7, b if first else ""), (7, "" if first else b), (9, "")]
    assert sorted([(r.doc_id or 0, r.text) for r in out.collect()]) == sorted([(i or 0, t) for i, t in want])
    assert [r.n_removed for r in line_dedup.line_digest(df).filter("doc_id = 9").collect()] == [1]


def test_every_line_content_survives(spark, sf):
    df = table_docs(spark, sf)
    every = {x for r in df.collect() for x in r.text.split("\n")}
    assert {x for r in line_dedup.dedup_lines(df).collect() for x in r.text.split("\n")} >= {x for x in every if WORD.search(x)}


def edit_distance_inside(piece, text):
    """Least edits of a whole piece to any part of a text."""
    row = [0] * (len(text) + 1)
    for c in piece:
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    items = [prose(100 + i, 30) for i in range(4)] + ["too short", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    changed = items[2][:50] + "XY" + items[2][53:100] + items[2][101:]
    texts = [prose(1, 200), prose(2, 50) + " " + items[0] + " " + prose(3, 50), items[1].upper().replace(" ", "\n"), prose(4, 30) + changed, items[3][:60], None, "", prose(5, 20) + items[3][20:120]]
    found = {(r.doc_id, r.item_id, r.piece_start): r.edits for r in D.find_contamination(docs(spark, texts), bench).collect()}
    p = D.Pieces(list(enumerate(items)))
    want = {}
    for i, t in enumerate(texts):
        folded = D.fold((t or "").encode()).tobytes()
        for k, piece in enumerate(p.text):
            e = edit_distance_inside(piece.tobytes(), folded)
            if e <= p.edits[k]:
                want[i, p.item[k], p.at[k]] = e
    assert found == want and {d for d, _, _ in want} >= {1, 2, 3}
    assert D.decontaminate(docs(spark, texts), bench).count() == len(texts) - len({d for d, _, _ in want})
    assert D.contaminated(docs(spark, []), bench).count() == 0 and D.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def brute_base_spans(t):
    t = t or ""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, rx in kinds.items() for m in re.finditer(rx, t) if ok(k, m.group())]


def test_pii_matches_brute_force(spark, sf):
    own = [
        "mail a.b@c.de_f@g.hi and x@y or x@y.z.", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 01.002.003.0255", "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4  111", "+1 (555) 010-9999 +12 +1-----2 +123456789012345678",
        "IBAN DE89370400440532013000 or DE89370400440532013001", "é@b.co 😀 +49 30 1234567", "1" * 3000, "1 " * 9000, "a." * 5000 + "@b" + ".c" * 5000, "9.9." * 4000, None, "",
    ]
    for df in (docs(spark, own), docs(spark, awkward()), table_docs(spark, sf)):
        got = {r.doc_id: (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_digest(df).collect()}
        for r in df.collect():
            spans = brute_base_spans(r.text)
            n = collections.Counter(k for k, _, _ in spans)
            assert got[r.doc_id] == (hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), n["email"], n["ip"], n["card"], n["phone"])
    assert [r.n_iban for r in pii.pii_digest(docs(spark, own[4:5])).collect()] == [1]
    assert [r.text for r in pii.redact(docs(spark, ["to a@b.co now"])).collect()] == ["to [email] now"]


def test_licences(spark):
    mit = licences.KNOWN["MIT"][3]
    texts = [mit, mit.upper().replace(".", " ; ").replace("SUBLICENSE", "sub-license"), "(c) 2020 someone\n" + mit + "\ncopyright me", mit + " and more", "x\nReleased under the MIT license\ny", None, "", "Licensed under CC BY 4.0.\nSPDX-License-Identifier: MIT"]
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan_licences(docs(spark, texts)).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert got[4][1] == "MIT" and got[7][1] == "CC-BY-4.0,MIT"
    assert licences.scan_licences(docs(spark, [])).count() == 0


@pytest.mark.parametrize("module, name, run", [("pages", "op2", lambda d: warc.round_trip(d))])
def test_archives(spark, sf, module, name, run):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10**6 + i, None if i == 0 else f"http://x/{i}\r\n", h) for i, h in enumerate([None, "", "same", "same", "same", "é漢\x00"])], "page_id bigint, url string, html string")
    both = pages.unionByName(extra)
    index = warc.write_warc(both)
    back = {r.page_id: r for r in warc.read_warc(index).collect()}
    for r in both.collect():
        b, raw = back[r.page_id], (r.html or "").encode()
        assert b.payload_bytes == len(raw) and b.payload_digest == warc.sha1_base32(raw)
        assert (bytes(b.payload) == raw) if b.record_type == "response" else b.payload is None
    assert back[10**6].record_type == "revisit" and back[10**6].refers_to == 10**6 + 1 and back[10**6 + 4].record_type == "response"
    some = index.filter("page_id % 7 = 0")
    assert warc.read_warc(some).count() == some.count()
    assert warc.round_trip(both.limit(0)).count() == 0


def test_reads_are_coalesced():
    assert warc.ranges(np.array([0, 10, 20, 10**6]), np.array([10, 10, 10, 5])) == [(0, 3), (3, 4)]


def test_classifier_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = pu_quality.classify(d, labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert out.count() == d.count() and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    empty = pu_quality.classify(docs(spark, [None, "", "a b"]), labels.limit(0)).collect()
    assert [r.score for r in empty] == [0.5] * 3
    assert pu_quality.classify(d.limit(0), labels).count() == 0


def shingle_set(text, chain=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + chain]) for i in range(len(w) - chain + 1)) or frozenset([" ".join(w)] if w else [])


def alike(a, b):
    """The cosine of two sets of shingles is 0.8 or more."""
    return a == b or len(a & b) ** 2 >= 0.64 * len(a) * len(b) - 1e-6 and len(a & b) > 0


def brute_groups(texts):
    """The smallest number that each text is tied to by a similarity of 0.8, over all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and alike(sets[i], sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def groups_of(df, **more):
    return {r.doc_id: r.group_id for r in similar.similar_groups(df, **more).collect()}


def test_similar_groups_match_brute_force(spark, sf):
    base = prose(7, 150).split()
    near = []
    for i in range(60):
        w = list(base)
        for j in np.random.default_rng(i).integers(0, 150, i % 4):
            w[j] = f"new{i}"
        near.append(" ".join(w))
    for df, paired in ((docs(spark, near + awkward()), 100), (table_docs(spark, sf), 32)):
        want = brute_groups({r.doc_id: r.text for r in df.collect()})
        assert groups_of(df, paired=paired) == want
    assert len(set(groups_of(docs(spark, near), paired=8).values())) <= 3
    assert similar.similar_groups(docs(spark, [])).count() == 0


def test_similar_groups_in_large_parts_match_brute_force(spark, monkeypatch):
    passage = prose(1, 118, 4000)  # texts that share it have a similarity of 0.78; the pairs share three words more, 0.80
    texts = []
    for i in range(150):
        more = prose(1000 + i, 61, 4000).split()
        texts += [" ".join([passage, *more[:32]]), " ".join([passage, *more[:3], *more[32:]])]
    want = brute_groups(dict(enumerate(texts)))
    assert len(set(want.values())) > 100
    assert groups_of(docs(spark, texts)) == want
    monkeypatch.setattr(similar, "BLOCK", 64)  # many blocks
    assert groups_of(docs(spark, texts)) == want
    chains = []
    for c in range(4):  # texts that are tied to their neighbours only, and texts near to none
        w = prose(c, 150, 4000).split()
        for i in range(25):
            w = [*w[: 5 * i], *[f"new{c}x{i}x{j}" for j in range(5)], *w[5 * i + 5 :]]
            chains.append(" ".join(w))
        chains += [" ".join([*prose(c, 150, 4000).split()[:100], *prose(50 + i, 50).split()]) for i in range(10)]
    want = brute_groups(dict(enumerate(chains)))
    assert len(set(want.values())) > 4
    for paired in (2, 8):
        assert groups_of(docs(spark, chains), paired=paired) == want


def test_similar_groups_of_odd_rows(spark):
    a, b = prose(3, 80), prose(4, 80)
    rows = [(None, a, 1, 2), (5, a, 3, 4), (7, b, 5, 6), (7, a, 7, 8), (9, b + " more", 9, 10), (None, "alone here", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int, id int").withColumn("group_id", F.lit("x"))
    got = sorted(((r.doc_id, r.group_id) for r in similar.similar_groups(df).collect()), key=repr)
    # Rows that share an id count each for itself: 7 is in both groups.
    assert got == sorted([(None, 5), (5, 5), (7, 7), (7, 5), (9, 7), (None, None)], key=repr)


def test_sql_forms(spark, sf):
    from tessera.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        want = c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        pick = lambda columns, rows: sorted((tuple(r[columns.index(x)] for x in cols) for r in rows), key=repr)
        assert pick(df.columns, [tuple(r) for r in df.collect()]) == pick(want.columns, want.fetchall())
