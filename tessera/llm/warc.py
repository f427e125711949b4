"""WARC archives: written with an index, read back by coalesced byte ranges.

Index first: a writer returns, for each record, the archive's path, the record's offset and length, its
URL and its payload digest. That index is a table; what is to be read is selected there, and the
selected records are fetched by sorted byte ranges: ranges of one archive that lie within GAP bytes of each other
become one read of at most RUN bytes. No archive is read for records that were not selected.

Each record is a gzip member of its own, as the format asks, so that a range of bytes is a readable record.
Of records with equal payloads the one with the largest page id is the response, the others are
revisits that refer to it. A first pass finds the digests that pages share; in a second one payloads are
compressed where they are read, and the compressed records meet those digests. Archives are files of
``spark.checkpoint.dir`` or of a folder that the caller names, opened by the file system of their URI. A task writes
archives under names that no other attempt uses, and only the index of the attempt that Spark
commits names them; a lost executor's archives are written again by the attempt that replaces it.

Defined cases: a null payload is the empty one, which is a payload like any other; a null URL is the empty
string; a null page id counts as the smallest and comes back null, in ``refers_to`` too; repeated page ids give a record each
(of equal payloads under the largest id one record is the response, that with the smallest URL, and the others revisit it); a
very long payload is one record and is held whole; columns besides id, URL and payload are ignored, whatever their names; an
empty table gives an empty index. Archives stay until the caller deletes their folder: the index names them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written

#: Payloads of fewer bytes are responses even where they are equal.
LEAST_REVISIT = 0
#: Bytes of an archive before the next one begins.
ARCHIVE_BYTES = 64 << 20
#: Ranges at most so far apart are read together, in reads of at most RUN bytes (or of one record).
GAP, RUN = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "path string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return re.sub(r"[\r\n]+", " ", url)


def record(page_id: int, url: str, payload: bytes, kind: str, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC record, not yet compressed. A revisit has HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        held: list[tuple] = []
        size = 0
        for i, u, p in zip(ids, urls, pages):
            raw = (p or "").encode()
            digest = sha1_base32(raw)
            member = gzip.compress(record(i, u or "", raw, "response", digest, len(raw)), compresslevel=3, mtime=0)
            held.append((i, u or "", base64.b32decode(digest).hex(), len(raw), member))
            size += len(member)
            if size > 4 << 20:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*held), kinds)], names=["page_id", "url", "digest", "size", "member"])


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    sink, path, at = None, "", 0
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in INDEX.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if sink is None or at >= ARCHIVE_BYTES:
                if sink is not None:
                    sink.close()
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, at = f"{folder}/{name}", 0
                sink = store.open_output_stream(f"{base}/{name}", compression=None)  # the members are compressed already
            revisit = r["revisit"]
            digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
            member = gzip.compress(record(r["page_id"], r["url"], b"", "revisit", digest, r["size"], r["refers_to"]), compresslevel=3, mtime=0) if revisit else r["member"]
            sink.write(member)
            rows.append((path, at, len(member), r["page_id"], r["url"], digest, r["size"], "revisit" if revisit else "response", r["refers_to"]))
            at += len(member)
        if rows:
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
    if sink is not None:
        sink.close()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each page; returns the index as a written table."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    d = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[payload_col].alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # Digests that more than one page has: the largest page id, and how many records have it.
    sums = d.filter(F.length(payload) >= least_revisit).groupBy(F.sha1(payload).alias("digest"), "page_id").agg(F.count(F.lit(1)).alias("m"))
    groups = sums.groupBy("digest").agg(F.max(F.struct("page_id", "m")).alias("x"), F.sum("m").alias("n")).filter("n > 1").select("digest", F.col("x.page_id").alias("first"), F.col("x.m").alias("m"), F.lit(True).alias("shared"))
    groups = written(groups, "warc-shared")
    packed = d.mapInArrow(_packed_batches, "page_id bigint, url string, digest string, size bigint, member binary")
    marked = packed.join(groups, "digest", "left").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first")))
    # Only records that repeat the largest id of their payload have to be told apart; the others are known as they are.
    tied = F.col("shared").isNotNull() & F.col("is_first") & (F.col("m") > 1)
    place = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
    other = marked.filter(~F.coalesce(tied, F.lit(False))).withColumn("revisit", F.col("shared").isNotNull() & ~F.col("is_first"))
    if not groups.filter("m > 1").isEmpty():
        other = other.unionByName(marked.filter(tied).withColumn("revisit", place > 1))
    marked = other.select("page_id", "url", "digest", "size", F.when(~F.col("revisit"), F.col("member")).alias("member"), "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))
    return written(marked.mapInArrow(lambda it: _write_batches(it, folder), INDEX), "warc-index")


def parse_record(raw: bytes) -> dict:
    """A record's headers, HTTP headers and payload from its uncompressed bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:] if ": " in line)
    return fields


def ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, end) of sorted records that one read fetches."""
    out, first = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP or offsets[i] + lengths[i] - offsets[first] > RUN:
            out.append((first, i))
            first = i
    return out


def _page_of(urn: str) -> int | None:
    page = urn.rsplit(":", 1)[1].rstrip(">")
    return None if page == "None" else int(page)


READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def _read_batches(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in READ.split(", ")]
    source, opened = None, None
    for batch in batches:
        paths = batch.column("path").to_pylist()
        offsets, lengths = (batch.column(c).to_numpy() for c in ("offset", "length"))
        cut = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1]], len(paths)]
        for lo, hi in zip(cut, cut[1:]):
            if lo == hi:
                continue
            if paths[lo] != opened:
                if source is not None:
                    source.close()
                store, path = fs.FileSystem.from_uri(paths[lo])
                source, opened = store.open_input_file(path), paths[lo]
            for a, b in ranges(offsets[lo:hi], lengths[lo:hi]):
                begin, end = int(offsets[lo + a]), int(offsets[lo + b - 1] + lengths[lo + b - 1])
                source.seek(begin)
                raw = source.read(end - begin)
                rows = []
                for i in range(lo + a, lo + b):
                    at = int(offsets[i]) - begin
                    r = parse_record(zlib.decompress(raw[at : at + int(lengths[i])], 31))
                    digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = r["WARC-Type"] == "response"
                    if response and sha1_base32(r["payload"]) != digest:
                        raise ValueError(f"{paths[lo]} at {begin + at}: the payload does not have the digest of its header")
                    size = len(r["payload"]) if response else int(r["http"]["Content-Length"])
                    rows.append((_page_of(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["WARC-Type"], None if response else _page_of(r["WARC-Refers-To"]), digest, size, r["payload"] if payloads and response else None))
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
    if source is not None:
        source.close()


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The selected records of an index. ``payload`` is null for revisits, and for all where it is not wanted.

    Records are dealt out by archive and stretch of RUN bytes, so that neighbours meet in one task.
    """
    d = index.select("path", "offset", "length", F.floor(F.col("offset") / RUN).alias("stretch"))
    # The number is given, because index rows are few bytes that stand for many: merged by their own size they would end in a few tasks.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, "path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return d.mapInArrow(lambda it: _read_batches(it, payloads), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: from the archives, after all pages were written."""
    r = read_warc(write_warc(pages), payloads=False)
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_sql() -> str:
    """The same rows in DuckDB: base32 from the digest's bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "unhex(sha1(coalesce(html, '')))::BIT::VARCHAR"
    value = " + ".join(f"{1 << (4 - j)} * substr(b, 5 * i + {j + 1}, 1)::INT" for j in range(5))
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {bits} AS b FROM pages),
    d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: '{alphabet}'[({value}) + 1]), 'string_agg', '') AS payload_digest FROM p),
    m AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN place > 1 THEN first END AS refers_to FROM m"""
