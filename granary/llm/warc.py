"""WARC archives: writing with revisits and segments, and reading back.

Writing: of the pages with equal payloads, the one with the largest id is a response
and the others revisit it. A payload goes out as an HTTP response with chunked transfer
framing; a block longer than ``segment`` bytes is cut into a first record and continuation
records. Archives are whole-file gzip, written by Spark to the shared folder.

Reading: archives come in as binary files of bounded size, whole-file gzip, one gzip member for each record, or plain;
they are inflated and parsed step by step. A page's records are grouped by origin identifier and target, ordered by segment number and
checked against the total length; then chunked framing is decoded. A page whose records all come by in one task is put together
there; records of the others, as of pages that go on in another archive, are grouped by a shuffle. A page stands as often as
its first record, if each of its records stands at all.

Plan: digests are computed on the JVM; the largest id per digest is summed before the
shuffle and joined back to ids alone, evenly (``common.joined_evenly``), so a payload that very many pages share moves only
ids. Payloads are shuffled once to be written. Reading shuffles a short row of each page, with its payload only if that is asked for, and the
records of pages that no task met whole. A task merges equal rows among those that it holds, and equal records are one
before they are grouped, so a group is as large as one page, however often its row stands.

Defined cases: null html is an empty payload, as is an empty one; a very long payload is many segments; a null page_id never is the
largest, unless all ids of a payload are null; rows that are wholly equal give equal records, one each; rows of one id and
payload but different urls are pages of their own; a null url gives no target field; ties for the largest id are the same id; an
empty table gives an empty archive; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_evenly, shared_path, written

CRLF = b"\r\n"
SEGMENT = 16 << 10
CHUNK = 4096
#: Bytes of records in one row of an archive, and such rows in one file.
ROW_BYTES = 4 << 20
ROWS_EACH = 4
#: Bytes of records that a task holds for pages which are not yet whole, and what a row counts beside its block.
HELD_BYTES = 16 << 20
ROW_COST = 256
#: Bytes that one step of inflating takes in.
STEP = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ``ValueError`` if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, ident: str, block: bytes, **fields: str | int | None) -> bytes:
    """One record; field names are given with underscores."""
    names = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in names.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return b"".join([head.encode(), block, CRLF, CRLF])


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    ident = f"urn:page:{'null' if page_id is None else page_id}:{digest}"
    fields = {"WARC_Target_URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"), "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield record("revisit", ident, HEAD, WARC_Profile=REVISIT, WARC_Refers_To=f"<{refers_to}>", WARC_Payload_Length=len(payload), **fields)
        return
    block = HEAD + chunked(payload)
    if len(block) <= segment:
        yield record("response", ident, block, **fields)
        return
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    yield record("response", ident, parts[0], WARC_Segment_Number=1, **fields)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield record("continuation", f"{ident}:{k}", part, WARC_Target_URI=fields["WARC_Target_URI"], WARC_Segment_Number=k, WARC_Segment_Origin_ID=f"<{ident}>", WARC_Segment_Total_Length=total)


def inflated(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """The bytes of an archive in turn: of all gzip members one after the other, or as they are."""
    if not data.startswith(b"\x1f\x8b"):
        yield from (data[a : a + step] for a in range(0, len(data), step))
        return
    view, at, member = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + step]
        out = member.decompress(part)
        at += len(part) - len(member.unused_data)
        if out:
            yield out
        if member.eof:
            while at < len(view) and view[at] == 0:  # padding after a member
                at += 1
            member = zlib.decompressobj(31)
        elif at >= len(view):
            raise ValueError("the archive ends inside a gzip member")


def records_in(parts: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record in an archive's bytes; field names are lower case."""
    parts = iter((parts,)) if isinstance(parts, bytes) else parts
    held, done = bytearray(), 0

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held.startswith(b"WARC/1.") or end < 0:
            raise ValueError(f"no record at byte {done}")
        lines = held[:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        last = end + 4 + int(fields["content-length"])
        while len(held) < last + 4 and more():
            pass
        if len(held) < last + 4 or held[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where its length says")
        block = bytes(held[end + 4 : last])
        del held[: last + 4]
        done += last + 4
        yield fields, block


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write the pages' records below ``path``; payloads of under ``least_bytes`` are never revisits."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"))
    ids = keyed.where(F.octet_length("html") >= least_bytes).select("key", "page_id", "sha").distinct()
    last = written(ids.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "largest")
    met = joined_evenly(ids, last, ["sha"], "n", last.agg(F.sum("n")).first()[0] or 0, F.col("key"))
    revisits = met.where(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))).select("key", "sha", "last")
    told = keyed.join(revisits, ["key", "sha"], "left").select("page_id", "url", "html", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-2]], pa.binary())], names=["block"])

        for batch in batches:
            for page_id, url, text, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                payload = text.encode()
                digest = base32_sha1(payload)
                for x in records_of(page_id, url, payload, digest, None if refers is None else f"urn:page:{refers}:{digest}", segment):
                    parts.append(x)
                    size += len(x)
                    if size >= ROW_BYTES:
                        yield row()
                        parts, size = [], 0
        if parts:
            yield row()

    rows = told.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", ROWS_EACH).text(path)


class Record(NamedTuple):
    """One record; or, put together of all its records, a page: ``number`` counts these, ``length`` and ``block`` are the payload's."""

    origin: str
    number: int
    total: int | None
    kind: str
    url: str | None
    digest: str | None
    refers_to: str | None
    length: int | None
    block: bytes | None


RECORD = "origin string, number int, total long, kind string, url string, digest string, refers_to string, length long, block binary"
FOUND = f"whole boolean, copies long, {RECORD}"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, url string, payload binary"


def batches_of(rows: Iterable[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``ROW_BYTES``; a row's last value is its longest."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += ROW_COST + len(row[-1] or "")
        if size > ROW_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def records_of_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive in turn."""
    bare = lambda x: x.strip("<>") if x else None
    number = lambda x: int(x) if x else None
    for f, block in records_in(inflated(content)):
        segment, get = f.get("warc-segment-number"), f.get
        origin = bare(get("warc-segment-origin-id") or f["warc-record-id"])
        total = number(get("warc-segment-total-length")) or (None if segment else len(block))
        digest = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
        yield Record(origin, int(segment or 1), total, f["warc-type"], get("warc-target-uri"), digest, bare(get("warc-refers-to")), number(get("warc-payload-length")), block)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def records_of_archives(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for content in batch.column(0):
            yield from records_of_archive(content.as_py())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``; ``origin`` is the record that a continuation belongs to."""
    return archives(spark, path).mapInArrow(lambda batches: batches_of(records_of_archives(batches), RECORD), RECORD)


def page_of(parts: Iterable[Record], keep_payload: bool) -> Record:
    """The page of these records."""
    by_number = {p.number: p for p in parts}
    n = len(by_number)
    origin = next(iter(by_number.values())).origin
    if sorted(by_number) != list(range(1, n + 1)):
        raise ValueError(f"{origin}: segments are missing")
    first, block = by_number[1], b"".join(by_number[k].block for k in range(1, n + 1))
    if by_number[n].total != len(block):
        raise ValueError(f"{origin}: {len(block)} bytes, not {by_number[n].total}")
    if first.kind == "revisit":
        return first._replace(number=n, total=None, block=None)
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4 :])
    if (digest := base32_sha1(payload)) != first.digest:
        raise ValueError(f"{origin}: the payload is not what its digest says")
    return Record(origin, n, None, "response", first.url, digest, None, len(payload), payload if keep_payload else None)


def settled(records: Iterable[Record], keep_payload: bool, most: int = HELD_BYTES) -> Iterator[tuple]:
    """Rows of ``FOUND``: pages whose records are all among these, and the records that are left. A page takes one copy of each."""
    held, held_size = {}, 0
    out, out_size = {}, 0

    def put(whole: bool, row: Record) -> None:
        nonlocal out_size
        known = out.get((whole, row))
        out[whole, row] = (known or 0) + 1
        out_size += 0 if known else ROW_COST + len(row.block or b"")

    for record in records:
        key = record.origin, record.url
        parts = held.setdefault(key, {})
        if record.number in parts:  # of another copy: the earlier one goes on
            for p in parts.values():
                put(False, p)
                held_size -= ROW_COST + len(p.block)
            parts.clear()
        parts[record.number] = record
        held_size += ROW_COST + len(record.block)
        if 1 in parts and len(parts) in parts and parts[len(parts)].total is not None:
            put(True, page_of(parts.values(), keep_payload))
            held_size -= sum(ROW_COST + len(p.block) for p in held.pop(key).values())
        elif held_size > most:
            for p in chain.from_iterable(parts.values() for parts in held.values()):
                put(False, p)
            held, held_size = {}, 0
        if out_size > ROW_BYTES:
            yield from ((whole, copies, *row) for (whole, row), copies in out.items())
            out, out_size = {}, 0
    for p in chain.from_iterable(parts.values() for parts in held.values()):
        put(False, p)
    yield from ((whole, copies, *row) for (whole, row), copies in out.items())


def gathered(found: DataFrame, keep_payload: bool) -> DataFrame:
    """One row per response or revisit, of rows that ``settled`` returns."""
    part = ("whole", *Record._fields[1:])
    columns = PAGE if keep_payload else PAGE.removesuffix(", payload binary")
    once = found.repartition("origin", "url").groupBy("origin", *part).agg(F.sum("copies").alias("copies"))
    grouped = once.groupBy("origin", "url").agg(F.sort_array(F.collect_list(F.struct(*part, "copies"))).alias("parts")).select("origin", "parts")
    page_id = lambda x: None if not x or (m := re.match(r"urn:page:(-?\d+)", x)) is None else int(m[1])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole, rest = [], []
                for p in parts.as_py():
                    copies, done = p.pop("copies"), p.pop("whole")
                    (whole if done else rest).append((Record(origin, **p), copies))
                if rest:
                    lacking = whole and {p.number for p, _ in rest} != set(range(1, whole[0][0].number + 1))
                    page = whole[0][0] if lacking else page_of((p for p, _ in rest), keep_payload)
                    whole.append((page, sum(n for p, n in rest if p.number == 1)))
                for p, copies in whole:
                    row = page_id(origin), p.length, p.digest, p.kind, page_id(p.refers_to), p.number, p.url, p.block
                    yield from repeat(row if keep_payload else row[:-1], copies)

    return grouped.mapInArrow(lambda batches: batches_of(pages(batches), columns), columns)


def reassembled(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per response or revisit, with its payload put together, checked and decoded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            yield from (Record(*(c[k].as_py() for c in batch.columns)) for k in range(batch.num_rows))

    return gathered(records.select(*Record._fields).mapInArrow(lambda batches: batches_of(settled(rows(batches), keep_payload), FOUND), FOUND), keep_payload)


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """``reassembled`` of all records below ``path``; a page that one task reads whole leaves it as one row."""
    return gathered(archives(spark, path).mapInArrow(lambda batches: batches_of(settled(records_of_archives(batches), keep_payload), FOUND), FOUND), keep_payload)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as archives in the shared folder and read back."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives hold, from the pages themselves; base32 takes five hex digits to four letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p),
n AS (SELECT *, [CAST('0x' || substr(hex, 5 * g + 1, 5) AS INTEGER) FOR g IN range(8)] AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[CAST(k // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM n
"""
