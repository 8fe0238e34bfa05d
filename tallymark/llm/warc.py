"""WARC archives of pages: a writer, and a reader that salvages damaged files.

Every page is one record in a gzip member of its own. Records with equal
payloads are stored once: the largest page_id holds the response, the others are
revisits that name it. Spark's text writer lays the members down, so retried
and speculative tasks leave no half-written archive: a member ends in the four
bytes of its length, whose last one is zero below 16 MB (larger members are
followed by an empty one), and this zero is the writer's line separator.

The reader takes gzip members and plain records as they come. Each must inflate,
match its checksum and length, begin with a version line, hold as many bytes as
it says, end in two line breaks and agree with its digests. Where a check fails,
it searches for the next member or version line that passes all of them, goes on
from there and logs the bytes between as a gap. A member of many records gives
those before its damage. In damaged places a record inside a payload counts as a
record, since nothing tells it apart.

Defined results: a null html is an empty payload; a null page_id is smaller than
any other, a null or blank url is replaced by a name made of the id; rows that
share the largest page_id of a payload are all responses; an empty table gives
archives without records; extra columns are ignored. An archive is read whole by
one task: the writer closes it after about ``archive_bytes``, and Spark's reader
of binary files takes at most 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.session import delete_at_exit, scratch_path, stage_table

ARCHIVE_BYTES = 32 << 20  # of payloads, before compression
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEED = 1 << 16
GZIP_START = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d{1,2}\r\n")
END = b"\r\n\r\n"


# --- writing ----------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, uncompressed; ``refers_to`` makes it a revisit, which leaves the payload out."""
    name = f"urn:page:{'' if page_id is None else page_id}"
    # Line breaks and blanks would end a header; they stand percent-encoded.
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip()) or name
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def with_responses(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, int, int]:
    """page_id, url, html bytes and refers_to (null: a response) of every page; rows; payload bytes.

    Payloads are equal when length, SHA-1 and a second hash agree. Only keys are
    grouped; then every page meets its group, a frequent payload over many tasks.
    """
    html = C.whole_text("html")
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.cast("binary").alias("html"),
        F.struct(F.octet_length(html).cast("bigint").alias("n"), F.sha1(html.cast("binary")).alias("sha"),
                 F.xxhash64(html).alias("x")).alias("key"))
    groups = stage_table(keyed.groupBy("key").agg(
        F.count("*").alias("rows"), F.max("page_id").alias("top")), "payloads")
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                       F.coalesce(F.sum(F.col("rows") * F.col("key.n")), F.lit(0)).alias("bytes")).first()
    repeated = groups.where((F.col("rows") > 1) & (F.col("key.n") >= min_bytes))
    met = C.join_groups(keyed, repeated, "key", "rows", total["rows"])
    return (met.select("page_id", "url", "html",
                       F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")),
            total["rows"], total["bytes"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages under ``path``."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(
                    [member(record(r["page_id"], r["url"], r["html"], r["refers_to"])) for r in part],
                    pa.binary())], ["value"])

    decided, rows, size = with_responses(pages, min_bytes)
    per_archive = max(1, archive_bytes * rows // max(1, size))
    (decided.mapInArrow(build, "value binary")
     # The writer adds the last byte of each member.
     .select(F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", min(per_archive, 1 << 31)).text(path))


# --- reading ----------------------------------------------------------------------------------


class Damage(Exception):
    """Why the bytes at a place are no record."""


@dataclass
class Entry:
    """A record, or with ``reason`` a gap: bytes of the archive that held none.

    ``inner`` and ``inner_length`` are the place in the inflated member.
    """

    start: int
    length: int
    inner: int = 0
    inner_length: int = 0
    reason: str | None = None
    fields: dict[str, str] | None = None
    payload: bytes = b""


class _Finder:
    """The next place of a pattern at or after rising positions, each byte searched once."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.found, self.asked = data, pattern, -2, 0

    def after(self, at: int) -> int:
        if self.found == -2 or at < self.asked or -1 < self.found < at:
            self.found = self.data.find(self.pattern, at)
        self.asked = at
        return len(self.data) if self.found < 0 else self.found


def _parse(data: bytes, at: int, ends: _Finder) -> tuple[Entry, int]:
    """The record at ``at`` and the place after it."""
    version = VERSION.match(data, at)
    if not version:
        raise Damage("no version line")
    head_end = ends.after(version.end() - 2)
    if head_end == len(data):
        raise Damage("headers do not end")
    fields: dict[str, str] = {}
    last = None
    for line in data[version.end():head_end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif colon:
            last = name.strip().lower()
            fields[last] = value.strip()
        elif line:
            raise Damage("a header without a name")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damage("no length")
    begin = head_end + len(END)
    stop = begin + int(fields["content-length"])
    if data[stop:stop + len(END)] != END:
        raise Damage("the record does not end where it says")
    block = data[begin:stop]
    if _differs(fields.get("warc-block-digest"), block):
        raise Damage("block digest")
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(END)
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields["http-" + name.strip().lower()] = value.strip()
    if fields.get("warc-type") != "revisit" and _differs(fields.get("warc-payload-digest"), payload):
        raise Damage("payload digest")
    return Entry(at, stop + len(END) - at, fields=fields, payload=payload), stop + len(END)


def _differs(said: str | None, data: bytes) -> bool:
    """Whether a SHA-1 digest is given and is another one; other algorithms are not judged."""
    kind, _, value = (said or "").partition(":")
    return kind.lower() == "sha1" and value.upper() != digest(data)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` holds, the place after it, and what is wrong with it."""
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if place >= len(data):
                return b"".join(out), place, "the member is cut"
            out.append(unpack.decompress(data[place:place + FEED]))
            place += FEED
    except zlib.error as error:
        return b"".join(out), place, f"the member does not inflate: {str(error)[:60]}"
    return b"".join(out), min(place, len(data)) - len(unpack.unused_data), None


def _plain(data: bytes) -> Iterator[Entry]:
    """Records and gaps of inflated bytes."""
    return _walk(data, lambda at, ends: (lambda e, after: ([e], after, None))(*_parse(data, at, ends)), (b"WARC/",))


def _walk(data: bytes, read, starts: tuple[bytes, ...]) -> Iterator[Entry]:
    """Reads from place to place; after a failure, from the next start that can be read."""
    finders, ends = [_Finder(data, s) for s in starts], _Finder(data, END)
    at, lost, why = 0, -1, None
    while at < len(data):
        try:
            found, after, problem = read(at, ends)
        except Damage as damage:
            found, after, problem = [], at, str(damage)
        if problem is None and lost >= 0:
            yield Entry(lost, at - lost, reason=why)
            lost = -1
        yield from found
        if problem is None:
            at = after
            continue
        if lost < 0:
            lost, why = at, problem
        at = min(f.after(at + 1) for f in finders)
    if lost >= 0:
        yield Entry(lost, len(data) - lost, reason=why)


def salvage(data: bytes) -> Iterator[Entry]:
    """Records and gaps of an archive, in order; a gap follows records got out of a damaged member."""
    def read(at: int, ends: _Finder):
        if not data.startswith(GZIP_START, at):
            entry, after = _parse(data, at, ends)
            return [entry], after, None
        raw, after, problem = _inflate(data, at)
        found = [Entry(at, after - at, e.start, e.length, e.reason, e.fields, e.payload) for e in _plain(raw)]
        if problem:
            after = at
            found = [Entry(at, 0, e.inner, e.inner_length, None, e.fields, e.payload)
                     for e in found if e.reason is None]
        return found, after, problem

    return _walk(data, read, (GZIP_START, b"WARC/"))


ENTRY_SCHEMA = ("archive string, start bigint, length bigint, inner bigint, inner_length bigint, reason string, "
                "record_type string, record_id string, target string, payload_bytes bigint, "
                "payload_digest string, refers_to string")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record, and every gap (``reason`` says why), of the archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` are of the payload as read; a
    revisit, which has none, gives those of the record that it revisits.
    """
    schema = ENTRY_SCHEMA + (", payload binary" if payloads else "")

    def row(archive: str, e: Entry) -> dict:
        out = {"archive": archive, "start": e.start, "length": e.length, "inner": e.inner,
               "inner_length": e.inner_length, "reason": e.reason}
        if e.fields is not None:
            kind = e.fields.get("warc-type")
            size, sha = len(e.payload), None
            if kind == "revisit":
                said = e.fields.get("http-content-length", "")
                size = int(said) if re.fullmatch(r"[0-9]{1,18}", said) else None
                sha = e.fields.get("warc-payload-digest", "").rpartition(":")[2] or None
            else:
                sha = digest(e.payload)
            out |= {"record_type": kind, "record_id": e.fields.get("warc-record-id"),
                    "target": e.fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha,
                    "refers_to": e.fields.get("warc-refers-to"), "payload": e.payload}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int64()
        kinds = {"archive": text, "start": number, "length": number, "inner": number, "inner_length": number,
                 "reason": text, "record_type": text, "record_id": text, "target": text,
                 "payload_bytes": number, "payload_digest": text, "refers_to": text}
        if payloads:
            kinds["payload"] = pa.binary()
        names = pa.schema(list(kinds.items()))
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held: list[dict] = []
                size = 0
                for e in salvage(content.as_py()):
                    held.append(row(archive, e))
                    size += len(e.payload)
                    if len(held) == 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, names)

    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInArrow(run, schema))


def _page(column: str) -> F.Column:
    return F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all pages written to archives and read back."""
    path = scratch_path(spark, "archives")
    delete_at_exit(spark, path)
    write_archives(C.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).where("reason IS NULL").select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM h
"""
