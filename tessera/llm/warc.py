"""WARC writing and reading with segment reassembly.

Writing: every page becomes a ``response`` record (an HTTP message in chunked transfer coding, cut
into a first segment and ``continuation`` records where it is long) or a ``revisit`` of the page with
the same payload and the largest id. Reading: archives are inflated and parsed piece by piece;
segments are grouped by origin identifier, ordered by segment number, checked against
the declared total length and stripped of the chunked framing. A revisit takes its size and the page that it refers to from the response
with its digest. Archives of other writers are read too: their page ids are null, and where a payload digest is declared it is checked.

An archive holds at most ``RECORDS_PER_FILE`` records of at most about ``SEGMENT_BYTES``, so 20 MB. It is one gzip
member, as Spark's text sink writes it; archives with a member for each record are read alike.

Nulls: a null payload is empty; a null url is written as ``urn:none``; a null page id
never is the response of a group that has an id. Repeated rows: rows that share the largest id of a payload are all
responses. An empty table gives no rows and an archive folder without records. Extra columns are left out.
A record that is cut short, misses a segment or fails its length raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete, new_path, staged

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE, READ_BYTES = 16_384, 4_096, 1_024, 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_CHUNKED = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_EMPTY = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
PARTS = "record_id string, kind string, origin string, segment int, total long, page_id string, digest string, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cut(text: str, size: int) -> Iterator[str]:
    """Pieces of at most ``size`` UTF-8 bytes that end between characters."""
    data, at = text.encode(), 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end].decode()
        at = end


def chunked(payload: str) -> str:
    out = [f"{len(part.encode()):x}\r\n{part}\r\n" for part in cut(payload, CHUNK_BYTES)]
    return "".join([*out, "0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """Decode chunked transfer coding, trailers included."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(data[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if data[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(data[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(message: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP header cut short")
    fields = dict(x.split(b":", 1) for x in head.lower().split(b"\r\n")[1:] if b":" in x)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: dict[str, object], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def records(key: str, page_id: str | None, url: str | None, html: str | None, refers_to: str | None, refers_url: str | None, is_revisit: bool) -> Iterator[str]:
    """The WARC records of one page, without the blank lines that end each."""
    payload = html or ""
    address = lambda x: "".join(c for c in x or "urn:none" if c > " ")
    url = address(url)
    rid = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}#{n}')}>"
    base = {"WARC-Record-ID": rid(1), "WARC-Date": DATE, "WARC-Target-URI": url, "X-Page-ID": page_id}
    base |= {"WARC-Payload-Digest": f"sha1:{digest(payload.encode())}"}
    kind = {"Content-Type": "application/http;msgtype=response"}
    if is_revisit:
        yield record({"WARC-Type": "revisit", **base, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": address(refers_url), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-ID": refers_to, **kind}, HTTP_EMPTY)
        return
    message = HTTP_CHUNKED + chunked(payload)
    parts = list(cut(message, SEGMENT_BYTES))
    if len(parts) == 1:
        yield record({"WARC-Type": "response", **base, **kind}, message)
        return
    yield record({"WARC-Type": "response", **base, "WARC-Segment-Number": 1, **kind}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = len(message.encode()) if n == len(parts) else None
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": rid(n), "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Segment-Origin-ID": rid(1), "WARC-Segment-Number": n, "WARC-Segment-Total-Length": last}, part)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``first_id`` and ``first_url`` of the largest id among equal payloads where there are several.

    Only ids and digests are grouped; a payload that occurs once isn't joined at all.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html").withColumn("sha", sha)
    several = rows.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(several, "sha", "left")


def write_warc(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as gzip archives of at most ``RECORDS_PER_FILE`` records.

    Spark's text sink ends each row with the blank lines that end a WARC record, so any store that
    Spark can write to will do.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, html, first, first_url, key in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first_id"], pdf["first_url"], pdf["key"]):
                revisit = first is not None and first != page_id
                out += records(f"{key}", page_id, url, html, first if revisit else None, first_url, revisit)
            yield pd.DataFrame({"value": out})

    texts = {c: F.col(c).cast("string") for c in ("page_id", "first_id")}  # longs with nulls would become doubles
    keyed = with_revisits(pages).withColumns(texts).withColumn("key", F.monotonically_increasing_id())
    keyed.mapInPandas(lines, "value string").write.options(lineSep=END, compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE).text(path)


def inflate(data: bytes) -> Iterator[bytes]:
    """The content of a file of gzip members, or the file itself, in pieces of about ``READ_BYTES``."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            feed = member.unconsumed_tail or data[at : at + READ_BYTES]
            at += 0 if member.unconsumed_tail else len(feed)
            piece = member.decompress(feed, READ_BYTES)
            if not feed and not piece and not member.eof:
                raise ValueError("gzip member cut short")
            yield piece
        at -= len(member.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; holds one record and a piece at a time."""
    more, held, at = iter(pieces), b"", 0

    def have(n: int) -> bool:
        """Whether n bytes lie ahead, after reading on."""
        nonlocal held, at
        parts, size = [held[at:]], len(held) - at
        while size < n and (piece := next(more, None)) is not None:
            parts.append(piece)
            size += len(piece)
        held, at = b"".join(parts), 0
        return size >= n

    while have(1):
        while (head := held.find(b"\r\n\r\n", at)) < 0:
            if not have(len(held) - at + 1):
                raise ValueError("record cut short")
        if held[at : at + 5] != b"WARC/":
            raise ValueError("not a WARC record")
        fields = {}
        for line in held[at:head].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        start, size = head + 4 - at, int(fields["content-length"])
        if len(held) - at < start + size + 4 and not have(start + size + 4):
            raise ValueError("record cut short")
        block = held[at + start : at + start + size]
        if held[at + start + size : at + start + size + 4] != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield fields, block
        at += start + size + 4


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for every response, revisit and continuation record of the archives under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        number = lambda x: None if x is None else int(x)
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"segment": "Int32", "total": "Int64"})
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for f, block in parse(inflate(content)):
                    if f.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    sha = f.get("warc-payload-digest", "")
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f.get("x-page-id"), sha.removeprefix("sha1:") if sha.startswith("sha1:") else None, block))
                    if len(rows) == 512:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(run, PARTS)


def join_segments(numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    """The message whose segments are given in any order."""
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    if [numbers[i] for i in order] != list(range(1, len(order) + 1)):
        raise ValueError("a segment is missing or doubled")
    message = b"".join(bytes(blocks[i]) for i in order)
    if total is None or len(message) != total:
        raise ValueError("segments don't add up to the total length")
    return message


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Pages as read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and the payload if asked for.

    Whole records need no shuffle; only segments are grouped, and a group is one page's message. Size and
    ``refers_to`` of a revisit are null where no response has its digest.
    """
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                message = bytes(r.blocks[0]) if pd.isna(r.numbers[0]) else join_segments([int(n) for n in r.numbers], list(r.blocks), None if pd.isna(r.total) else int(r.total))
                payload, size, sha = payload_of(message), None, r.digest
                if r.kind == "response":
                    size, sha = len(payload), digest(payload)
                    if r.digest is not None and r.digest != sha:
                        raise ValueError("payload doesn't match its digest")
                out.append((r.page_id, size, sha, r.kind, *([payload] * with_payload)))
            yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    parts = read_parts(spark, path)
    shared = ["kind", "page_id", "digest", "total"]
    whole = parts.where("segment is null").select(*shared, F.array(F.col("segment")).alias("numbers"), F.array("block").alias("blocks"))
    segments = parts.where("segment is not null")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = segments.groupBy("origin").agg(*[first(c) for c in shared[:-1]], F.max("total").alias("total"), F.collect_list("segment").alias("numbers"), F.collect_list("block").alias("blocks"))
    pages = staged(whole.union(grouped.select(whole.columns)).mapInPandas(decode, schema).withColumn("page_id", F.col("page_id").cast("long")), "pages")
    revisit = F.col("record_type") == "revisit"
    found = pages.where(~revisit).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"))
    again = pages.where(revisit).join(found, "payload_digest", "left").withColumn("payload_bytes", F.col("size")).drop("size")
    return pages.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    pages = read_warc(spark, path, with_payload=False)
    delete(spark, [path])
    return pages


_BITS = " + ".join(f"substr(b, 5 * i + {k + 1}, 1)::INT * {16 >> k}" for k in range(5))
ORACLE_SQL = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h HAVING count(*) > 1),
d AS (SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, unhex(sha1(p.h))::BIT::VARCHAR AS b, first_id FROM p LEFT JOIN g ON g.h = p.h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_BITS} + 1, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM d"""
}
