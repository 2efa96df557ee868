"""Operator 2: WARC archives with segmented records, written and read back by Spark.

Writing: a page becomes a ``response`` record, or a ``revisit`` of the smallest page with the same payload
digest. The payload is framed as a chunked HTTP message; a block longer than a segment is split into a first
record and ``continuation`` records. Reading: archives are read as files of bounded size, their segments are
grouped by origin, ordered by number, checked against the stated total length, joined, and the chunked framing
is decoded. Files hold a bounded number of records of bounded size, so a reader holds one file at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, shared_dir, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 256
#: Bytes of records after which a writer hands on a batch.
BATCH_BYTES = 4 << 20
#: Repeated payloads up to which their digests are broadcast (about 50 bytes each).
BROADCAST_ROWS = 100_000
_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_URN = "urn:relyframe:page:"
_SEGMENT_SCHEMA = (
    "origin string, number int, total long, kind string, page_id long, url string, digest string, refers_to long, block binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked message; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = framed.index(_CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != _CRLF:
            raise ValueError("chunk without its end")
        out.append(framed[at : at + size])
        at += size + 2


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the file writer puts between records."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF + _CRLF + block + _CRLF


def _clean(url: str | None) -> str | None:
    """Header values hold no line ends."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def page_records(page_id: int | None, row_id: int, url: str | None, payload: bytes, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of one page."""
    name, digest = f"<{_URN}{page_id}#{row_id}>", f"sha1:{base32_sha1(payload)}"
    common = [("WARC-Target-URI", _clean(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        about = [("WARC-Record-ID", name), ("WARC-Refers-To", f"<{_URN}{refers_to}>"), ("WARC-Profile", profile)]
        return [_record("revisit", [*about, *common], _HTTP)]
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record("response", [("WARC-Record-ID", name), *common], block)]
    out = [_record("response", [("WARC-Record-ID", name), ("WARC-Segment-Number", 1), *common], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        about = [("WARC-Record-ID", f"{name[:-1]}.{k}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        out.append(_record("continuation", [*about, ("WARC-Segment-Total-Length", total), *common[:2]], part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write WARC files of the pages (page_id, url, html) to a new folder.

    Of pages with equal payloads the one with the smallest page_id is a response, the others revisit it (repeated
    rows of the smallest id are responses, too). A null html is an empty payload. A null page_id is written as
    such and never referred to while its payload has a page with an id. No pages give no files.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialize(first)
    if first.count() <= BROADCAST_ROWS:  # else Spark joins by shuffle
        first = F.broadcast(first)
    rows = rows.join(first, "sha", "left").select(
        "page_id",
        F.monotonically_increasing_id().alias("row_id"),
        "url",
        "payload",
        F.when(F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to"),
    )

    def records(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for pdf in batches:
            ready, size = [], 0
            for page_id, row_id, url, payload, refers_to in zip(*(pdf[c] for c in ("page_id", "row_id", "url", "payload", "refers_to")), strict=True):
                own = page_records(whole(page_id), int(row_id), url, payload, whole(refers_to), segment)
                ready += own
                size += sum(map(len, own))
                if size > BATCH_BYTES:
                    yield pd.DataFrame({"record": ready})
                    ready, size = [], 0
            yield pd.DataFrame({"record": ready})

    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    archives = rows.mapInPandas(records, "record binary").select(F.col("record").cast("string"))
    archives.write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(headers["content-length"])
        if content[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield headers, content[begin : begin + size]
        at = begin + size + 4


def _page(urn: str | None) -> int | None:
    number = urn.strip("<>").removeprefix(_URN).split("#")[0] if urn else "None"
    return None if number == "None" else int(number)


def _segments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _SEGMENT_SCHEMA.split(", ")]
    for pdf in batches:
        for content in pdf["content"]:
            rows = []
            for h, block in parse_archive(gzip.decompress(content)):
                origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                number, total = int(h.get("warc-segment-number", 1)), h.get("warc-segment-total-length")
                total = len(block) if "warc-segment-number" not in h else total and int(total)
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append((origin, number, total, h["warc-type"], _page(origin), h.get("warc-target-uri"), digest, _page(h.get("warc-refers-to")), block))
            yield pd.DataFrame(rows, columns=names, dtype=object)


def reassembled(segments: Iterable[dict], total: int | None, digest: str | None, is_response: bool) -> tuple[bytes | None, bool]:
    """Payload of an origin's segments, and whether all of them are there and the payload has the stated digest."""
    ordered = sorted(segments, key=lambda s: s["number"])
    block = b"".join(bytes(s["block"]) for s in ordered)
    if [s["number"] for s in ordered] != list(range(1, len(ordered) + 1)) or total is None or len(block) != total:
        return None, False
    if not is_response:
        return None, True
    try:
        payload = dechunked(block[block.index(_CRLF * 2) + 4 :])
    except ValueError:
        return None, False
    return (payload, True) if digest is None or base32_sha1(payload) == digest else (None, False)


def _assembled(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [
            reassembled(segments, None if pd.isna(total) else int(total), digest, kind == "response")
            for kind, total, digest, segments in zip(pdf["kind"], pdf["total"], pdf["digest"], pdf["segments"], strict=True)
        ]
        columns = ["page_id", "url", "kind", "digest", "refers_to", "n_segments"]
        yield pdf[columns].assign(payload=[x[0] for x in found], complete=[x[1] for x in found])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reassembled records: page_id, url, kind, digest, refers_to, n_segments, payload, complete.

    ``complete`` is false, and the payload null, where segment numbers have gaps, the total length or the payload's
    digest differs from the stated one, or the chunked framing is broken. The payload of a revisit is null; its digest is
    the stated one. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    segments = files.mapInPandas(_segments, _SEGMENT_SCHEMA)
    origins = segments.groupBy("origin").agg(
        F.max("total").alias("total"),
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("page_id").alias("page_id"),
        F.max("url").alias("url"),
        F.max("digest").alias("digest"),
        F.max("refers_to").alias("refers_to"),
        F.count("*").alias("n_segments"),
        F.collect_list(F.struct("number", "block")).alias("segments"),
    )
    schema = "page_id long, url string, kind string, digest string, refers_to long, n_segments long, payload binary, complete boolean"
    return origins.drop("origin").mapInPandas(_assembled, schema)


def measured(read: DataFrame) -> DataFrame:
    """Records with ``payload_bytes``; that of a revisit is its response's: of the page that it refers to, with its digest.

    It is null for a damaged response, and for a revisit whose response is missing or damaged. Records of repeated ids with
    different payloads are told apart by digest. Only revisits are joined, so no null key is shuffled.
    """
    columns = ["page_id", "digest", "kind", "refers_to", "n_segments", "complete"]
    records = materialize(read.select(*columns, F.octet_length("payload").cast("long").alias("payload_bytes")))
    responses = records.filter("kind = 'response'")
    sizes = responses.filter("payload_bytes is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    # Written first, so that Spark can split a response that a third of all pages revisit.
    revisits = records.filter("kind <> 'response'").drop("payload_bytes").join(materialize(sizes), ["refers_to", "digest"], "left")
    return responses.unionByName(revisits)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; revisits take the size of the page that they refer to."""
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return measured(read_archives(spark, path)).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "n_segments", "complete"
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
    list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT) AS v,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr(a, 1 + ((x >> 15) & 31), 1) || substr(a, 1 + ((x >> 10) & 31), 1)
    || substr(a, 1 + ((x >> 5) & 31), 1) || substr(a, 1 + (x & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  CASE WHEN page_id <> first_id THEN 1
    ELSE (87 + payload_bytes + 5 + CASE WHEN payload_bytes > 0 THEN
      (payload_bytes // 4096) * 8 + CASE WHEN payload_bytes % 4096 > 0 THEN length(to_hex(payload_bytes % 4096)) + 4 ELSE 0 END
      ELSE 0 END + 16383) // 16384 END AS n_segments, true AS complete
FROM g
"""
