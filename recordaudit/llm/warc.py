"""WARC archives, index first.

Writing: every task appends its records to one archive in the shared folder, one
gzip member per record (WARC/1.1 response and revisit records), and returns one
index row per record: file, offset, length, URL, payload digest.  The index is
written as parquet by the same tasks.  Archive names are unique per task attempt,
so after a lost executor the index that gets committed names the files of the
attempts that wrote it, and a half-written file of a lost attempt is never named.

Reading: rows selected from the index are dealt by (file, offset) ranges, sorted,
adjacent byte ranges are coalesced into spans of at most ``span_bytes``, one read
per span, and each record is parsed from its slice.  Payload length and digest of a
response are computed from the payload read; a revisit carries them in its headers.

Duplicates: of records with equal payloads of at least ``min_bytes``, that with the
largest ``page_id`` is the response, the others revisit it (rows that tie on the
largest id are all responses).  The groups are found on digests alone, aggregated
before the shuffle; the lookup back to the rows is salted, so a digest shared by a
third of all rows is dealt to ``salts`` tasks.

Nulls: a null html is an empty payload, a null url or page_id leaves the header out
(null ids sort below every other id, so a null-id row of a group with ids is a
revisit; a group of null ids only is all responses).  Control characters in a url
are percent-encoded in the header; the index keeps the url as given.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_folder, slices, table

INDEX_SCHEMA = ("page_id bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, "
                "payload_digest string, record_type string, refers_to bigint")
READ_SCHEMA = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
               "url string, file string, offset bigint, length bigint, payload binary")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def classify(pages: DataFrame, min_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """``page_id, url, html`` plus ``record_type`` and ``refers_to`` (and the digest used to group)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("_sha"),
                        F.octet_length(html).cast("long").alias("_bytes"))
    copies = rows.where(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes") \
        .agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = materialize(copies, "warc-copies").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.hash("page_id", "url"), F.lit(salts)))
    joined = salted.join(copies, ["_sha", "_bytes", "_salt"], "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("_top")).alias("refers_to"))


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _header_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record_bytes(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> tuple[bytes, str]:
    """One WARC record (uncompressed) and the payload's SHA-1 in hex."""
    sha = hashlib.sha1(payload)
    block = HTTP_HEAD % len(payload) + (payload if record_type == "response" else b"")
    head = [("WARC-Type", record_type), ("WARC-Record-ID", _record_id(page_id, url)), ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
            ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", _header_url(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if record_type == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n", sha.hexdigest()


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case keys) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    return {"headers": headers, "payload": block.partition(b"\r\n\r\n")[2]}


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1,
                   max_file_bytes: int = 1 << 30) -> DataFrame:
    """Write ``page_id, url, html, record_type, refers_to`` as archives below ``folder``; returns the index.

    A task starts a new file once its file has reached ``max_file_bytes``."""
    spark = rows.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for big in batches:
                for batch in slices(big, "html"):
                    index = []
                    for r in batch.to_pylist():
                        if out is None:
                            name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        payload = (r["html"] or "").encode()
                        raw, digest = record_bytes(r["page_id"], r["url"], payload, r["record_type"], r["refers_to"], date)
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.append({"page_id": r["page_id"], "url": r["url"], "file": name, "offset": offset,
                                      "length": len(member), "payload_bytes": len(payload), "payload_digest": digest,
                                      "record_type": r["record_type"], "refers_to": r["refers_to"]})
                        offset += len(member)
                        if offset >= max_file_bytes:
                            out.close()
                            out = None
                    yield pa.RecordBatch.from_pylist(index, schema)
        finally:
            if out is not None:
                out.close()

    index = rows.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(write, INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, payload: bool = True, span_bytes: int = 4 << 20,
                 gap_bytes: int = 64 << 10) -> DataFrame:
    """The records that ``index`` selects, read back by coalesced sorted byte ranges.

    Ranges at most ``gap_bytes`` apart share a read of at most ``span_bytes`` (a longer record
    is read alone).  ``payload=False`` leaves the payload column null."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary())])

    def one(raw: bytes, url, file, offset, length) -> dict:
        rec = parse_record(zlib.decompress(raw, 31))
        h, response = rec["headers"], rec["headers"]["warc-type"] == "response"
        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        if response and hashlib.sha1(rec["payload"]).hexdigest() != digest:
            raise ValueError(f"{file} at {offset}: payload digest differs")
        return {"page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
                "payload_bytes": len(rec["payload"]) if response else int(h["x-payload-length"]),
                "payload_digest": digest, "record_type": h["warc-type"],
                "refers_to": None if response else int(h["x-refers-to-page-id"]),
                "url": url, "file": file, "offset": offset, "length": length,
                "payload": rec["payload"] if payload else None}

    def spans(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for r in rows:
            if group and (r[0] != group[0][0] or r[1] - (group[-1][1] + group[-1][2]) > gap_bytes
                          or r[1] + r[2] - group[0][1] > span_bytes):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        rows = ((r["file"], r["offset"], r["length"], r["url"]) for b in batches for r in b.to_pylist())
        name, handle = None, None
        for group in spans(rows):
            if group[0][0] != name:
                if handle is not None:
                    handle.close()
                name = group[0][0]
                handle = fs.open_input_file(f"{root}/{name}")
            start = group[0][1]
            handle.seek(start)
            data = handle.read(max(o + n for _, o, n, _ in group) - start)
            yield pa.RecordBatch.from_pylist([one(data[o - start:o - start + n], url, f, o, n) for f, o, n, url in group], schema)
        if handle is not None:
            handle.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file", "offset", "length", "url").repartitionByRange(parts, "file", "offset") \
        .sortWithinPartitions("file", "offset").mapInArrow(read, READ_SCHEMA)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives, then read every record back through the index."""
    folder = new_folder(spark, "warc")
    index = write_archives(classify(table(spark, sf_dir, "pages")), folder)
    return read_records(index, folder, payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), s AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top_id FROM s
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top_id THEN top_id END AS refers_to
FROM g
"""
