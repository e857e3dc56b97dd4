"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a member piece by piece, frames the record by its Content-Length and verifies its digests. Archives
go through Spark's own file writers and readers, so any store that Spark reaches will do, and a task that is run again
replaces what the lost one wrote.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.scratch import new_path, stash

#: A gzip member that inflates to nothing: the text sink's line separator, so that an archive ends in valid gzip data.
EMPTY_MEMBER = "\x1f\x8b\x08" + "\x00" * 6 + "\xff\x03" + "\x00" * 9
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
PIECE = 1 << 16


class WarcError(ValueError):
    """An archive that is cut off, framed wrongly or doesn't match its digests."""


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, record_id: str, uri: str | None, payload: bytes, size: int, sha1: bytes, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: sha1:{_base32(sha1)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row into archives of about archive_bytes each below path.

    Of rows with equal payloads of least_bytes or more, the one with the largest id becomes a response and the others
    revisit it; smaller payloads are all responses. A null payload is empty. A null id is written as "null" and is the
    smallest; if a group has no other id, all its rows are responses, as are rows that repeat the largest id. A null url
    leaves the target URI out. Other columns are not read. An empty table gives archives without records.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    twice = pages.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # the written table is small and has one row a group: a hot payload's rows can be split, and its copies aren't kept
    rows = pages.join(stash(twice, "warc-groups").hint("shuffle_hash"), ["sha1", "size"], "left")
    again = F.coalesce(F.col("id") != F.col("keep"), F.col("id").isNull() & F.col("keep").isNotNull())
    rows = rows.select("id", "url", "sha1", "size", F.when(again, F.col("keep")).alias("refers"), F.when(~again, F.col("payload")).alias("payload"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for i, url, sha1, n, refers, payload in batch[["id", "url", "sha1", "size", "refers", "payload"]].astype(object).itertuples(index=False):
                name = "null" if pd.isna(i) else int(i)
                back = None if pd.isna(refers) else f"urn:page:{int(refers)}"
                held.append(_record("response" if back is None else "revisit", f"urn:page:{name}", url, payload or b"", int(n), bytes(sha1), back, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)]})

    archives = rows.mapInPandas(pack, "value binary")
    sink = archives.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1")
    sink.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _members(content: bytes) -> Iterator[bytes]:
    """What each gzip member holds, inflated piece by piece; members without content are passed over."""
    at, view = 0, memoryview(content)
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise WarcError("the archive ends inside a member")
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        if any(out):
            yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Frame and verify one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise WarcError(f"{fields.get('warc-record-id')}: the block doesn't have its Content-Length")
    if fields["warc-block-digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise WarcError(f"{fields.get('warc-record-id')}: the block doesn't match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest != _base32(hashlib.sha1(payload).digest())):
        raise WarcError(f"{fields.get('warc-record-id')}: the payload doesn't match its digest")
    bare = lambda x: x and x.strip("<>")
    return {
        "record_type": kind, "record_id": bare(fields["warc-record-id"]), "refers_to": bare(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True, rows_at_once: int = 64) -> DataFrame:
    """All records of the archives below path: record_type, record_id, refers_to, target_uri, payload_bytes (of the full
    payload, for revisits too), payload_digest and payload (null for revisits, or for all without ``payloads``).

    Every record is verified; a damaged or cut archive raises WarcError. Empty archives have no records.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held = []
                for data in _members(content):
                    held.append(parse_record(data) if payloads else parse_record(data) | {"payload": None})
                    if len(held) == rows_at_once:
                        yield pd.DataFrame(held)
                        held = []
                if held:
                    yield pd.DataFrame(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read_warc(spark, path, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = {
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keep FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM k"""
}
QUERIES = {"op10_warc": op10_warc}
