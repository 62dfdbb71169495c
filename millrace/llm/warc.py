"""WARC archives: written from pages, read back one record after another.

An archive is a .warc.gz file with a gzip member for each record. Payloads that are equal and not small are stored once, as
the response of the page with the largest id; the others are revisit records that name it. The reader knows nothing of the
writer: it inflates a stream in steps, takes a record from each member, frames its block by Content-Length and checks block
and payload digests.

Pages are dealt to archives as the table's own splits lie: payloads move only for the join that finds equal ones, and only
those that are not small. The payload that very many pages share is one key of that join, which Spark can split.
Each task writes its archives under a new name and reports it; the reports are kept as a table, so archives of attempts
that were lost are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir

#: Bytes of compressed records after which a new archive begins; bytes that the reader takes at once.
ARCHIVE, STEP = 64 << 20, 1 << 16
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't framed as it should be, or a record whose digest doesn't hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    http: dict[str, str] = field(default_factory=dict)


def sha1(data: bytes) -> str:
    """A digest as WARC headers write it: base 32 with the algorithm's name."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, record_id: str, payload: bytes, digest: str, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """One record as a gzip member: an HTTP response with the payload, or for a revisit its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "WARC-Block-Digest": sha1(block),
        **({"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if refers_to else {}),
        **(extra or {}), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in text.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def parse(member: bytes) -> Record:
    """The record of one inflated member, with its framing and digests checked."""
    head, end, rest = member.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"WARC/"):
        raise WarcError("a member doesn't begin with a WARC record")
    headers = _headers(head.partition(b"\r\n")[2])
    length = int(headers.get("content-length", "-1"))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"record {headers.get('warc-record-id')} isn't framed by its Content-Length")
    out = Record(headers, rest[:length])
    if (d := headers.get("warc-block-digest")) and d != sha1(out.block):
        raise WarcError(f"block digest of {headers.get('warc-record-id')} doesn't hold")
    if headers.get("content-type", "").startswith("application/http"):
        http, _, out.payload = out.block.partition(b"\r\n\r\n")
        out.http = _headers(http.partition(b"\r\n")[2])
    if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest")) and d != sha1(out.payload):
        raise WarcError(f"payload digest of {headers.get('warc-record-id')} doesn't hold")
    return out


def read_records(stream, step: int = STEP) -> Iterator[Record]:
    """Records of an archive in order. stream has read(n); no more than a record and a step are held."""
    inflate, parts, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(step)
        if not raw:
            break
        parts.append(inflate.decompress(raw))
        raw = b""
        if inflate.eof:
            yield parse(b"".join(parts))
            raw, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise WarcError("the archive ends within a record")


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A table of the archives written: path, records. Each page is a record; payloads of `least` bytes or more are stored once."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= least)
    equal = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder")
    columns = ["page_id", "url", "html", "digest", "holder"]
    small = rows.where(F.octet_length("html") < least).withColumn("holder", F.lit(None).cast("long"))
    dealt = large.join(equal, "digest", "left").select(columns).unionByName(small.select(columns))

    def write(batches):
        at, base = _open(folder)
        at.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", count))
                out = None

        for batch in batches:
            for page_id, url, html, digest, holder in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None or size >= ARCHIVE:
                    close()
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = at.open_output_stream(f"{base}/{name}", compression=None)
                i, h = page_id.as_py(), holder.as_py()
                payload, url = html.as_buffer().to_pybytes(), (url.as_py() or "").replace("\r", "").replace("\n", "")
                own = "sha1:" + base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                revisit = h is not None and i != h
                extra = {"X-Page-Id": "" if i is None else str(i), **({"X-Payload-Length": str(len(payload)), "X-Refers-To-Page": str(h)} if revisit else {})}
                data = record("revisit" if revisit else "response", url, f"urn:page:{i}", payload, own, f"urn:page:{h}" if revisit else None, extra)
                out.write(data)
                size, count = size + len(data), count + 1
        close()
        yield pa.record_batch({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return saved(dealt.mapInArrow(write, "path string, records long"), "warc_archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in column path: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url, payload (null for a revisit)."""
    payload = [("payload", pa.binary())] * with_payload
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *payload]

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, name = _open(path)
                with at.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        revisit = h["warc-type"] == "revisit"
                        page, other = h.get("x-page-id", ""), h.get("x-refers-to-page")
                        digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                        row = (int(page) if page else None, int(h["x-payload-length"]) if revisit else len(r.payload), digest, h["warc-type"], int(other) if other else None, h.get("warc-target-uri"), None if revisit else r.payload)
                        rows.append(row[: len(kinds)])
                        size += len(r.payload)
                        if size > (16 << 20) or len(rows) >= 10_000:
                            yield _batch(rows, kinds)
                            rows, size = [], 0
        yield _batch(rows, kinds)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(read, schema)


def _batch(rows, kinds):
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def archived(pages: DataFrame, least: int = 1000, with_payload: bool = False, **columns) -> DataFrame:
    """Pages written to WARC archives and read back: see read_archives.

    A null html is an empty payload, a null url an empty one, a null id stays null: its page revisits an equal payload
    that has an id, and else is a response. Of rows with the largest id and equal payloads each is a response. Columns
    beside id, url and html take no part. An empty table gives an empty table.
    """
    return read_archives(write_archives(pages, least, **columns), with_payload)
