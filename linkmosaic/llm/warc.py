"""WARC archives: one gzip member a record, written by tasks and read back by byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmosaic.llm.common import table
from linkmosaic.sources.shared import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
LEAST = 100  # bytes from which equal payloads are revisits
SPLIT = 8 << 20
CHUNK = 1 << 20
#: Fixed values of the WARC 1.0 format.
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, is_revisit: bool = False) -> bytes:
    """One record as a gzip member: HTTP head and payload; a revisit has the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~"))
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = VERSION + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(data) + squeeze.flush()


def parse_record(data: bytes) -> dict:
    """Fields of a whole record; raises ValueError where its parts do not fit together."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    else:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not fit its digest")
    number = lambda k: int(fields[k]) if fields.get(k, "None") != "None" else None
    return {
        "page_id": number("X-Page-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID") if revisit else None,
    }


def read_range(handle, start: int, end: int) -> Iterator[bytes]:
    """Records whose member starts in [start, end) of a file.

    Each place with the gzip magic is a candidate; one that does not decode to a WARC head, or whose
    checksum fails, is passed over.  A record that starts inside is read to its end, beyond `end` too.
    """
    handle.seek(start)
    base, buffer = start, b""
    at = start
    while at < end:
        while len(buffer) - (at - base) < len(MAGIC):
            more = handle.read(CHUNK)
            if not more:
                return
            buffer, base = buffer[at - base :] + more, at
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = base + len(buffer) - len(MAGIC) + 1
            continue
        at = base + found
        if at >= end:
            return
        inflate, parts, fed, good, started = zlib.decompressobj(31), [], found, True, False
        while good and not inflate.eof:
            if fed >= len(buffer):
                more = handle.read(CHUNK)
                if not more:
                    good = False
                    break
                buffer += more
            piece = buffer[fed : fed + CHUNK]
            fed += len(piece)
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error:
                good = False
            if good and not started and sum(map(len, parts)) >= 7:
                started = True
                good = b"".join(parts).startswith(b"WARC/1.")
        if not good or not started:
            at += 1
            continue
        at = base + fed - len(inflate.unused_data)
        yield b"".join(parts)


def write_warc(pages: DataFrame, root: str) -> DataFrame:
    """Pages (page_id, url, html) -> a table of the files written under root: (path, bytes, records).

    Of the rows with equal payloads of LEAST bytes or more, the smallest page_id is the response, the
    others are revisits that refer to it; smaller payloads are all responses.  The join that finds the
    first page goes by the payload's digest; small payloads have keys of their own, so that they do not
    meet.  A task writes files under names of its own and reports them in its rows; files of lost
    attempts are in no report.  Null html is an empty payload; a page whose id is null, or that shares
    the smallest id, is a response.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("big", F.octet_length("body") >= LEAST)
    rows = rows.withColumn("k", F.when(F.col("big"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    first = rows.filter("big").groupBy("k").agg(F.min("page_id").alias("first"))
    held = rows.join(first, "k", "left")

    def write(batches):
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for b in batches:
            for page_id, url, body, digest, big, first in b[["page_id", "url", "body", "digest", "big", "first"]].itertuples(index=False):
                page = None if pd.isna(page_id) else int(page_id)
                to = None if pd.isna(first) or not big else int(first)
                data = record_bytes(page, url, bytes(body), digest, to, to is not None and page is not None and page != to)
                out = out or fs.open_output_stream(name, compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [n]})

    return materialize(held.select("page_id", "url", "body", "digest", "big", "first").mapInPandas(write, "path string, bytes long, records long"), "warc-files")


def read_warc(files: DataFrame, root: str, payloads: bool = False, split: int = SPLIT) -> DataFrame:
    """A table of files (path, bytes) -> the records in them; a task takes byte ranges of `split`."""
    spark = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "bytes").alias("end"))
    n = max(1, min(10_000, ranges.count()))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if not payloads:
        columns.remove("payload")
    kinds = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}

    def read(batches):
        fs, _ = _open(root)
        for b in batches:
            for path, start, end in b[["path", "start", "end"]].itertuples(index=False):
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for data in read_range(f, int(start), int(end)):
                        rows.append({k: v for k, v in parse_record(data).items() if k in columns})
                        held += len(data)
                        if held > 32 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    return ranges.repartition(n).mapInPandas(read, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(files, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
f as (select sha256(body) as d, min(page_id) as first from p where n >= 100 group by 1)
select p.page_id, cast(p.n as bigint) as payload_bytes, sha256(p.body) as payload_digest,
  case when f.first is not null and f.first <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> p.page_id then f.first end as refers_to
from p left join f on p.n >= 100 and f.d = sha256(p.body)"""
