"""WARC archives: written with Spark's own writer, read in byte ranges of any size."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_READ = 1 << 18
#: A gzip member of nothing. The last byte of a member is the top byte of its size: 0 below 16 MB, and always in this one.
_NOTHING = (lambda c: c.compress(b"") + c.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    done = c.compress(data) + c.flush()
    return done if done[-1] == 0 else done + _NOTHING


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = lambda x: None if pd.isna(x) else int(x)
    for b in batches:
        rows = zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True)
        yield pd.DataFrame({"member": [_member(_record(none(i), u, p.encode(), base64.b32encode(bytes.fromhex(d)).decode(), none(r)))[:-1] for i, u, p, d, r in rows]})


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (``page_id, url, html``), each a gzip member of its own.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest page_id are responses and the
    others revisit it. Null html: an empty payload. Null page_id: never the largest; it revisits as others do, or if all
    are null, all are responses. Null url: no target. Rows repeated with the largest page_id are all responses. Other columns
    are left.

    Spark's text writer puts the members down: a row is a member without its last byte, which is always 0, and the line
    separator is that byte. So the files are plain WARC, on any file system that Spark writes, and commit as Spark's do.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and first is not null").select(F.col("digest").alias("same"), "first")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to")
    # rows of one payload meet one row here, and adaptive execution splits a hot one
    joined = rows.join(groups, F.col("digest") == F.col("same"), "left").select("page_id", "url", "payload", "digest", refers)
    members = joined.mapInPandas(_written, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", "\x00").option("compression", "none").text(folder)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Members:
    """Gzip members of a file from an offset on, each with its start."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer = file, at, b""

    def _more(self) -> bool:
        got = self.file.read_at(_READ, self.at + len(self.buffer))
        self.buffer += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def valid(self) -> bool:
        """Whether a member with a WARC header begins here."""
        while len(self.buffer) < 4096 and self._more():
            pass
        try:
            return zlib.decompressobj(31).decompress(self.buffer[: 1 << 16], 5) == b"WARC/" or self.buffer.startswith(_NOTHING)
        except zlib.error:
            return False

    def seek(self, end: int) -> bool:
        """Go to the first valid member that starts before ``end``."""
        while self.at < end:
            k = self.buffer.find(MAGIC)
            if k < 0:
                self._drop(max(0, len(self.buffer) - 2))
                if not self._more():
                    return False
                continue
            self._drop(k)
            if self.at < end and self.valid():
                return True
            self._drop(1)
        return False

    def take(self) -> bytes:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if not self.buffer and not self._more():
                raise EOFError(f"a member is cut off at {self.at}")
            n = len(self.buffer)
            out.append(d.decompress(self.buffer))
            self._drop(n - len(d.unused_data))
        return b"".join(out)


def _parsed(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    h = {k.strip().lower(): v.strip() for k, _, v in pairs}
    number = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", h.get(k, ""))) else None
    kind, body = h.get("warc-type"), rest[: int(h.get("content-length", 0))]
    if h.get("content-type", "").startswith("application/http"):  # another program's record: the payload is what follows the HTTP head
        body = body.partition(b"\r\n\r\n")[2]
    given, own = h.get("warc-payload-digest", ""), base64.b32encode(hashlib.sha1(body).digest()).decode()
    if kind == "response" and given.startswith("sha1:") and given[5:] != own and number("warc-record-id") is not None:
        raise ValueError(f"the payload of {h['warc-record-id']} isn't what its digest says")
    if kind == "revisit":
        length = int(h["x-payload-length"]) if "x-payload-length" in h else None
        return number("warc-record-id"), h.get("warc-target-uri"), kind, body, length, given.removeprefix("sha1:") or None, number("warc-refers-to")
    return number("warc-record-id"), h.get("warc-target-uri"), kind, body, len(body), given.removeprefix("sha1:") or own, number("warc-refers-to")


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
    for b in batches:
        for path, begin, end in zip(b["path"], b["begin"], b["end"], strict=True):
            with _open(path) as file:
                m, rows, size = _Members(file, begin), [], 0
                while m.seek(end):
                    if data := m.take():
                        rows.append(_parsed(data))
                        size += len(data)
                    if size > 4 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)


def read_warc(spark, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives in ``folder``, read in ranges of ``split_bytes``.

    A task scans its range for the gzip magic, takes a place for a member's start if a WARC header can be decoded there,
    and owns the records that start inside its range, reading the last of them past its end. Any split size gives the same
    records. The list of files comes from Spark's file source without their contents. A response's payload is held against
    its digest. Records of other kinds and of other programs come out too, with a null page_id, the digest that they give (or else their
    body's) and, for a revisit that doesn't say it, a null length. A revisit has an empty ``payload``, and ``payload_bytes`` and ``payload_digest`` of what it refers to. A
    folder without records gives no rows.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("begin")
    ranges = files.select("path", "length", begin).select("path", "begin", F.least(F.col("begin") + split_bytes, "length").alias("end"))
    # a number of its own: adaptive execution would gather these few small rows in one task
    n = ranges.count()
    return ranges.repartition(max(n, 1), "path", "begin").mapInPandas(_ranges, RECORDS)


#: The records' columns: base 32 of each five hexadecimal digits is four of its letters.
SQL = """with p as (select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, octet_length(body) as payload_bytes, hex, max(page_id) over (partition by hex) as best from p)
select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
cast(1 + (cast('0x' || substr(hex, cast(1 + 5 * (k // 4) as integer), 5) as integer) >> cast(15 - 5 * (k % 4) as integer)) % 32 as integer), 1)), 'string_agg', '') as payload_digest,
case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id < best then best end as refers_to from d"""
