"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

An archive compressed as one gzip stream can only be read from its start. normalise() inflates
such a stream once, in bounded pieces, finds the records in it, and writes each as a gzip member of
its own, with a sidecar index of one line a record (offset, length, type, record, digest). Any
record can then be read alone. A record passes through in chunks and is never held whole.

write_archives() makes such monolithic archives from a table of pages. Of pages with equal payload
the one with the smallest identifier is a response, the others revisits that carry the HTTP header
alone and refer to it. The payload is hashed where it lies; only digests that occur twice or
more are joined back, by broadcast up to a counted bound and by a shuffle beyond it.

Cases: a null payload counts as empty, and all empty payloads are equal; a null url is written as
about:blank, and control characters in one are percent-encoded. A null identifier is a response if
its group has no other, else a revisit; rows that repeat identifier and payload are all of one type. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import maybe_broadcast, remove, saved, shared_dir
from heddle.llm.files import attempt_name, long_ids, open_fs, partition_id

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, ARCHIVE_BYTES, LEVEL = 1 << 16, 1 << 27, 1


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:heddle:page:{'none' if page is None else page}>"


def page_of(record: str) -> int | None:
    name = record.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(page: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One record, with the blank lines after it; refers_to: the response's identifier in a tuple, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (b"" if refers_to else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {record_id(refers_to[0])}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Inflated:
    """The bytes of a gzip stream (of one member or many), read in order and in bounded pieces."""

    def __init__(self, file):
        self.file, self.inflate, self.rest, self.buffer, self.ended = file, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.ended:
            raw = self.rest or self.file.read(CHUNK)
            if not raw:
                if not self.inflate.eof and self.begun:
                    raise ValueError("the gzip stream is cut off")
                self.ended = True
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.begun = True
            out = self.inflate.decompress(raw, CHUNK)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    begun = False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, with it; None at the end of the stream."""
        at = 0
        while (i := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the last record is cut off")
                return None
        out, self.buffer = self.buffer[: i + len(mark)], self.buffer[i + len(mark) :]
        return out

    def take(self, size: int):
        """The next size bytes, in pieces."""
        while size:
            if not self.buffer and not self._more():
                raise ValueError("a record's block is cut off")
            out, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(out)
            yield out


def normalise(source, target, index, level: int = LEVEL) -> int:
    """Rewrites the gzip stream of source as one member a record on target, one line a record on index; returns the records."""
    stream, at, count = Inflated(source), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        own = headers(head[:-4])
        member, start = zlib.compressobj(level, zlib.DEFLATED, 31), at
        for part in chain((head,), stream.take(int(own["content-length"])), (b"\r\n\r\n", None)):
            out = member.flush() if part is None else member.compress(part)
            at += len(out)
            target.write(out)
        for end in stream.take(4):
            if end.strip(b"\r\n"):
                raise ValueError("a record is longer than it says")
        index.write(f"{start} {at - start} {own['warc-type']} {own['warc-record-id']} {own.get('warc-payload-digest', '-')}\n".encode())
        count += 1
    return count


def read_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    own = headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    return own, headers(http), payload


def write_archives(pages: DataFrame, folder: str, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as monolithic gzip archives below folder; returns a saved row per archive: path, records."""
    # identifiers travel as text: a nullable long would reach pandas as float
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    digest = F.struct(F.unhex(F.sha1(body)).alias("sha1"), F.unhex(F.sha2(body, 256)).alias("sha2"), F.length(body).alias("bytes"))  # SHA-1 alone can be made to agree for different payloads
    groups = rows.select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = saved(groups.select("digest", F.col("first").cast("string").alias("first")))
    rows = rows.withColumn("digest", digest).join(maybe_broadcast(groups, groups.count()), "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "first")

    def write(batches):
        fs, root = open_fs(folder)
        out = None
        for batch in batches:
            for page, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first"], strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, size, count = attempt_name(partition_id(), ".warc.gz"), 0, 0
                    out, pack = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                own = record(None if pd.isna(page) else int(page), None if pd.isna(url) else url, html.encode(), None if pd.isna(first) or first == page else (int(first),))
                out.write(pack.compress(own))
                size, count = size + len(own), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [name], "records": [count]})
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pd.DataFrame({"path": [name], "records": [count]})

    return saved(rows.mapInPandas(write, "path string, records long"))


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises the archives at folder/path; returns a saved row per new archive: path, index_path, records."""

    def rewrite(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for path in batch["path"]:
                name = attempt_name(partition_id(), ".members.warc.gz")
                with fs.open_input_stream(f"{root}/{path}", compression=None) as source, fs.open_output_stream(f"{root}/{name}", compression=None) as target, fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    count = normalise(source, target, index)
                yield pd.DataFrame({"path": [name], "index_path": [f"{name}.idx"], "records": [count]})

    return saved(_spread(archives.select("path")).mapInPandas(rewrite, "path string, index_path string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record by its line in the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        return out.assign(page_id=long_ids(out["page_id"]), refers_to=long_ids(out["refers_to"]), payload_bytes=out["payload_bytes"].astype(np.int64))

    def read(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for path, index_path in zip(batch["path"], batch["index_path"], strict=True):
                rows = []
                with fs.open_input_file(f"{root}/{path}") as file, fs.open_input_stream(f"{root}/{index_path}", compression=None) as index:
                    for line in _lines(index):
                        at, size, _ = line.split(" ", 2)
                        file.seek(int(at))
                        own, http, payload = read_record(file.read(int(size)))
                        digest, length = own["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                        if own["warc-type"] == "response" and (len(payload), digest_of(payload)) != (length, digest):
                            raise ValueError(f"{path}: the record at {at} is damaged")
                        rows.append((page_of(own["warc-record-id"]), length, digest, own["warc-type"], page_of(own["warc-refers-to"]) if "warc-refers-to" in own else None))
                        if len(rows) == 10_000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    return _spread(archives.select("path", "index_path")).mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _spread(archives: DataFrame) -> DataFrame:
    """One archive a task; the table has a row for each archive."""
    return archives.repartition(min(100_000, max(1, archives.count())))


def _lines(stream):
    rest = b""
    while raw := stream.read(CHUNK):
        *whole, rest = (rest + raw).split(b"\n")
        for line in whole:
            yield line.decode()


def archive_round_trip(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder, normalises them, reads them back and deletes them."""
    folder = shared_dir(pages.sparkSession, "warc")
    try:
        return saved(read_archives(normalise_archives(write_archives(pages, folder, page_col, url_col, payload_col), folder), folder))
    finally:
        remove(pages.sparkSession, folder)
