"""WARC archives: written with one gzip member per record, read back in sequence.

The reader takes compressed blocks off the stream and feeds them to an
incremental zlib decompressor; a member ends where zlib says so, and the next
one starts with the bytes left over. Within a member it reads header lines up to
the blank one, then exactly Content-Length bytes, which it hashes as they come:
payloads are never held whole. Block and payload digests are verified.

Payloads that several records share are stored once: the record of the largest
id is the response, the others are revisits that name its digest and id.

Defined results: null html is an empty payload and takes part like any other;
rows that repeat the id and the payload of a response are responses too; a row
without an id revisits the group's response if there is one. Extra columns are
ignored. Archives end at ``FILE_BYTES``.
"""

import base64
import hashlib
import itertools
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import materialise, partitions, work_path

MIN_BYTES = 0
FILE_BYTES = 64 << 20
LEVEL = 5
BLOCK = 1 << 16
#: The capture date that every record carries unless the caller gives one.
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id):
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _record(kind, headers, block):
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
            ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return member.compress(text.encode() + block + b"\r\n\r\n") + member.flush()


def _line(value):
    """A header value on one line."""
    return " ".join(str(value).split())


def page_record(page_id, url, payload, refers_to, date=DATE):
    """One page as a compressed record: a response, or a revisit of ``refers_to``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    headers = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
               ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        headers.append(("WARC-Page-ID", page_id))
    if refers_to is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                ("WARC-Refers-To-Page-ID", refers_to)]
    return _record("revisit", headers, http)


class BadRecord(ValueError):
    """A record that is cut short or does not match its digests."""


class _Members:
    """Bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream, self.left, self.unzip, self.ready = stream, b"", None, b""

    def next_member(self):
        """Go to the next member; False at the end of the stream."""
        while self.unzip is not None and not self.unzip.eof:
            self._more()
        self.ready = b""
        if self.unzip is not None:
            self.left = self.unzip.unused_data
        if not self.left:
            self.left = self.stream.read(BLOCK)
        self.unzip = zlib.decompressobj(31)
        return bool(self.left)

    def _more(self):
        """Some more bytes of this member; b"" when it has ended."""
        while not self.unzip.eof:
            if not self.left:
                self.left = self.stream.read(BLOCK)
                if not self.left:
                    raise BadRecord("gzip member is cut short")
            out = self.unzip.decompress(self.left, BLOCK)
            self.left = self.unzip.unconsumed_tail
            if out:
                return out
        return b""

    def line(self):
        while b"\n" not in self.ready:
            more = self._more()
            if not more:
                raise BadRecord("header is cut short")
            self.ready += more
        line, self.ready = self.ready.split(b"\n", 1)
        return line.rstrip(b"\r")

    def take(self, n):
        """Up to ``n`` bytes; b"" when the member has ended."""
        data = self.ready or self._more()
        self.ready = data[n:]
        return data[:n]


def _headers(lines):
    pairs = (line.decode().partition(":") for line in iter(lines, b""))
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream):
    """(headers, http headers, payload bytes, payload digest) of every record of an archive."""
    members = _Members(stream)
    while members.next_member():
        if not members.line().startswith(b"WARC/"):
            raise BadRecord("not a WARC record")
        headers = _headers(members.line)
        left = int(headers["content-length"])
        block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
        http, head = (None, b"") if "application/http" in headers.get("content-type", "") else ({}, None)
        while left:
            data = members.take(min(left, BLOCK))
            if not data:
                raise BadRecord("block is cut short")
            left -= len(data)
            block.update(data)
            if http is None:
                head += data
                if b"\r\n\r\n" not in head:
                    continue
                first, data = head.split(b"\r\n\r\n", 1)
                http = _headers(iter([*first.split(b"\r\n")[1:], b""]).__next__)
            payload.update(data)
            size += len(data)
        if headers.get("warc-block-digest", "") not in ("", f"sha1:{_b32(block)}"):
            raise BadRecord("block digest differs")
        digest = headers.get("warc-payload-digest", f"sha1:{_b32(payload)}").removeprefix("sha1:")
        if headers["warc-type"] == "response" and digest != _b32(payload):
            raise BadRecord("payload digest differs")
        if headers["warc-type"] == "revisit":
            size = int((http or {}).get("content-length", 0))
        yield headers, http, size, digest


def _b32(h):
    return base64.b32encode(h.digest()).decode()


def with_responses(pages: DataFrame, min_bytes=MIN_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): the response that each row revisits, null for responses.

    Only the largest id of each repeated payload is grouped, before the shuffle;
    a payload that a third of all rows share is one row there, and Spark splits
    its side of the join.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_bytes", F.octet_length("html")).withColumn("_sha", F.unhex(F.sha1("html")))
    shared = rows.where(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes") \
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(shared, ["_sha", "_bytes"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, min_bytes=MIN_BYTES, date=DATE, folder=None) -> DataFrame:
    """Write every row as a record; the manifest, (path, records), one row per archive."""
    folder = folder or work_path(pages.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa
        out, n, size = None, 0, 0

        def close():
            out[1].close()
            return pa.RecordBatch.from_arrays([pa.array([out[0]]), pa.array([n], pa.int64())], names=["path", "records"])
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*cols):
                if out is None:
                    out = files.create(folder, ".warc.gz")
                    out[1].write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                                      ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                                         b"format: WARC File Format 1.1\r\n"))
                data = page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), date)
                out[1].write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out, n, size = None, 0, 0
        if out is not None:
            yield close()
    rows = with_responses(pages, min_bytes)
    return materialise(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_rows(batches):
    import pyarrow as pa
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(text):
        return None if text is None else int(text)

    def rows(paths, counts):
        for path, count in zip(paths, counts):
            seen = 0
            with files.read(path) as stream:
                for h, _, size, digest in read_records(stream):
                    if h["warc-type"] == "warcinfo":
                        continue
                    seen += 1
                    yield (number(h.get("warc-page-id")), h.get("warc-target-uri"), size, digest, h["warc-type"],
                           number(h.get("warc-refers-to-page-id")))
            if seen != count:
                raise BadRecord(f"{path} has {seen} of {count} records")
    for batch in batches:
        source = rows(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "records")))
        while block := list(itertools.islice(source, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], names=names)


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per page record of the archives that the manifest names."""
    parts = partitions(manifest.sparkSession)
    return manifest.repartition(parts, "path").mapInArrow(_read_rows, ROWS)
