"""WARC archives: a writer that turns equal payloads into revisits, and a splittable reader.

Archives hold one gzip member a record.  A reading task gets a byte range of a file, looks for gzip
magic, accepts a candidate member when its first bytes decode to a WARC header, and owns the records
that start inside its range; the last one it reads past the range's end.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.registry import query
from crashgrid.session import HOT_SHARE, cut, drop_cut, scratch_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


# ------------------------------------------------------------------------------- records
def _line(text: str) -> str:
    """A header value on one line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{digest}:{page_id}'.encode()).hexdigest()[:32])}>"


@dataclass
class Record:
    """What one record says.  ``payload`` is None for a revisit, which carries the headers of its page only."""

    page_id: int | None
    url: str | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def encode(r: Record, date: str, level: int) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: {_record_id(r.payload_digest, r.page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{r.payload_digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if r.page_id is not None:
        head.append(f"X-Page-ID: {r.page_id}")
    if r.url is not None:
        head.append(f"WARC-Target-URI: {_line(r.url)}")
    if r.record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(r.payload_digest, r.refers_to)}", f"X-Refers-To-Page-ID: {r.refers_to}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode(data: bytes) -> Record:
    """The record of a decompressed member; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:")).split(":")[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    url = _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    return Record(number("X-Page-ID"), url, fields["WARC-Type"], size, digest, number("X-Refers-To-Page-ID"), None if revisit else payload)


# ------------------------------------------------------------------------------- reading
class _Window:
    """Bytes of a file from some position on, read in chunks as they are needed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer, self.ended = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(CHUNK)
        self.ended = not got
        self.buffer += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """(content, compressed length) of the member at the window's start; None where there is none."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    seen = b""
    try:
        while True:
            piece = window.buffer[used:]
            used = len(window.buffer)
            out.append(unpack.decompress(piece))
            if len(seen) < 7:
                seen = (seen + out[-1])[:7]
                if not b"WARC/1.".startswith(seen):
                    return None
            if unpack.eof:
                used -= len(unpack.unused_data)
                return (b"".join(out), used) if len(seen) == 7 else None
            if not window.more():
                return None  # cut off at the end of the file
    except zlib.error:
        return None


def scan(file, start: int, end: int) -> Iterator[Record]:
    """Records whose member starts in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        while (found := window.buffer.find(MAGIC)) < 0:
            window.skip(max(0, len(window.buffer) - 2))  # the magic may lie across the chunks
            if window.at >= end or not window.more():
                return
        window.skip(found)
        if window.at >= end:
            return
        member = _member(window)
        if member is None:
            window.skip(1)
        else:
            window.skip(member[1])
            yield decode(member[0])


ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame, split_bytes: int = 32 << 20, payloads: bool = False) -> DataFrame:
    """Records of archives; ``files`` has path and bytes of each.

    Each file is dealt out in ranges of ``split_bytes``, whatever its size, so one large archive is
    read by many tasks.  Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    and with ``payloads`` the payload (null for revisits).
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    schema = ROW + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
        for b in batches:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, at = pafs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    rows, held = [], 0
                    for r in scan(file, start, end):
                        rows.append(tuple(getattr(r, n) for n in names))
                        held += 200 + (r.payload_bytes if payloads else 0)
                        if held > 8 * CHUNK:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                    yield _batch(rows, names, kinds)

    return ranges.repartition(max(1, ranges.count())).mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


# ------------------------------------------------------------------------------- writing
def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html as given, payload_digest, payload_bytes, record_type, refers_to).

    Of equal payloads of at least ``least_bytes`` the smallest page_id (nulls last, then by url) is the
    response; rows that repeat it in both are responses too.  Groups are counted before the shuffle and only those of several rows are
    joined; digests with over 1/HOT_SHARE of the rows, fewer than HOT_SHARE, by broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.xxhash64("url").alias("tie")))
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1").select("payload_digest", "first", "n"))
    total = pages.count()
    hot = groups.filter(F.col("n") * HOT_SHARE > total)
    tagged = rows.join(F.broadcast(hot.select("payload_digest", F.col("first").alias("_hot"))), "payload_digest", "left")
    even = groups.filter(F.col("n") * HOT_SHARE <= total).select("payload_digest", F.col("first").alias("_even"))
    easy = tagged.filter("_hot IS NOT NULL").withColumn("_first", F.col("_hot"))
    rest = tagged.filter("_hot IS NULL").join(even, "payload_digest", "left").withColumn("_first", F.col("_even"))
    both = easy.drop("_hot").unionByName(rest.drop("_hot", "_even"))
    mine = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.xxhash64("url").alias("tie"))
    revisit = F.col("_first").isNotNull() & ~mine.eqNullSafe(F.col("_first"))
    return both.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first.page_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 2, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each page below ``folder``; returns path, bytes and records of the archives.

    ``folder`` must be a place that all executors reach (an URI that pyarrow opens).  Each task writes
    archives of its own name, a new one after ``file_bytes``; only the files in the returned, stored
    list count, so those of lost or repeated attempts do no harm.  The pages have no crawl time, so
    ``date`` is given.  A null html is an empty payload; other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = pafs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        out, size, n, part = None, 0, 0, TaskContext.get().partitionId()
        done: list[tuple] = []

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, n))

        for b in batches:
            for row in b.to_pylist():
                payload = row["html"].encode()
                data = encode(Record(row["page_id"], row["url"], row["record_type"], row["payload_bytes"], row["payload_digest"], row["refers_to"],
                                     None if row["record_type"] == "revisit" else payload), date, level)
                if out is None or size + len(data) > file_bytes:
                    close()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = system.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
        close()
        yield _batch(done, ["path", "bytes", "records"], [pa.string(), pa.int64(), pa.int64()])

    return cut(mark_revisits(pages).mapInArrow(write, "path string, bytes long, records long"))


@query("op2_warc_round_trip", "pages", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM h LEFT JOIN g USING (payload_digest)""")
def op2_warc_round_trip(pages: DataFrame) -> DataFrame:
    files = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    records = read_archives(files)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
