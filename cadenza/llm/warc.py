"""WARC archives: writing pages as records, and reading any archive in parallel by boundary-chain verification.

Reading: archives are cut into chunks of fixed size. A task scans its chunk for record heads; every head found,
real or inside a payload, is a candidate with the offset of its successor (end of head + content length + the
closing blank line). Inside a chunk candidates are followed at once, which leaves an edge from each candidate to
the first offset beyond the chunk. Pointer jumping over those edges, from offset 0 of each file, then retains
only offsets that a chain of records from the file's start reaches: rounds grow with the logarithm of the chunks
of a file. A second scan walks each chunk from its verified entry, so magic inside payloads is never a record.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace, opened, put

MAGIC = b"WARC/1.1\r\n"
#: Payloads below this many bytes are always written whole.
DEDUP_BYTES = 100
CHUNK_BYTES = 4 << 20
#: Bytes read at first to find the end of a head; a longer head is read on, twice as far each time.
HEAD_BYTES = 1 << 16
#: Pages that revisit another up to which their list is broadcast (about 16 MB); beyond it the pages are shuffled to join.
REVISITS_BROADCAST = 500_000
_PAGE = re.compile(rb"^<urn:x-page:(-?\d+)>$")


def _safe(value: str) -> bytes:
    """A header value on one line: control characters and % are percent-encoded."""
    return re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own but names its digest and length."""
    digest = hashlib.sha256(payload).hexdigest().encode()
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [MAGIC[:-2], b"WARC-Type: " + (b"revisit" if revisit else b"response")]
    head.append(b"WARC-Record-ID: " + (b"<urn:x-page:%d>" % page_id if page_id is not None else b"<urn:uuid:" + str(uuid.UUID(bytes=hashlib.md5(payload).digest())).encode() + b">"))
    if url is not None:
        head.append(b"WARC-Target-URI: " + _safe(url))
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:x-page:%d>" % refers_to, b"X-Payload-Length: %d" % len(payload)]
    head += [b"WARC-Payload-Digest: sha256:" + digest, b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(data: bytes, at: int) -> tuple[int, dict[bytes, bytes]] | None:
    """(offset of the content, header fields in lower case) of a head at ``at``; None if it is not well formed."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return end + 4, fields


def _to_blank(f, data: bytes, at: int) -> tuple[bytes, int]:
    """``data``, read on from ``f`` until a blank line follows ``at``, and where that is (-1: not before the end of the file)."""
    seen = at
    while (end := data.find(b"\r\n\r\n", seen)) < 0:
        more = f.read(max(HEAD_BYTES, len(data)))
        if not more:
            break
        seen = max(at, len(data) - 3)
        data += more
    return data, end


def _ending(data: bytes, first: int, end: int) -> tuple[int, int, int]:
    """What the heads that end at ``end`` share: (least and greatest offset of their fields for them to be well formed, content length).

    ``first`` is the offset of the fields of the first of them. The last content length counts; without one, or with
    one that is no number, no head is well formed. Lines are seen once however many heads they are in.
    """
    least, most, length, at = first, -1, b"", first
    for line in data[first:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            least = at + 1
        elif name.strip().lower() == b"content-length":
            most, length = at, value.strip()
        at += len(line) + 2
    return (least, most, int(length)) if length.isdigit() else (least, -1, 0)


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ws: Workspace | None = None) -> DataFrame:
    """Write a record per row; one row per file: path, bytes, records.

    Of records with equal payloads of at least ``DEDUP_BYTES`` bytes those with the smallest page id are
    responses, the others revisit it. A null html is the empty payload; rows with a null id are responses and
    are not referred to. Repeated rows are written each. Each task writes the rows it scans, so pages are not
    shuffled unless more than ``REVISITS_BROADCAST`` of them are revisits.
    """
    spark = pages.sparkSession
    ws = ws or Workspace(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    large = rows.where((F.octet_length("html") >= DEDUP_BYTES) & F.col("page_id").isNotNull())
    digests = ws.table("digests", large.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = ws.table("revisits", digests.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct())
    few = revisits.count() <= REVISITS_BROADCAST
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= DEDUP_BYTES, F.unhex(F.sha2("html", 256))))
    joined = rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    folder = f"{ws.path}/archive"

    def write(batches):
        path, count = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc", 0

        def flow():
            nonlocal count
            for batch in batches:
                for p, u, h, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                    count += 1
                    yield record(p, u, h.as_py().encode(), r)

        records = flow()
        head = next(records, None)
        if head is None:
            return

        def every():
            yield head
            yield from records

        size = put(path, every())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

    return ws.table("written", joined.mapInArrow(write, "path string, bytes long, records long"))


def _candidates(path: str, offset: int, chunk: int, size: int) -> dict[int, int]:
    """Successor of every head that starts in the chunk."""
    found, end = {}, -1
    with opened(path) as f:
        f.seek(offset)
        data = f.read(min(chunk + HEAD_BYTES, size - offset))
        at = data.find(MAGIC)
        while 0 <= at < chunk:
            if end < at:
                data, end = _to_blank(f, data, at)
                if end < 0:
                    break
                least, most, length = _ending(data, at + len(MAGIC), end)
            if least <= at + len(MAGIC) <= most and (after := offset + end + 4 + length + 4) <= size:
                found[offset + at] = after
            at = data.find(MAGIC, at + 1)
    return found


def read_warc(files: DataFrame, ws: Workspace | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Records of the archives in ``files(path, bytes)``: path, offset, record_type, page_id, uri, refers_to, payload
    (null for a revisit), payload_bytes, payload_digest (bare lower-case hex SHA-256 of the full payload).

    Only records on the chain from a file's start are returned, whatever their payloads hold; a chain that breaks
    ends there. A file without a record at its start gives none.
    """
    spark = files.sparkSession
    ws = ws or Workspace(spark, "warc-read")
    pieces = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("at")).where("bytes > 0")
    pieces = ws.table("pieces", pieces)
    most = files.agg(F.max("bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = _candidates(path, at, chunk, size)
                out: dict[int, int] = {}
                for o in sorted(near, reverse=True):  # a successor inside the chunk is already followed
                    n = near[o]
                    out[o] = n if n >= at + chunk or n >= size else out.get(n, -1)
                kept = [(o, n) for o, n in out.items() if n >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array([o for o, _ in kept], pa.int64()), pa.array([n for _, n in kept], pa.int64())], ["path", "o", "n"])

    spread = pieces.select("path", "bytes", "at").repartition(parts, "path", "at")
    jump = ws.table("jump-0", spread.mapInArrow(scan, "path string, o long, n long"))
    reached = ws.table("reached-0", files.where("bytes > 0").select("path", F.lit(0).cast("long").alias("o")))
    rounds = max(1, (-(-most // chunk)).bit_length())
    for k in range(1, rounds + 1):
        step = reached.join(jump, ["path", "o"]).select("path", F.col("n").alias("o"))
        grown = ws.table(f"reached-{k}", reached.unionByName(step).distinct())
        if k < rounds:
            there = jump.select("path", F.col("o").alias("n"), F.col("n").alias("next"))
            jump = ws.table(f"jump-{k}", jump.join(there, ["path", "n"]).select("path", "o", F.col("next").alias("n")))
            ws.drop(f"jump-{k - 1}")
        reached = grown
    entry = reached.groupBy("path", (F.floor(F.col("o") / chunk) * chunk).alias("at")).agg(F.min("o").alias("entry"))
    walked = pieces.join(entry, ["path", "at"]).select("path", "bytes", "at", "entry").repartition(parts, "path", "at")

    def walk(batches):
        for batch in batches:
            for path, size, at, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _walk(path, size, o, min(at + chunk, size))

    return walked.mapInArrow(walk, "path string, offset long, record_type string, page_id long, uri string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _walk(path: str, size: int, o: int, stop: int):
    """Records that start in [o, stop), a few megabytes at a time."""
    names = ["path", "offset", "record_type", "page_id", "uri", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    with opened(path) as f:
        while o < stop:
            f.seek(o)
            data = f.read(HEAD_BYTES)
            if data.startswith(MAGIC):
                data, _ = _to_blank(f, data, 0)
            head = parse_head(data, 0)
            if head is None:
                break
            length = int(head[1][b"content-length"])
            if o + head[0] + length + 4 > size:
                break
            body = data[head[0] : head[0] + length]
            if len(body) < length:
                body += f.read(length - len(body))
            h = head[1]
            number, refers = _PAGE.match(h.get(b"warc-record-id", b"")), _PAGE.match(h.get(b"warc-refers-to", b""))
            revisit = h.get(b"warc-type") == b"revisit"
            digest = h.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode() if revisit else hashlib.sha256(body).hexdigest()
            count = int(h.get(b"x-payload-length", b"0")) if revisit else length
            rows.append((path, o, h.get(b"warc-type", b"").decode(), int(number[1]) if number else None, h[b"warc-target-uri"].decode() if b"warc-target-uri" in h else None, int(refers[1]) if refers else None, None if revisit else body, count, digest))
            held += head[0] + length
            o += head[0] + length + 4
            if held > 8 << 20 or len(rows) >= 4096:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()
