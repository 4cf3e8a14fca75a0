"""WARC archives: a writer and a splittable reader.

``write`` stores one record per page, each its own gzip member, one file per
task.  A task writes under a name of its own attempt and then moves the file to
its final name, so a lost or repeated task leaves no half file.  Files go
through ``pyarrow.fs`` to any store it knows (local, HDFS, S3, GCS).

``read`` cuts every file into byte ranges.  A task looks for the gzip magic in
its range, accepts a position only if the member's first bytes decode to a
WARC version line, and owns every record that starts inside its range, reading
past the end for the last one.  No index is needed, and one large file is read
by many tasks.

Pages with equal payloads of ``REVISIT_BYTES`` or more are stored once: the
smallest page_id is the response, the others are revisit records that refer
to it.  Their payload length is resolved from that response when read.

Defined cases: a null html is an empty payload; a null url is written as
``urn:unknown``; pages without a page_id are responses and never referred to;
rows that repeat the smallest page_id are all responses; an empty table writes
no records.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import lookup, partitions
from broadsheet.session import cut_lineage, ensure_checkpoint_dir

REVISIT_BYTES = 100
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, records long"
RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long"


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def member(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None,
           date: str, serial: str) -> bytes:
    """One gzip member with one record; ``payload`` None makes a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none-' + serial if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {'urn:unknown' if url is None else quote(url, safe=':/?#[]@!$&' + chr(39) + '()*+,;=%~-._')}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to): refers_to is set for revisits only."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"),
                        (F.octet_length(html) >= REVISIT_BYTES).alias("long"))
    first = cut_lineage(rows.filter(F.col("long") & F.col("page_id").isNotNull()).groupBy("digest")
                        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    out = lookup(rows, first, "digest", "n", F.xxhash64("page_id", "url"))
    refers = F.when(F.col("long") & (F.col("first") < F.col("page_id")), F.col("first"))
    return out.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("payload_digest"), refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` under ``folder``; returns the manifest (file, bytes, records), already computed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, store, out, size, n = TaskContext.get(), None, None, 0, 0
        for b in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store, base = filesystem(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{ctx.partitionId():06d}.warc.gz"
                    draft = f"{base}/.{name}.{ctx.taskAttemptId()}"
                    out = store.open_output_stream(draft, compression=None)
                data = member(page_id, url, None if refers is not None else html.encode(), digest, refers, date, f"{ctx.partitionId()}-{n}")
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return cut_lineage(plan_records(pages).mapInArrow(task, MANIFEST))


class Window:
    """Bytes of a file by absolute position, read in blocks and dropped behind."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def get(self, pos: int) -> bytes:
        """At least READ_BYTES bytes from ``pos``, fewer at the end of the file."""
        if not self.start <= pos <= pos + READ_BYTES <= self.start + len(self.data) and pos < self.size:
            self.handle.seek(pos)
            self.start, self.data = pos, self.handle.read(4 * READ_BYTES)
        return self.data[pos - self.start:]


def decode(window: Window, pos: int) -> tuple[bytes, int] | None:
    """(record, end of its member) if a gzip member with a WARC record begins at ``pos``, else None.

    The version line decides; damage behind it fails the job instead of losing a record.
    """
    try:
        if zlib.decompressobj(31).decompress(window.get(pos)[:READ_BYTES], 7) != b"WARC/1.":
            return None
    except zlib.error:
        return None
    z, parts, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        data = window.get(at)[:READ_BYTES]
        if not data:
            raise ValueError(f"the record at {pos} is cut off")
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            raise ValueError(f"the record at {pos} is damaged: {e}") from e
        at += len(data)
    return b"".join(parts), at - len(z.unused_data)


def members(window: Window, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, record) of the members that start in [start, end)."""
    pos = start
    while pos < end:
        data = window.get(pos)
        hit = data.find(MAGIC)
        if hit < 0:
            if pos + len(data) >= window.size:
                return
            pos += max(len(data) - len(MAGIC) + 1, 1)
            continue
        pos += hit
        if pos >= end:
            return
        found = decode(window, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[0]
        pos = found[1]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload): the payload of an HTTP message is what follows its header, of other records the whole block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", "")
    block = rest[:int(size)] if size.isdigit() else rest.removesuffix(b"\r\n\r\n")
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, block
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["encoded"] = "yes" if re.search(rb"(?im)^transfer-encoding:", http) else ""
    return fields, payload


def agrees(payload: bytes, given: str) -> bool:
    """Whether a payload has the digest of a header (``name:`` and hex or base32); True for algorithms not known here."""
    name, _, value = given.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    raw = hashlib.new(name, payload).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read(manifest: DataFrame, split: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Records of the files of ``manifest``; with ``payloads`` the html too.

    Archives of other writers are read as well: every record has one row, of
    whatever type; page_id and refers_to are null unless they are this
    module's, a payload digest may be missing or of another algorithm (the
    column always is SHA-256), and length and digest of a revisit whose
    response is not here are null.  A digest that does not match fails the
    job, except that of a payload in a transfer encoding.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split).cast("long"))).alias("start"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, path = filesystem(file)
                rows: list[tuple] = []
                with store.open_input_file(path) as handle:
                    for pos, record in members(Window(handle, size), start, min(start + split, size)):
                        f, payload = parse(record)
                        kind, given = f.get("warc-type", "unknown"), f.get("warc-payload-digest", "")
                        revisit = kind == "revisit"
                        if revisit:  # its payload is elsewhere
                            digest = given.removeprefix("sha256:") if given.startswith("sha256:") else None
                        else:
                            digest = hashlib.sha256(payload).hexdigest()
                            if given and given != f"sha256:{digest}" and not f.get("encoded") and not agrees(payload, given):
                                raise ValueError(f"{file} at {pos}: the payload does not match its digest")
                        row = (_page(f.get("warc-record-id")), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")),
                               None if revisit else len(payload), digest, file, pos)
                        rows.append((*row, None if revisit else payload.decode("utf-8", "replace")) if payloads else row)
                        if len(rows) >= (200 if payloads else 5000):
                            yield _batch(rows, payloads)
                            rows = []
                if rows:
                    yield _batch(rows, payloads)

    n = max(partitions(manifest.sparkSession), 1)
    return ranges.repartition(n, "file", "start").mapInArrow(task, RECORD + (", html string" if payloads else ""))


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payloads
    names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload length of revisits taken from the record they refer to."""
    records = cut_lineage(records)
    used = records.filter("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    sizes = records.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("full"))
    refs = records.filter("refers_to is not null").select("refers_to", "payload_digest").distinct()
    stats = cut_lineage(refs.join(sizes, ["refers_to", "payload_digest"]).join(used, "refers_to").select(
        F.concat_ws(" ", "refers_to", "payload_digest").alias("target"), "full", "n"))
    keyed = records.withColumn("target", F.when(F.col("refers_to").isNotNull(), F.concat_ws(" ", "refers_to", "payload_digest")))
    out = lookup(keyed, stats, "target", "n", F.xxhash64("page_id", "offset"))
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).drop("target", "full", "n")


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    manifest = write(pages, archive_folder(pages.sparkSession))
    return resolved(read(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
