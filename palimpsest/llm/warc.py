"""WARC archives: a writer, and a splittable reader.

Writing: of payloads that are equal and large enough, the record of the smallest id is a
response and the others are revisits that refer to it.  Each task appends gzip members,
one a record, to an archive of its own, whose name is unique to the attempt; only
archives that a committed row names are read.

Reading: archives are dealt out as byte ranges, over a stated number of tasks.  A task
scans its range for the gzip magic, validates a candidate by inflating its head and looking
for a WARC version line, and owns the records that start inside the range; the last may end
beyond it.  After an owned record the next one starts where it ended, and after damage the
scan goes on.  The round trip compares what was read with what was written: a record that
is missing, or whose payload does not match its digest, fails the query.

Defined results: a null html is an empty payload; a null page_id is kept, and never the
response of a group with other ids; repeated rows with the id and the payload of a
response are responses too; other columns are ignored.
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

from palimpsest.llm.common import as_text, saved
from palimpsest.llm.token_store import filesystem

MAGIC = b"\x1f\x8b\x08"
FILES = "path string, size long, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"
STEP = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC 1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    name = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {name}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        name, sink, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, html, sha, refers, again in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha", "refers_to", "is_revisit")), strict=True):
                if sink is None:
                    store.create_dir(f"{top}/archives", recursive=True)
                    sink = store.open_output_stream(f"{top}/archives/{name}", compression=None)
                payload = html.as_buffer().to_pybytes()
                data = member(record(page.as_py(), url.as_py(), payload, sha.as_py(), refers.as_py(), again.as_py()))
                sink.write(data)
                size, n = size + len(data), n + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/archives/{name}"]), pa.array([size]), pa.array([n])], ["path", "size", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; rows: path, size, n_records (saved).

    Responses are found on digests and ids alone, combined before they shuffle, and only
    those of payloads that repeat are written down.  They are joined back as a scan to a
    scan: pages stay where they are while that table is small enough to broadcast, and
    beyond that adaptive execution splits a hot payload, as no aggregate stands between.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_text("html").alias("html"))
    pages = pages.withColumn("sha_hex", F.sha1("html"))
    again = pages.filter(F.octet_length("html") >= least_bytes).groupBy("sha_hex").agg(F.min("page_id").alias("lead_id"), F.count("*").alias("n")).filter("n > 1")
    again = saved(again.select("sha_hex", "lead_id", F.lit(True).alias("again")), folder, "leads")
    marked = pages.join(again, "sha_hex", "left")
    marked = marked.withColumn("is_revisit", F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("lead_id")))
    marked = marked.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.when(F.col("is_revisit"), F.col("lead_id")).alias("refers_to"), "is_revisit", _base32("sha_hex").alias("sha"))
    path = f"{folder}/written"
    marked.mapInArrow(_write(folder), FILES).write.parquet(path)
    return pages.sparkSession.read.schema(FILES).parquet(path)


def _base32(hex_column: str):
    """RFC 4648 base32 of 40 hex digits: eight groups of five."""
    parts = [F.conv(F.substring(hex_column, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = [F.substring(alphabet, F.shiftright(p, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for p in parts for j in range(4)]
    return F.concat(*digits)


class _Bytes:
    """Forward-only window over an archive, so that no archive is held in memory."""

    def __init__(self, source, at: int, size: int) -> None:
        self.source, self.at, self.size, self.data = source, at, size, b""

    def fill(self, n: int) -> bytes:
        """At least n bytes from here on, or all there are."""
        if len(self.data) < n and self.at + len(self.data) < self.size:
            start = self.at + len(self.data)
            self.data += self.source.read_at(min(max(n - len(self.data), STEP), self.size - start), start)
        return self.data

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def inflate(window: _Bytes) -> tuple[bytes, int] | None:
    """(record, compressed length) of the gzip member here; None unless it is a WARC record."""
    unpack, out, used, ask = zlib.decompressobj(31), [], 0, 512
    try:
        while not unpack.eof:
            data = window.fill(used + ask)[used:]
            if not data:
                return None
            out.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            ask = STEP
            if sum(map(len, out[:8])) >= 5 and not b"".join(out[:8]).startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return b"".join(out), used


def parse(data: bytes) -> tuple | None:
    """Row of RECORDS from a record; None if its headers are not those of one."""
    head, sep, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if not sep or kind not in ("response", "revisit"):
        return None
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
    valid = kind == "revisit" or (len(payload) == length and base32_sha1(payload) == sha)
    return number(fields["warc-record-id"]), length, sha, kind, refers, valid


def owned(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records that start in [start, end)."""
    window = _Bytes(source, start, size)
    while window.at < end:
        data = window.fill(STEP)
        if not data:
            return
        if data.startswith(MAGIC) and (got := inflate(window)) is not None:
            yield got[0]
            window.skip(got[1])
            continue
        at = data.find(MAGIC, 1)
        window.skip(at if at > 0 else max(1, len(data) - len(MAGIC) + 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "end")), strict=True):
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as source:
                rows = [x for data in owned(source, size, start, end) if (x := parse(data)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)


TASK_BYTES = 64 << 20


def read_archives(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of archives (path, size): page_id, payload_bytes, payload_digest,
    record_type, refers_to, valid (the payload matches its digest and length).

    files is read twice: first for how many tasks the ranges are dealt out to, one for
    TASK_BYTES of archive, and at least four a core, as far as there are ranges.
    """
    ranges, size = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(ranges, max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "size", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    return ranges.repartition(tasks).mapInArrow(_read, RECORDS)  # a stated number: adaptive execution would put all these small rows in one task


def round_trip(pages: DataFrame, folder: str, least_bytes: int = 0, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  ValueError if a record written is not read, or read damaged."""
    files = write_archives(pages, folder, least_bytes)
    records = saved(read_archives(files, split_bytes), folder, "records")
    check_records(files, records)
    return records.drop("valid")


def check_records(files: DataFrame, records: DataFrame) -> None:
    written = files.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    read, valid = records.agg(F.count("*"), F.count_if("valid")).first()
    if not written == read == valid:
        raise ValueError(f"{written} records were written, {read} read, of which {valid} are valid")
