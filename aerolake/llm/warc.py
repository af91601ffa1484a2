"""Web archives: records are written with an index, and read back through it by coalesced byte ranges.

Writing decides first, on digests alone, which record of equal payloads is the response; then each task
writes its records, one gzip member each, to archives of its own and returns the index: archive, offset,
length, URL, digest. Reading sorts the wanted index rows by archive and offset, joins neighbouring ranges
into one read and takes the records apart.

Archives lie under a folder that all executors share and that ``pyarrow.fs`` can open. Each attempt of a
task writes files of its own name, and only a successful attempt's rows are in the index, so that a lost
or repeated task leaves at most a file that nothing refers to.

Defined results: a null html is an empty payload, a null url gives no target header; of rows with the
same page_id and the same payload all are responses if that page_id is the largest, and a null page_id is
below all others; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.llm.text import slices
from aerolake.session import cut, shared_folder

MIN_PAYLOAD = 0
ARCHIVE_BYTES = 256_000_000
#: Ranges up to this far apart are read as one, up to ``READ_BYTES``.
GAP_BYTES = 65_536
READ_BYTES = 8_000_000
#: The profile of revisits by equal payload, and the date of records without one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, url string, digest string, record_type string, archive string, offset bigint, length bigint"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's bytes."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. Control characters of a URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page, digest), "WARC-Date": DATE,
              "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Length": str(len(block))}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if page is not None:
        fields["X-Page-Id"] = str(page)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(header fields, payload length, payload) of one record; the payload of a revisit is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    return fields, length, payload


def record_kinds(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(k_page, k_digest, k_first): of every page and payload the page that holds the response.

    Runs on digests only: a partial maximum per payload, joined back to the pages.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    light = pages.select(F.col("page_id").cast("bigint").alias("k_page"), payload_digest(html).alias("k_digest"), F.octet_length(html).alias("k_size")).distinct()
    largest = light.filter(F.col("k_size") >= min_payload).groupBy(F.col("k_digest").alias("l_digest"), F.col("k_size").alias("l_size")).agg(F.max("k_page").alias("k_first"))
    joined = light.join(largest, (F.col("k_digest") == F.col("l_digest")) & (F.col("k_size") == F.col("l_size")), "left")
    return joined.select("k_page", "k_digest", F.when(F.col("k_size") >= min_payload, F.col("k_first")).otherwise(F.col("k_page")).alias("k_first"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page under ``folder`` and returns the index as a written table."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), payload_digest(html).alias("digest"))
    kinds = record_kinds(pages, min_payload)
    joined = rows.join(kinds, F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("digest") == F.col("k_digest")), "left").select("page_id", "url", "html", "digest", "k_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        stream, name, at, number = None, "", 0, 0
        try:
            for batch in (part for whole in batches for part in slices(whole, "html")):
                out = []
                for page, url, text, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                    revisit = page != first
                    data = gzip.compress(record(page, url, digest, text.encode(), first, revisit), 5, mtime=0)
                    if stream is None or at + len(data) > archive_bytes and at:
                        if stream is not None:
                            stream.close()
                        else:
                            files.create_dir(base, recursive=True)
                        name = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                        stream, at, number = files.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                    stream.write(data)
                    out.append((page, url, digest, "revisit" if revisit else "response", name, at, len(data)))
                    at += len(data)
                kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "url", "digest", "record_type", "archive", "offset", "length"])
        finally:
            if stream is not None:
                stream.close()

    return cut(joined.mapInArrow(run, INDEX))


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as reads: archive, start, end, and the records inside."""
    held: tuple | None = None
    for archive, offset, length in rows:
        if held and held[0] == archive and offset - held[2] <= GAP_BYTES and offset + length - held[1] <= READ_BYTES:
            held[3].append((offset, length))
            held = (archive, held[1], max(held[2], offset + length), held[3])
        else:
            if held:
                yield held
            held = (archive, offset, offset + length, [(offset, length)])
    if held:
        yield held


def _parsed(data: bytes, start: int, records: list[tuple[int, int]], with_payload: bool) -> Iterator[list[tuple]]:
    """The rows of the records of one read, in lists of at most ``READ_BYTES`` of payload or one record. A payload that
    is not asked for is held no longer than its digest takes, so that what a read unpacks to does not add up."""
    out, held = [], 0
    for offset, length in records:
        fields, size, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
        if with_payload and out and held + len(payload) > READ_BYTES:
            yield out
            out, held = [], 0
        held += len(payload)
        page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
        out.append((None if page is None else int(page), fields.get("WARC-Target-URI"), kind, digest, size, None if first in (None, "None") else int(first),
                    *([payload] if with_payload else [])))
    if out:
        yield out


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the index rows: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A digest that differs from the payload's, or a record that is cut, fails the job.
    """
    wanted = index.select("archive", "offset", "length").repartition("archive", F.floor(F.col("offset") / (4 * READ_BYTES))).sortWithinPartitions("archive", "offset")
    schema = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *([pa.binary()] if with_payload else [])]
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *(["payload"] if with_payload else [])]
        opened, source = "", None
        for batch in batches:
            for archive, start, end, records in _ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if archive != opened:
                    opened, source = archive, files.open_input_file(f"{base}/{archive}")
                data = source.read_at(end - start, start)
                for out in _parsed(data, start, records, with_payload):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return wanted.mapInArrow(run, schema)


def archive_folder(spark) -> str:
    return f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
