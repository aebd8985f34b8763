"""WARC archives with an index.

Writing: one gzip member per record, into archives of at most about `roll_bytes`, each named for the attempt that
wrote it, so a task that runs again never touches another's file; only files that the index names count. The index
has a row for each record: archive, offset, length, URL, payload digest.

Of records with equal payloads of at least `min_revisit` bytes, the one with the least page id is the response and
the others revisit it; shorter ones are all responses. Null html is an empty payload. Rows that share the least page
id are all responses; a null page id never is the least, but where all are null each is a response. A null URL gives
a record without target. No rows: no records.

Reading: the selected index rows are sorted by archive and offset, neighbours are read with one request of at most
`read_bytes`, and each record is parsed and its digest checked; a record that doesn't match is an error.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import new_folder
from .common import staged

MIN_REVISIT, ROLL_BYTES, READ_BYTES, READ_GAP, DATE = 100, 64 << 20, 4 << 20, 64 << 10, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, archive string, offset bigint, length bigint, url string, payload_digest string, record_type string"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A row of RECORDS from one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != size:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its header")
    else:
        payload = None
    refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, size, digest, payload


class _Archive:
    def __init__(self, folder: str, name: str, date: str, level: int):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.name, self.level, self.at = f"{folder}/{name}", level, 0
        self.out = self.store.open_output_stream(f"{path}/{name}", compression=None)
        text = b"software: record writer\r\nformat: WARC File Format 1.1\r\n"
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}\r\n\r\n".encode() + text + b"\r\n\r\n")

    def add(self, data: bytes) -> tuple[int, int]:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)


def _write(folder: str, roll_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, archive = TaskContext.get(), 0, None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    places = []
                    for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if archive is None or archive.at >= roll_bytes:
                            if archive is not None:
                                archive.out.close()
                            archive = _Archive(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:03d}.warc.gz", date, level)
                            count += 1
                        places.append((archive.name, *archive.add(record(page_id, url, payload, digest, refers_to, kind == "revisit", date))))
                    names, offsets, lengths = zip(*places, strict=True) if places else ((), (), ())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), part.column(1), part.column(3), part.column(4)], names=["page_id", "archive", "offset", "length", "url", "payload_digest", "record_type"])
        finally:
            if archive is not None:
                archive.out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES, date: str = DATE, level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) to archives; returns the stored index."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    # payloads move once, by page and digest; only keys meet on digests, and Spark can split a hot one, as what they meet is stored
    keys = p.where(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    first = staged(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "firsts")
    again = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    found = p.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    marked = found.select("page_id", "url", "payload", "digest", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")
    return staged(marked.mapInArrow(_write(folder, roll_bytes, date, level), INDEX), "warc-index")


def _read(read_bytes: int, gap: int, with_payload: bool):
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def requests(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + gap or row[1] + row[2] - group[0][1] > read_bytes):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        name = source = None
        for group in requests(rows):
            if group[0][0] != name:
                if source is not None:
                    source.close()
                name = group[0][0]
                store, path = fs.FileSystem.from_uri(name)
                source = store.open_input_file(path)
            start = group[0][1]
            data = io.BytesIO(source.read_at(group[-1][1] + group[-1][2] - start, start)).getbuffer()
            found = [parse(zlib.decompress(data[at - start : at - start + n], 31)) for _, at, n in group]
            columns = list(zip(*found, strict=True))
            if not with_payload:
                columns[-1] = [None] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, with_payload: bool = True, read_bytes: int = READ_BYTES, gap: int = READ_GAP) -> DataFrame:
    """The records of the index rows given. A revisit's payload is null; its bytes and digest are those of the full payload."""
    # the index is small beside what it stands for, so the number of tasks follows the bytes to read
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // (4 * read_bytes)))
    sorted_rows = index.select("archive", "offset", "length").repartition(tasks, "archive", (F.col("offset") / F.lit(4 * read_bytes)).cast("bigint")).sortWithinPartitions("archive", "offset")
    return sorted_rows.mapInArrow(_read(read_bytes, gap, with_payload), RECORDS)
