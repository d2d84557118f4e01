"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Archives go to a folder every executor reaches, through ``pyarrow.fs`` (local, HDFS, object stores). A task names its
files after its attempt, and only files of finished tasks are listed in the result, so lost executors leave no wrong archive.
The reader takes a file in chunks, inflates member by member, frames each record by its content length and verifies its digests.

Defined results: null html is empty; of equal payloads the largest page id is the response and the others revisit it; null
page ids are always responses; repeated rows are records of their own; null urls leave the field out; an empty table writes no record.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, store, text_or_empty

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE, CHUNK, ROLL = "2024-01-01T00:00:00Z", 1 << 16, 256 << 20
RECORD = "file string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page, url, payload: bytes, refers) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    block = HTTP if refers is not None else HTTP + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", str(len(payload)))]
    if refers is not None:
        fields += [("WARC-Refers-To", _name(refers)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("archive ends within a record")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, framed by its content length; digests must hold."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise ValueError("no record head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block, tail = raw[end + 4:end + 4 + size], raw[end + 4 + size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("content length does not frame the record")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest does not hold")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(block[block.find(b'\r\n\r\n') + 4:])}":
        raise ValueError("payload digest does not hold")
    return fields, block


def _page(name: str | None):
    text = name[len("<urn:page:"):-1] if name else ""
    return int(text) if text else None


def write_archives(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write all pages; ``(file, records)`` of every archive. Payloads of ``least`` bytes or more are written once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))
    keys = rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha"), F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    keys = store(keys, "digests")
    first = keys.groupBy("sha").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).filter("n > 1").select("sha", "refers")
    again = keys.join(first, "sha").filter("page_id < refers").select("page_id", "sha", "refers").distinct()
    wide = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers")

    def run(batches):
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        out, done, size, number = None, 0, 0, 0
        made = []

        def close():
            if out is not None:
                out.close()
                made.append((name, done))
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > ROLL:
                    close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, done, size, number = system.open_output_stream(f"{folder}/{name}", compression=None), 0, 0, number + 1
                data = record(page, url, html.encode("utf-8", "surrogatepass"), refers)
                out.write(data)
                done, size = done + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], ["file", "records"])
    return store(wide.mapInArrow(run, "file string, records long"), "archives")


def read_archives(files: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed files; each file is read by one task, record by record."""
    def run(batches):
        system, folder = fs.FileSystem.from_uri(path)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        f, block = parse(raw)
                        fresh = f["warc-type"] == "response"
                        payload = block[block.find(b"\r\n\r\n") + 4:] if fresh else None
                        rows.append((name, _page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], _page(f.get("warc-refers-to")),
                                     len(payload) if fresh else int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), payload if with_payload else None))
                        held += len(raw) if with_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(spread, "file").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new shared folder and read the archives back."""
    path = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path), path, with_payload=False)
