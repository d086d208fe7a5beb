"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record, read back by offset.

Crawl archives often come as one gzip stream per file, which can't be entered in the middle. The normaliser inflates such a
stream once, rewrites every record as a member of its own and writes a sidecar index of (offset, length, record)
next to the file. Afterwards any record is one ranged read. Files are named after the task attempt that wrote them, and only
files that a finished task has listed are used, so a lost executor leaves at most unused files.
"""
from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import utf8
from holdfast.session import cut, fresh_path

PAGE_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def clean(value: str) -> str:
    """A header value without line breaks and other controls."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, which tells the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE_URN}{page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{first}>"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an inflated WARC stream, each with its own bytes; holds one record and one chunk at a time."""
    buf, more = bytearray(), True
    while True:
        while more and (cut_at := buf.find(END)) < 0:
            chunk = next(chunks, None)
            more = chunk is not None
            buf += chunk or b""
        cut_at = buf.find(END)
        if cut_at < 0:
            if bytes(buf).strip():
                raise ValueError("the archive ends inside a record's head")
            return
        head = headers(bytes(buf[:cut_at]))
        size = cut_at + 4 + int(head["content-length"]) + 4
        while len(buf) < size:
            chunk = next(chunks, None)
            if chunk is None:
                raise ValueError("the archive ends inside a record")
            buf += chunk
        yield head, bytes(buf[:size])
        del buf[:size]


def inflated(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, read once from front to end."""
    z = zlib.decompressobj(31)
    while data := stream.read(step):
        while data:
            if out := z.decompress(data, step):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if out := z.flush():
        yield out


def write_archives(rows: DataFrame, folder: str, file_bytes: int = 1 << 27, level: int = 1) -> DataFrame:
    """Write (page_id, url, html, first, revisit) as monolithic WARC files; returns file, n_records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        task = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        out, z, n, size, part, done = None, None, 0, 0, 0, []

        def close():
            out.write(z.flush())
            out.close()
            done.append((f"{folder}/{task}-{part}.warc.gz", n))
        for b in batches:
            raw, off = utf8(b["html"])
            raw = raw.tobytes()
            for i, j, page, url, first, revisit in zip(off[:-1].tolist(), off[1:].tolist(), *(b[c].to_pylist() for c in ("page_id", "url", "first", "revisit"))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, z, n, size = fs.open_output_stream(f"{root}/{task}-{part}.warc.gz", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                payload = raw[i:j]
                data = record(page, url, payload, digest32(payload), first, revisit)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["file", "n_records"])
    return rows.mapInArrow(run, "file string, n_records long")


def normalise(files: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite every file with one gzip member per record, and an index beside it; returns file, offset, length, record.

    Any gzip WARC files will do, of one stream or of many members.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = place(folder)
        for b in batches:
            for file in b["file"].to_pylist():
                source, path = place(file)
                name = f"{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}"
                target.create_dir(root, recursive=True)
                offset, index = 0, []
                with source.open_input_stream(path, compression=None) as stream, target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out:
                    for head, data in records(inflated(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        index.append((offset, len(member), head["warc-record-id"]))
                        offset += len(member)
                with target.open_output_stream(f"{root}/{name}.idx") as side:
                    side.write("".join(json.dumps({"offset": o, "length": n, "id": r}) + "\n" for o, n, r in index).encode())
                for i in range(0, len(index), 10_000):
                    o, n, r = zip(*index[i:i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"] * len(o), pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.string())], ["file", "offset", "length", "record"])
    return files.select("file").mapInArrow(run, "file string, offset long, length long, record string")


def page_of(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(value) if value.lstrip("-").isdigit() else None


def read_records(index: DataFrame) -> DataFrame:
    """Ranged reads of the index's members: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is hashed again and must have the digest and length that its record states.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for b in batches:
            page, size, digest, kind, ref = [], [], [], [], []
            for file, offset, length in zip(*(b[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if handle is not None:
                        handle.close()
                    source, path = place(file)
                    name, handle = file, source.open_input_file(path)
                data = zlib.decompress(handle.read_at(length, offset), 31)
                at = data.index(END)
                head = headers(data[:at])
                body = data[at + 4:-4]
                http_end = body.index(END)
                n = int(headers(body[:http_end])["content-length"])
                stated = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(body) - http_end - 4 != n or digest32(body[http_end + 4:]) != stated):
                    raise ValueError(f"{file} at {offset}: the payload isn't the one that its record states")
                page.append(page_of(head["warc-record-id"]))
                size.append(n)
                digest.append(stated)
                kind.append(head["warc-type"])
                ref.append(page_of(head.get("warc-refers-to")))
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(ref, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if handle is not None:
            handle.close()
    return index.select("file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, normalise the archives and read all records back by offset.

    Of pages with equal payloads (SHA-256 and length) of at least ``min_bytes`` bytes the one with the smallest
    page_id is a response and the others revisit it; smaller payloads are all responses. A null html is an
    empty payload; a null url leaves the target out; rows that repeat a page_id are records of their own, and those with the
    smallest id of their group are all responses; a null page_id revisits if there is one to revisit; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    key = [F.sha2(F.col("html"), 256).alias("sha"), F.octet_length("html").alias("bytes")]
    firsts = rows.select("page_id", *key).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"))
    rows = rows.select("*", *key).join(firsts, ["sha", "bytes"])
    revisit = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "first", revisit.alias("revisit"))
    raw = fresh_path(spark, "warc-stream")
    files = cut(write_archives(rows, raw), "warc-files")
    # One file is one row here; each becomes a task of its own, up to a bound on tasks.
    n = files.count()
    index = cut(normalise(files.repartition(max(1, min(n, 10_000))), fresh_path(spark, "warc")), "warc-index")
    fs, root = place(raw)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)
    return read_records(index)
