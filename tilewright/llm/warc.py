"""Web archives packed in ZIP files: writing them, and reading single records by byte range.

An archive is a ZIP file of stored (not deflated) members: ``archive/data.warc.gz``, whose records
are compressed one by one, and ``indexes/index.cdxj``, one line per record with its place in that member.

*Writing*: pages of equal payload (SHA-256, at least ``least`` bytes) are one response, that of the
smallest page_id, and revisits of it. Each task streams its pages into archives of about
``archive_bytes``; only the archives that a finished task names are in the manifest, so a
repeated task leaves nothing behind that is read.

*Reading*: the end record, ZIP64 locator and central directory are read from the file's end, members
located by their local headers, indexes read as byte ranges of the ZIP file. Records are then dealt by
place, neighbouring ones fetched in one read, and nothing is extracted. A data member without an index
is walked record by record. A deflated data or index member is an error.

Files are reached through pyarrow's file systems, which know the shared folder's scheme.

Null html is an empty payload. Null page ids are responses and read back as null. Repeated rows are
records of their own. An empty table has no archives and no records. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .store import materialise

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 4 << 20  # neighbouring records are fetched together up to this size
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


# Signatures and layouts of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> tuple[bytes, str]:
    """One WARC record and the payload's digest. A revisit has the HTTP header only."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes, with_payload: bool) -> dict:
    """The fields of a record; a response's digest and length are those of the payload found."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if x and (x := x.removeprefix("<urn:x-page:").removesuffix(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
            "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload and not revisit else None}


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows (page_id, digest, refers_to) of pages whose payload an earlier page has; html stays where it is."""
    known = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length("html").alias("n"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest")).where(F.col("n") >= least)
    first = known.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("refers_to != _last").drop("_last")
    return known.join(first, ["digest", "n"]).where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, least: int = 100, archive_bytes: int = 64 << 20, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write all pages (page_id, url, html) below the shared folder; returns the manifest (path, records)."""
    folder = fresh_path(pages.sparkSession, "archives")
    again = materialise(revisits(pages, least), "revisits").withColumnRenamed("page_id", "_page")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha2(F.encode("html", "UTF-8"), 256).alias("_own"))
    rows = rows.join(again, (F.col("page_id") == F.col("_page")) & (F.col("_own") == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        state: dict = {}

        def close() -> pa.RecordBatch:
            state["data"].close()
            with state["zip"].open(zipfile.ZipInfo(INDEX), "w") as index:
                index.write("".join(state["lines"]).encode())
            state["zip"].close()
            state["stream"].close()
            out = pa.RecordBatch.from_arrays([pa.array([state["name"]]), pa.array([len(state["lines"])], pa.int64())], names=["path", "records"])
            state.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                if not state:
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = files.open_output_stream(f"{base}/{name}")
                    packed = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    state.update(name=f"{folder}/{name}", stream=stream, zip=packed, data=packed.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), lines=[], at=0)
                data, digest = record(page_id, url, (html or "").encode(), refers_to, date)
                data = zlib.compress(data, 1, 31)
                state["data"].write(data)
                about = {"offset": state["at"], "length": len(data), "digest": f"sha256:{digest}", "filename": DATA.split("/")[-1]}
                state["lines"].append(f"{json.dumps(url or '-')} {re.sub('[^0-9]', '', date)} {json.dumps(about)}\n")
                state["at"] += len(data)
                if state["at"] >= archive_bytes:
                    yield close()
        if state:
            yield close()

    return materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(pack, "path string, records bigint"), "manifest")


def members(file, size: int) -> list[dict]:
    """name, method, size and place of the data of every member, from the directories alone."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    _, _, _, _, count, length, at, _ = struct.unpack_from("<4s4H2LH", tail, end)
    if FULL16 == count or FULL32 in (length, at):
        mark, _, where, _ = struct.unpack("<4sLQL", read(tail_at + end - 20, 20))
        if mark == LOCATOR64:
            mark, *_, count, length, at = struct.unpack("<4sQ2H2L4Q", read(where, 56))
            if mark != END64:
                raise ValueError("broken ZIP64 directory")
    data, place, out = read(at, length), 0, []
    for _ in range(count):
        if data[place : place + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        method, = struct.unpack_from("<H", data, place + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2L3H", data, place + 20)
        local, = struct.unpack_from("<L", data, place + 42)
        name = data[place + 46 : place + 46 + n_name].decode()
        extra = data[place + 46 + n_name : place + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:  # ZIP64: only the values that don't fit, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(values) if plain == FULL32 else plain
                packed = next(values) if packed == FULL32 else packed
                local = next(values) if local == FULL32 else local
            extra = extra[4 + n :]
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        out.append({"name": name, "method": method, "size": packed, "at": local + 30 + sum(struct.unpack_from("<2H", head, 26))})
        place += 46 + n_name + n_extra + n_comment
    return out


def walk(file, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(place, length) of the compressed records of a data member without index."""
    end, begin, place = at + size, at, at
    unpack = zlib.decompressobj(31)
    file.seek(at)
    while place < end:
        data = file.read(min(READ_BYTES, end - place))
        if not data:
            raise ValueError("the member ends too early")
        place += len(data)
        while data:
            unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                yield begin, place - len(data) - begin
                begin, unpack = place - len(data), zlib.decompressobj(31)


def locate(archives: DataFrame) -> DataFrame:
    """Rows (path, at, length): the byte range of every record in the ZIP file itself."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as file:
                    found = {m["name"]: m for m in members(file, file.size())}
                    for m in found.values():
                        if m["method"] and m["name"].startswith(("archive/", "indexes/")):
                            raise ValueError(f"{m['name']} of {path} is not stored")
                    data = {n.split("/")[-1]: m for n, m in found.items() if n.startswith("archive/")}
                    ranges, indexed = [], set()
                    for m in found.values():
                        if m["name"].startswith("indexes/"):
                            file.seek(m["at"])
                            for line in file.read(m["size"]).decode().splitlines():
                                about = json.loads(line[line.index(" {") + 1 :])
                                ranges.append((data[about["filename"]]["at"] + about["offset"], about["length"]))
                                indexed.add(about["filename"])
                    for short, m in data.items():
                        if short not in indexed:
                            ranges += walk(file, m["at"], m["size"])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.int64())], names=["path", "at", "length"])

    return archives.select("path").mapInArrow(look, "path string, at bigint, length bigint")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives (column path): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (both of the full payload, for revisits too) and payload (null for revisits)."""
    ranges = materialise(locate(archives), "ranges")
    # tasks by the bytes they will read, not by the size of the rows that name them
    tasks = 1 + (ranges.agg(F.sum("length")).first()[0] or 0) // (2 * READ_BYTES)
    dealt = ranges.repartition(tasks, "path", F.expr(f"at div {READ_BYTES}")).sortWithinPartitions("path", "at")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            low = 0
            while low < len(rows):
                path, at, length = rows[low]
                high, end = low + 1, at + length
                while high < len(rows) and rows[high][0] == path and rows[high][1] == end and end + rows[high][2] - at <= READ_BYTES:
                    end += rows[high][2]
                    high += 1
                if path != open_path:
                    if file:
                        file.close()
                    files, name = fs.FileSystem.from_uri(path)
                    open_path, file = path, files.open_input_file(name)
                file.seek(at)
                data = file.read(end - at)
                out = [parse(zlib.decompress(data[r[1] - at : r[1] - at + r[2]], 31), with_payload) for r in rows[low:high]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in zip(names, types)], names=names)
                low = high
        if file:
            file.close()

    return dealt.mapInArrow(fetch, RECORD)
