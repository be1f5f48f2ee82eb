"""WARC records in ZIP archives: written by tasks, found again through the ZIP directories, and read by byte ranges.

An archive holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj`` (one JSON line per
record with its offset and length), both stored, not compressed again. A reader needs the end of the file, the central
directory (ZIP64 where sizes or counts ask for it), the local headers and the index; records are then read as ranges.

Files are reached through pyarrow's file systems, so the folder may be any that pyarrow knows by its address.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import salted_lookup, shared_folder, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes of records after which a task begins another archive.
ARCHIVE = 32 << 20
#: Neighbouring records are fetched in ranges of so many bytes.
FETCH = 4 << 20
#: Reading tasks at most; with more archives a task reads several, one after another.
TASKS = 10_000
#: Shorter payloads are written as responses each.
LEAST = 100
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def with_types(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """``pages`` with payload (binary), digest, type (response or revisit) and refers_to.

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest key are responses.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumn("_payload", body).withColumn("_digest", F.sha2("_payload", 256))
    small = rows.select(F.col(key).alias("_key"), "_digest", F.length("_payload").alias("_n"))
    first = small.where(F.col("_n") >= least).groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    later = salted_lookup(small.where(F.col("_n") >= least), first, "_digest", "_key").where("_first is not null and not (_key <=> _first)")
    later = later.groupBy(F.col("_key").alias("_k"), F.col("_digest").alias("_d")).agg(F.first("_first").alias("refers_to"))
    return rows.join(later, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left").select(
        F.col(key).alias("key"), "url", F.col("_payload").alias("payload"), F.col("_digest").alias("digest"),
        F.when(F.col("_d").isNull(), "response").otherwise("revisit").alias("type"), "refers_to")


def _name(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(key)}", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], lines: list[dict], zip64: bool = False) -> bytes:
    """A ZIP archive of gzip members and their index; sizes are written as ZIP64 where they need it or ``zip64`` asks for it."""
    out = io.BytesIO()
    index = "".join(f"{line.pop('key')} {json.dumps(line)}\n" for line in lines).encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(records)), (INDEX, index)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def written(pages: DataFrame, folder: str, size: int = ARCHIVE) -> DataFrame:
    """Write archives under ``folder``; (path, records) of each. Rows as of ``with_types``.

    A task's files have names of their own, and only those of tasks that ended well are listed, so a task that runs again
    leaves no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        records, lines, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal records, lines, held
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            n = len(records)
            with system.open_output_stream(path) as f:
                f.write(archive(records, lines))
            records, lines, held = [], [], 0
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

        for batch in batches:
            for row in batch.to_pylist():
                data = gzip.compress(record(row["key"], row["url"], row["payload"], row["digest"], row["type"], row["refers_to"]), 4, mtime=0)
                lines.append({"key": _name(row["key"]), "offset": held, "length": len(data), "filename": DATA})
                records.append(data)
                held += len(data)
                if held >= size:
                    yield close()
        if records:
            yield close()

    return stored(pages.select("key", "url", "payload", "digest", "type", "refers_to").mapInArrow(run, "path string, records bigint"), "warc-archives")


class ZipReader:
    """Members of a ZIP file through range reads of ``read(offset, length)``."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - (1 << 16) - 22 - 20)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(_EOCD)
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(_EOCD, 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == _LOCATOR:
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            record = read(at, 56)
            if record[:4] != _EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        self.members = dict(self._directory(read(offset, length), count))

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            offset, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n_name].decode()
            extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
            while extra + 4 <= end:
                tag, size = struct.unpack_from("<HH", data, extra)
                if tag == 1:  # ZIP64: only the fields that are all ones, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", data, extra + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                extra += 4 + size
            yield name, (method, offset, packed)
            at = end + n_note

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes."""
        method, offset, length = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, not stored")
        head = self.read(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, length


def parse(data: bytes) -> dict:
    """Headers and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return fields | {"payload": payload, "payload-bytes": int(sizes[0]) if sizes else len(payload)}


def _number(name: str | None) -> int | None:
    return None if name is None or name == _name(None) else int(name.rpartition(":")[2].rstrip(">"))


def records(archives: DataFrame, folder: str, fetch: int = FETCH, keep_payload: bool = True) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of the archives.

    The digest of a response is checked against its payload; a difference is an error. A revisit has no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_file(path) as f:
                    yield from of_archive(f)

    def of_archive(f) -> Iterator[pa.RecordBatch]:
        read = lambda at, n: f.read_at(n, at)
        zipped = ZipReader(read, f.size())
        base, _ = zipped.place(DATA)
        lines = [json.loads(line.partition(" ")[2]) for line in read(*zipped.place(INDEX)).decode().splitlines()]
        lines.sort(key=lambda x: x["offset"])
        at = 0
        while at < len(lines):
            to, begin = at + 1, lines[at]["offset"]
            while to < len(lines) and lines[to]["offset"] + lines[to]["length"] - begin <= fetch:
                to += 1
            data = read(base + begin, lines[to - 1]["offset"] + lines[to - 1]["length"] - begin)
            out = [row(gzip.decompress(data[x["offset"] - begin : x["offset"] - begin + x["length"]])) for x in lines[at:to]]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            at = to

    def row(data: bytes) -> dict:
        found = parse(data)
        digest = found["warc-payload-digest"].removeprefix("sha256:")
        if found["warc-type"] == "response" and hashlib.sha256(found["payload"]).hexdigest() != digest:
            raise ValueError(f"the payload of {found['warc-record-id']} has another digest")
        return {"key": _number(found["warc-record-id"]), "url": found["warc-target-uri"], "payload_bytes": found["payload-bytes"],
                "payload_digest": digest, "record_type": found["warc-type"], "refers_to": _number(found.get("warc-refers-to"))} | (
                {"payload": found["payload"] if found["warc-type"] == "response" else None} if keep_payload else {})

    types = {"key": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if keep_payload else {})
    arrow = pa.schema(types)
    schema = "key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * keep_payload
    # numbered, so that small rows of paths are not put together: an archive is read by a task of its own
    n = min(max(archives.count(), 1), TASKS)
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", keep_payload: bool = True) -> DataFrame:
    """Write all rows of ``pages`` (key, url, payload) to archives in the shared folder and read their records back.

    A null payload counts as empty, a null url as ``urn:none``; a null key comes back null and is never referred to.
    Repeated rows are written each; equal rows that hold the smallest key are all responses. Other columns are ignored.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = records(written(with_types(pages.select(key, "url", payload), key, payload), folder), folder, keep_payload=keep_payload)
    return found.withColumnRenamed("key", key)
