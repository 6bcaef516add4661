"""Web archives packaged in ZIP files, and a reader that extracts nothing.

Writing: a page is a WARC record, gzipped on its own, in the stored member
``archive/data.warc.gz`` of a ZIP of about ``ARCHIVE_BYTES``; the stored member
``indexes/index.cdxj`` has the place of each record. Of records with the same
payload of at least ``LEAST_BYTES`` that of the smallest page_id is a
response and the others revisit it. A task's files carry its attempt, and only
those of attempts that succeeded are in the manifest.

Reading: the end record of a ZIP, its ZIP64 form where there is one, and the
central directory give the stored members; the index gives ranges within
them, and neighbouring ranges are read together. Records are parsed from those
bytes; nothing else of the file is read. An index that names a member that is
missing or deflated is an error. A response's payload is checked against its own
digest, and a revisit's length and digest against its response.

A null html is an empty payload. A null page_id is written and read as null
and is never revisited, nor a revisit. Rows that repeat the smallest page_id of
a payload are each a response. No pages make no archives and no rows.
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
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, written

LEAST_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: The most bytes that one read of neighbouring records takes, unless a record is larger.
READ_BYTES = 4 << 20
_RECORDS, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_INDEXES = (".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record: a response, or without its payload a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_id(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def parse(raw: bytes) -> dict:
    """What a record says: page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its digest says")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page_id(refers) if refers else None, "payload": None if revisit else payload}


class Archive:
    """Records gathered for one ZIP file."""

    def __init__(self) -> None:
        self.data, self.index, self.n = io.BytesIO(), [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 2, mtime=0)
        place = {"url": url, "filename": _RECORDS.split("/")[1], "offset": str(self.data.tell()), "length": str(len(packed))}
        self.index.append(f"{''.join((url or '-').split())} 20240101000000 {json.dumps(place)}")
        self.data.write(packed)
        self.n += 1

    def packaged(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((_RECORDS, self.data.getbuffer()), (_INDEX, "\n".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                    f.write(body)
        return out.getvalue()


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int  # where its local header begins


def directory(source: pa.NativeFile, size: int) -> list[Member]:
    """The members of a ZIP file by its central directory, ZIP64 or not."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = _range(source, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a central directory")
    entries, length, at = struct.unpack_from("<HII", tail, end + 10)
    if (entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, end - 12)
        entries, length, at = struct.unpack_from("<QQQ", _range(source, where, 56), 32)
    raw, k, out = _range(source, at, length), 0, []
    for _ in range(entries):
        if raw[k : k + 4] != b"PK\1\2":
            raise ValueError("a central directory entry is broken")
        method, packed, plain, n, extra, comment, header = (*struct.unpack_from("<H", raw, k + 10), *struct.unpack_from("<IIHHH", raw, k + 20), *struct.unpack_from("<I", raw, k + 42))
        name, fields = raw[k + 46 : k + 46 + n].decode(), raw[k + 46 + n : k + 46 + n + extra]
        wide = _zip64(fields, [plain, packed, header])
        out.append(Member(name, method == 0, wide[1], wide[2]))
        k += 46 + n + extra + comment
    return out


def _zip64(fields: bytes, values: list[int]) -> list[int]:
    """The values, with those of 2**32 - 1 replaced from the ZIP64 field, in the field's order."""
    k = 0
    while k + 4 <= len(fields):
        kind, n = struct.unpack_from("<HH", fields, k)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", fields, k + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        k += 4 + n
    return values


def _range(source: pa.NativeFile, at: int, n: int) -> bytes:
    source.seek(at)
    got = source.read(n)
    if len(got) != n:
        raise ValueError("the file ends too early")
    return got


def _data_at(source: pa.NativeFile, member: Member) -> int:
    n, extra = struct.unpack_from("<HH", _range(source, member.header, 30), 26)
    return member.header + 30 + n + extra


def records(source: pa.NativeFile, size: int) -> Iterator[dict]:
    """All records of a packaged archive, by range reads of what its indexes list."""
    members = {m.name: m for m in directory(source, size)}
    for name in sorted(n for n in members if n.startswith("indexes/") and n.endswith(_INDEXES)):
        raw = _range(source, _data_at(source, _stored(members, name)), members[name].size)
        lines = (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().split("\n")
        places: dict[str, list[tuple[int, int]]] = {}
        for line in filter(None, lines):
            x = json.loads(line.split(" ", 2)[2])
            places.setdefault(f"archive/{x['filename']}", []).append((int(x["offset"]), int(x["length"])))
        for file, spans in places.items():
            base = _data_at(source, _stored(members, file))
            for group in _together(sorted(spans)):
                first, last = group[0][0], group[-1][0] + group[-1][1]
                raw = _range(source, base + first, last - first)
                for at, n in group:
                    yield parse(gzip.decompress(raw[at - first : at - first + n]))


def _stored(members: dict[str, Member], name: str) -> Member:
    """A member whose bytes stand in the file as they are; ranges of others can't be read."""
    if name not in members:
        raise ValueError(f"the archive has no member {name}")
    if not members[name].stored:
        raise ValueError(f"{name} is deflated: its records have no ranges")
    return members[name]


def _together(spans: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    group: list[tuple[int, int]] = []
    for at, n in spans:
        if group and (group[-1][0] + group[-1][1] != at or at + n - group[0][0] > READ_BYTES):
            yield group
            group = []
        group.append((at, n))
    if group:
        yield group


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to ZIP files in folder, a URI that all executors reach; the manifest: path, size, n_records."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))
    long_ones = rows.where((F.octet_length("html") >= LEAST_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"))
    thin = written(long_ones, "digests")
    groups = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    again = broadcast_if_small(thin.join(groups, "digest").where("page_id <> refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct())
    marked = rows.withColumn("digest", digest).join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        attempt, k, archive = TaskContext.get().taskAttemptId(), 0, Archive()

        def flush() -> pa.RecordBatch:
            nonlocal k, archive
            name, body = f"pages-{attempt}-{k}.wacz", archive.packaged()
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(body)
            got = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [len(body)], "n_records": [archive.n]})
            k, archive = k + 1, Archive()
            return got

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                archive.add(page_id, url, html.encode(), refers_to)
                if archive.data.tell() >= archive_bytes:
                    yield flush()
        if archive.n:
            yield flush()

    return written(marked.mapInArrow(run, "path string, size long, n_records long"), "manifest")


def checked(records_: DataFrame) -> DataFrame:
    """The same rows, once every revisit's length and digest are those of a response that it refers to; else an error that names one."""
    found = written(records_, "records")
    same = ["refers_to", "payload_bytes", "payload_digest"]
    claims = found.where("record_type = 'revisit'").select(*same).distinct()  # one a payload, however many pages share it
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    for bad in claims.join(there, same, "left_anti").limit(1).collect():
        raise ValueError(f"page {bad.refers_to} is not the response of {bad.payload_bytes} bytes with digest {bad.payload_digest} that is referred to")
    return found


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the manifest's archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as source:
                    found = [[r[n] for n in names] for r in records(source, size)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    parts = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("path", "size").repartition(parts, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """pages written to archives and read back, revisits checked against their responses."""
    return checked(read(write(pages, f"{folder}/archives-{uuid.uuid4().hex}")))
