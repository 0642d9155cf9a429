"""WARC records in ZIP archives: writing, and reading by range without extraction.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.cdxj``, a line for
each record with its offset and length. The reader parses the end of central
directory, the ZIP64 records where there are some, and the central directory;
finds the stored members' data behind their local headers; reads the index; and
then reads runs of records by range, so that a large archive is shared by many
tasks and nothing is unpacked to disk.

Equal payloads of at least ``least`` bytes are stored once: the record with the
largest page_id is the response, the others revisit it.

Defined cases: null html is an empty payload; null urls are empty; a record
without page_id is always a response; rows that repeat the largest page_id and
its payload are all responses; an empty table makes no archive and no record;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes after which a task starts another archive, and the most that one range read takes.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 2 << 20
_DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow reaches: file:, hdfs:, s3: (s3a: and s3n: are its Hadoop names), gs:."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    head, rest = uri.split(":", 1)
    if head == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if head in ("s3a", "s3n") else head) + ":" + rest)


# ---- ZIP ----


def zip_local(name: str, size: int, crc: int, zip64: bool) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
    n = 0xFFFFFFFF if zip64 else size
    return struct.pack("<4s5H3I2H", b"PK\3\4", 45 if zip64 else 20, 0, 0, 0, 33, crc, n, n, len(name), len(extra)) + name.encode() + extra


def zip_tail(members: list[tuple[str, int, int, int]], at: int, zip64: bool) -> bytes:
    """Central directory and end records; members: name, size, crc, offset of the local header."""
    central = b""
    for name, size, crc, offset in members:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if zip64 else b""
        n, o = (0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (size, offset)
        central += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if zip64 else 20, 0, 0, 0, 33, crc, n, n, len(name), len(extra), 0, 0, 0, 0, o) + name.encode() + extra
    end = b""
    if zip64:
        end += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
        end += struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    n, size, where = (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (len(members), len(central), at)
    return central + end + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, size, where, 0)


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of an archive: name to (offset of the data, bytes). ``read(offset, n)`` reads a range."""
    back = min(size, 22 + 0xFFFF)
    tail = read(size - back, back)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, _, n, csize, cat, _ = struct.unpack("<4s4H2IH", tail[at : at + 22])
    if 0xFFFF == n or 0xFFFFFFFF in (csize, cat):
        where = size - back + at - 20
        mark, _, end64, _ = struct.unpack("<4sIQI", read(where, 20)) if where >= 0 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            mark, *_, n, csize, cat = struct.unpack("<4sQ2H2I4Q", read(end64, 56))
            if mark != b"PK\6\6":
                raise ValueError("broken ZIP64 end record")
    central, out, i = read(cat, csize), {}, 0
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, full, nl, el, cl, _, _, _, local = struct.unpack("<4s6H3I5H2I", central[i : i + 46])
        if mark != b"PK\1\2":
            raise ValueError("broken central directory")
        name = central[i + 46 : i + 46 + nl].decode("utf-8", "replace")
        extra = central[i + 46 + nl : i + 46 + nl + el]
        i += 46 + nl + el + cl
        while len(extra) >= 4:
            kind, k = struct.unpack("<2H", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + k :]
        if method or flags & 1:  # compressed or encrypted members can't be read by range
            continue
        head = read(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        a, b = struct.unpack("<2H", head[26:30])
        out[name] = (local + 30 + a + b, packed)
    return out


# ---- WARC ----


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i, d: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {d}')}>"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, digest)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """RECORDS' columns of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    _, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    whole = lambda k: int(h[k]) if k in h else None
    if h["warc-type"] == "revisit":
        return whole("warc-page-id"), h.get("warc-target-uri", ""), "revisit", whole("warc-refers-to-page-id"), None, h["warc-payload-digest"].partition(":")[2], None
    return whole("warc-page-id"), h.get("warc-target-uri", ""), "response", None, len(payload), hashlib.sha1(payload).hexdigest(), payload


class _Archive:
    """One ZIP file being written: records as they come, the index and directory at the end."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, path = _filesystem(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.parts, self.lines, self.size, self.crc, self.fs, self.path = [], [], 0, 0, fs, path

    def add(self, page_id, url, payload, digest, refers_to) -> None:
        z = zlib.compressobj(5, zlib.DEFLATED, 31)
        data = z.compress(record(page_id, url, payload, digest, refers_to)) + z.flush()
        self.lines.append(json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": self.size, "length": len(data)}))
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self.parts.append(data)

    def close(self, zip64: bool) -> tuple[str, int, int]:
        index = "\n".join(f"{i} {x}" for i, x in enumerate(self.lines)).encode()
        zip64 = zip64 or self.size + len(index) >= 0xFFFF0000
        first = zip_local(DATA, self.size, self.crc, zip64)
        second = zip_local(INDEX, len(index), zlib.crc32(index), zip64)
        at = len(first) + self.size
        with self.fs.open_output_stream(self.path) as out:
            for x in (first, *self.parts, second, index, zip_tail([(DATA, self.size, self.crc, 0), (INDEX, len(index), zlib.crc32(index), at)], at + len(second) + len(index), zip64)):
                out.write(x)
        return self.uri, len(self.lines), self.size


def write_archives(pages: DataFrame, least: int = 1000, zip64: bool = False, name: str = "warc") -> DataFrame:
    """Write archives to the shared folder; returns their table: uri, records, bytes.

    Files of attempts that failed are in nobody's table.
    """
    spark = pages.sparkSession
    folder = new_path(spark, name)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = page.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    keeper = long.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("keeper > least").select("digest", "keeper")
    # ids only are shuffled by digest; then each page meets its verdict by page_id, so one common page is no hot key for payloads
    verdict = long.select("page_id", "digest").join(keeper, "digest").where("page_id < keeper").groupBy("page_id", "digest").agg(F.max("keeper").alias("keeper"))
    dealt = page.join(verdict, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for piece in T.slices(batches, "html"):
            for i, url, html, digest, keeper in zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True):
                archive = archive or _Archive(folder)
                archive.add(i, url, html.encode(), digest, keeper)
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close(zip64))
                    archive = None
        if archive:
            done.append(archive.close(zip64))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["uri", "records", "bytes"])

    return written(dealt.mapInArrow(run, "uri string, records long, bytes long"), f"{name}-table")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives in column ``uri``: RECORDS (a revisit has neither payload nor size of its own)."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("uri").to_pylist():
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as f:
                    members = zip_members(lambda at, n: f.read_at(n, at), f.size())
                    base, _ = members[DATA]
                    at, size = members[INDEX]
                    lines = f.read_at(size, at).decode().splitlines()
                run, total = [], 0
                for x in (json.loads(line.split(" ", 1)[1]) for line in lines):
                    if run and total + x["length"] > RANGE_BYTES:
                        rows.append((uri, base, run))
                        run, total = [], 0
                    run.append((x["offset"], x["length"]))
                    total += x["length"]
                if run:
                    rows.append((uri, base, run))
            for uri, base, run in rows:
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([base + run[0][0]], pa.int64()), pa.array([[o - run[0][0] for o, _ in run]], pa.list_(pa.int64())), pa.array([[n for _, n in run]], pa.list_(pa.int64()))], names=["uri", "at", "offsets", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for uri, at, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as f:
                    data = f.read_at(offsets[-1] + lengths[-1], at)
                rows = [parsed(zlib.decompress(data[o : o + n], 31)) for o, n in zip(offsets, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ranges = archives.select("uri").mapInArrow(locate, "uri string, at long, offsets array<long>, lengths array<long>")
    return ranges.repartition(F.col("uri"), F.col("at")).mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a revisit's size is that of the response it names."""
    digests = records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    digests = written(digests, "warc-records")  # the archives are read once
    response = digests.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    revisit = digests.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("size"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return digests.where("record_type = 'response'").select(cols).unionByName(revisit.select(cols))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000, zip64: bool = False) -> DataFrame:
    return resolved(read_archives(write_archives(pages, least, zip64)))
