"""WARC records in ZIP packages: written by Spark tasks, found by the central directory, read by ranges (operator 10)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procuris.llm.common import at_exit, saved, shared_dir, table

#: Payloads from this size on are written once; later copies revisit them.
LEAST_REVISIT = 1000
#: Bytes of WARC data that an archive member and a package hold, about.
MEMBER_BYTES, PACKAGE_BYTES = 16 << 20, 64 << 20
#: Records whose ranges lie this close are read at once, up to so many bytes.
READ_BYTES = 4 << 20
#: Packages whose directories, and ranges whose records, one task reads, about.
PACKAGES, RANGES = 16, 4
#: Records are gzip members of this level; the package stores them as they are.
LEVEL = 1
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: Fixed values of the formats: no more fits in 16 and 32 bits, the ZIP64 extra field, a ZIP date (1980-01-01).
FULL16, FULL32, ZIP64, DATE = 0xFFFF, 0xFFFFFFFF, 1, 33
WARC_DATE = "2000-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- records

def record(kind: str, uri: str, name: str, payload: bytes, length: int, sha1: str, refers: str | None) -> bytes:
    """A WARC/1.1 response or revisit record over an HTTP response; a revisit holds the HTTP header alone.

    The HTTP header's Content-Length and the payload digest tell of the full payload in either kind.
    """
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_of(data: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a header block (names in small letters) and where its body begins."""
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def read_record(data: bytes) -> dict:
    """What a record says: kind, name, refers, the payload's bytes and digest. A response's payload is checked."""
    fields, at = header_of(data)
    block = data[at:at + int(fields["content-length"])]
    http, body = header_of(block)
    size, sha1 = int(http["content-length"]), base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response":
        payload = block[body:]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError(f"{fields['warc-record-id']}: the payload is not what its record says")
    return {"kind": fields["warc-type"], "name": fields["warc-record-id"].strip("<>"), "bytes": size, "sha1": sha1,
            "refers": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}


def page_name(page_id: int) -> str:
    return f"urn:page:{page_id}"


# --- packages

class Package:
    """A ZIP package of stored members, written in one pass; ZIP64 fields where sizes, offsets or numbers need them."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.entries, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, size, label, begin = zlib.crc32(data), len(data), name.encode(), self.at
        wide = self.force64 or size >= FULL32
        extra = struct.pack("<HHQQ", ZIP64, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, DATE, crc, short, short, len(label), len(extra)) + label + extra)
        self._write(data)
        self.entries.append((label, crc, size, begin))

    def close(self) -> None:
        begin = self.at
        for label, crc, size, at in self.entries:
            wide = self.force64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", ZIP64, 24, size, size, at) if wide else b""
            short, where = (FULL32, FULL32) if wide else (size, at)
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, DATE, crc, short, short, len(label), len(extra), 0, 0, 0, 0, where) + label + extra)
        size, n = self.at - begin, len(self.entries)
        if self.force64 or n >= FULL16 or begin >= FULL32 or size >= FULL32:
            end = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(LOCATOR + struct.pack("<IQI", 0, end, 1))
            n, size, begin = FULL16, FULL32, FULL32
        self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, begin, 0))


def members(source, size: int) -> list[tuple[str, int, int]]:
    """(name, offset of the data, size) of a package's stored members, by its central directory alone and local headers.

    source: a file that reads ranges, read_at(length, offset). ZIP64 records and fields are followed. A compressed
    or encrypted member raises, as nothing is extracted here.
    """
    tail_at = max(0, size - (1 << 16) - 22)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
    if end >= 20 and tail[end - 20:end - 16] == LOCATOR and (n == FULL16 or length == FULL32 or begin == FULL32):
        at = struct.unpack_from("<IQI", tail, end - 16)[1]
        wide = source.read_at(56, at)
        if wide[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        n, _, length, begin = struct.unpack_from("<QQQQ", wide, 24)[:4]
    listing, at, found = source.read_at(length, begin), 0, []
    for _ in range(n):
        if listing[at:at + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        packed, plain, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", listing, at + 20)
        where = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46:at + 46 + name_len].decode()
        extra, k = listing[at + 46 + name_len:at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, k)
            if tag == ZIP64:
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                plain = values.pop(0) if plain == FULL32 else plain
                packed = values.pop(0) if packed == FULL32 else packed
                where = values.pop(0) if where == FULL32 else where
            k += 4 + width
        if method or flags & 1 or packed != plain:
            raise ValueError(f"{name}: only stored members can be read by ranges")
        local = source.read_at(30, where)
        found.append((name, where + 30 + sum(struct.unpack_from("<HH", local, 26)), plain))
        at += 46 + name_len + extra_len + note_len
    return found


# --- Spark jobs

def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, bytes, refers_to): of equal payloads of LEAST_REVISIT bytes or more the largest page_id stays, others refer to it.

    Digests are counted before they meet their pages again, so that many copies of a page cost rows of two columns only.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    copies = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    copies = copies.filter("n > 1").drop("n")
    rows = rows.join(copies, ["sha1", "bytes"], "left")
    return rows.select("page_id", "sha1", "bytes", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, where: str, package_bytes: int = PACKAGE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(package, records): ZIP packages of WARC members and their indexes, a record for every page, in the folder `where`.

    Every package is written under a name of its own and the names are returned, so that a task that runs twice does
    no harm: only packages of the attempt that Spark counts are read. A member NAME.warc.gz (each record a gzip
    member of its own) has a member NAME.cdx with the offset and length of each record.
    """
    plan = decisions(pages).distinct()
    html = F.coalesce("html", F.lit(""))
    kept = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    plan = plan.withColumnsRenamed({"page_id": "_page", "sha1": "_sha1"})
    joined = kept.join(plan, kept["page_id"].eqNullSafe(plan["_page"]) & (kept["sha1"] == plan["_sha1"]))
    joined = joined.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))

    def write(batches):
        fs, folder = filesystem(where)
        fs.create_dir(folder, recursive=True)
        done, state = [], {}

        def flush_member():
            if state.get("index"):
                name = f"data-{len(state['zip'].entries) // 2:05d}"
                state["zip"].add(f"archive/{name}.warc.gz", b"".join(state["parts"]))
                state["zip"].add(f"indexes/{name}.cdx", b"".join(struct.pack("<QQ", *x) for x in state["index"]))
                state["records"] += len(state["index"])
            state.update(parts=[], index=[], size=0)

        def close():
            flush_member()
            state["zip"].close()
            state["out"].close()
            done.append((state["path"], state["records"]))
            state.clear()

        for batch in batches:
            for page, url, html, sha1, size, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "bytes", "refers_to"))):
                if not state:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(path)
                    state.update(path=path, out=out, zip=Package(out), records=0, parts=[], index=[], size=0)
                refers = refers.as_py()
                data = record("response" if refers is None else "revisit", url.as_py(), page_name(page.as_py()), html.as_buffer().to_pybytes(),
                              size.as_py(), sha1.as_py(), None if refers is None else page_name(refers))
                data = gzip.compress(data, LEVEL, mtime=0)
                state["index"].append((state["size"], len(data)))
                state["parts"].append(data)
                state["size"] += len(data)
                if state["size"] >= member_bytes:
                    flush_member()
                if state["zip"].at >= package_bytes:
                    close()
        if state:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["package", "records"])

    cols = joined.select("page_id", "url", "html", "sha1", "bytes", "refers_to")
    return saved(cols.mapInArrow(write, "package string, records long"))


def index_packages(packages: DataFrame, where: str) -> DataFrame:
    """(package, at, length, first, number): ranges of neighbouring records, by the indexes in the packages themselves."""

    def read(batches):
        fs, _ = filesystem(where)
        for batch in batches:
            rows = []
            for package in batch.column("package").to_pylist():
                with fs.open_input_file(package) as source:
                    found = {name: (at, size) for name, at, size in members(source, source.size())}
                    for name, (at, size) in found.items():
                        if not name.startswith("indexes/"):
                            continue
                        base = found[f"archive/{name[8:-4]}.warc.gz"][0]
                        entries = list(struct.iter_unpack("<QQ", source.read_at(size, at)))
                        lengths, begin = [], 0
                        for n, (offset, length) in enumerate(entries):
                            lengths.append(length)
                            if offset + length - begin >= READ_BYTES or n + 1 == len(entries):
                                rows.append((package, base + begin, lengths))
                                lengths, begin = [], offset + length
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["package", "at", "lengths"])

    dealt = packages.select("package").repartition(max(1, -(-packages.count() // PACKAGES)), "package")
    return dealt.mapInArrow(read, "package string, at long, lengths array<long>")


def read_packages(ranges: DataFrame, where: str) -> DataFrame:
    """(name, kind, bytes, sha1, refers) of every record, each range read alone; ranges should be saved, as they are counted first."""

    def read(batches):
        fs, _ = filesystem(where)
        for batch in batches:
            for package, at, lengths in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "lengths"))):
                with fs.open_input_file(package) as source:
                    data = source.read_at(sum(lengths), at)
                out, begin = [], 0
                for length in lengths:
                    out.append(read_record(gzip.decompress(data[begin:begin + length])))
                    begin += length
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in (
                    ("name", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("refers", pa.string()))],
                    names=["name", "kind", "bytes", "sha1", "refers"])

    dealt = ranges.repartition(max(1, -(-ranges.count() // RANGES)), "package", "at")  # by a number, or AQE makes one task of the few bytes that name ranges
    return dealt.mapInArrow(read, "name string, kind string, bytes long, sha1 string, refers string")


def round_trip(spark: SparkSession, pages: DataFrame, where: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records written from pages and read back.

    A null html is an empty payload, a null url an empty one. A page that occurs twice has two records, and one
    without a page_id has a record too: nothing refers to it, it may refer to others. An empty table gives no rows.
    Other columns are not read.
    """
    if where is None:
        where = f"{shared_dir(spark)}/procuris/warc-{uuid.uuid4().hex}"
        at_exit(spark, where)
    rows = read_packages(saved(index_packages(write_packages(pages, where), where)), where)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return rows.select(page("name").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
                       F.col("kind").alias("record_type"), F.when(F.col("refers").isNotNull(), page("refers")).alias("refers_to"))


def op10(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM m
"""
