"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extracting members.

A package holds stored members: under `archive/` files of WARC records (one gzip member a record, or plain), and under `indexes/` CDX or CDXJ
files that give each record's file, offset and length. The reader finds the end-of-directory record from the file's tail, follows the ZIP64
locator where there is one, parses the central directory, and then reads index and records by range, a member's local header when it is first
read. Index lines are read by their own words: of CDXJ the fields filename, offset and length; of CDX those that its header line names, or the
last three. A package without an index is read through, record after record, in bounded pieces; compressed members are refused when they are read.

The writer makes one `archive/data.warc.gz` and an `indexes/index.cdx` (page id, type, length, offset, file name).
Payloads equal to another's are written as revisit records: the smallest page id of equal payloads is the response, the others refer to
it; a payload below `min_bytes` is always a response. A revisit keeps the HTTP head with the full payload's length, and its digest.

Records of others: ids are texts; page_id and refers_to are numbers where an id is one of the writer's, else null. Types other than response and
revisit are skipped, or given with `every`; a payload without an HTTP head is the record's whole block; missing header fields are null.

Defined results: a null payload is an empty one; a row with a null id is a response unless an equal payload has an id, and reads
back with a null id; rows that repeat an id with equal payloads are responses together; an empty table makes no package; only the named
columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarn.llm.common import filesystem, materialize, new_path, short_batches

#: Member names, and signatures and sizes of the ZIP format's records.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVES, INDEXES, HEADER = "archive/", "indexes/", " CDX p m S V g"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE, COMMENT = 22, 56, 20, 46, 30, 65535
SMALL, LARGE = 0xFFFF, 0xFFFFFFFF
#: Bytes read at once where a member is read through.
PIECE = 1 << 20


def _head(pairs) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record, without compression."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    body = http + (payload if refers_to is None else b"")
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_name(page_id)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
             ("WARC-Target-URI", "".join((url or "").split()) or _name(page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if refers_to is not None:
        pairs += [("WARC-Refers-To", f"<{_name(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + _head([*pairs, ("Content-Length", len(body))]) + b"\r\n" + body + b"\r\n\r\n"


def _split(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a head, by lower-case name, and what follows it. A line that begins with white space continues the one before."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out.setdefault(last, value.strip())
    return out, rest


def _page(name: str | None) -> int | None:
    """The number of one of the writer's ids."""
    number = (name or "").removeprefix("urn:page:")
    return int(number) if number != name and number.lstrip("-").isdecimal() else None


def parse_record(raw: bytes) -> dict:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_to_id, refers_to, url, payload (None for a revisit) of one record."""
    warc, rest = _split(raw)
    kind = warc.get("warc-type", "")
    size = warc.get("content-length", "")
    block = rest[: int(size)] if size.isdecimal() else rest.removesuffix(b"\r\n\r\n")
    is_http = "application/http" in warc.get("content-type", "").replace(" ", "") or (kind in ("response", "revisit") and block[:5] == b"HTTP/")
    http, payload = _split(block) if is_http else ({}, block)
    own, other = ((warc[k].strip("<> ") if k in warc else None) for k in ("warc-record-id", "warc-refers-to"))
    digest = warc.get("warc-payload-digest")
    out = {"record_id": own, "page_id": _page(own), "record_type": kind, "refers_to_id": other, "refers_to": _page(other), "url": warc.get("warc-target-uri")}
    if kind == "revisit":
        length = http.get("content-length", "")
        return out | {"payload_bytes": int(length) if length.isdecimal() else None, "payload_digest": digest and digest.split(":", 1)[-1], "payload": None}
    return out | {"payload_bytes": len(payload), "payload_digest": sha1_base32(payload), "payload": payload}


class Package:
    """A ZIP file read by ranges; members: name -> [method, offset of its local header, stored size, offset of its data once known]."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        entries, at, length = self._directory()
        raw, at = self.read(at, length), 0
        self.members: dict[str, list] = {}
        for _ in range(entries):
            at = self._entry(raw, at)

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError("the package is cut short")
        return bytes(out)

    def _directory(self) -> tuple[int, int, int]:
        """Entries, offset and length of the central directory."""
        tail_at = max(0, self.size - END_SIZE - COMMENT - LOCATOR64_SIZE)
        tail = self.read(tail_at, self.size - tail_at)
        at = len(tail)
        while (at := tail.rfind(END, 0, at)) >= 0:
            if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, offset = struct.unpack_from("<HLL", tail, at + 10)
        if at >= LOCATOR64_SIZE and tail[at - LOCATOR64_SIZE : at - LOCATOR64_SIZE + 4] == LOCATOR64 and (entries == SMALL or LARGE in (length, offset)):
            end64 = self.read(struct.unpack_from("<Q", tail, at - LOCATOR64_SIZE + 8)[0], END64_SIZE)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
        return entries, offset, length

    def _entry(self, raw: bytes, start: int) -> int:
        """Takes in the entry at `start` of the central directory; where the next one begins."""
        if raw[start : start + 4] != CENTRAL:
            raise ValueError("no central directory entry")
        flags, method = struct.unpack_from("<HH", raw, start + 8)
        packed, full = struct.unpack_from("<LL", raw, start + 20)
        n, extra, comment = struct.unpack_from("<HHH", raw, start + 28)
        offset = struct.unpack_from("<L", raw, start + 42)[0]
        at = start + CENTRAL_SIZE + n
        name, end = raw[at - n : at].decode("utf-8" if flags & 0x800 else "cp437"), at + extra
        while at + 4 <= end:
            kind, length = struct.unpack_from("<HH", raw, at)
            if kind == 1:  # ZIP64: the fields that don't fit, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, at + 4))
                full, packed, offset = (next(wide) if x == LARGE else x for x in (full, packed, offset))
            at += 4 + length
        self.members[name] = [method, offset, packed, None]
        return end + comment

    def stored(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        if name not in self.members:
            raise ValueError(f"no member {name}")
        method, header, size, start = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        if start is None:
            local = self.read(header, LOCAL_SIZE)
            if local[:4] != LOCAL:
                raise ValueError("no local header")
            start = self.members[name][3] = header + LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26))
        length = size - at if length is None else length
        if at < 0 or at + length > size:
            raise ValueError(f"a range beyond {name}")
        return self.read(start + at, length)

    def pieces(self, name: str):
        size = self.members[name][2]
        for at in range(0, size, PIECE):
            yield self.stored(name, at, min(PIECE, size - at))

    def archives(self) -> list[str]:
        return [n for n in self.members if n.startswith(ARCHIVES) and n.endswith((".warc", ".warc.gz"))]

    def _lines(self, name: str):
        rest = b""
        inflate = zlib.decompressobj(31) if name.endswith(".gz") else None
        for piece in self.pieces(name):
            if inflate:
                out = b""
                while piece:  # one gzip member after another
                    out += inflate.decompress(piece)
                    piece = inflate.unused_data
                    inflate = zlib.decompressobj(31) if inflate.eof else inflate
                piece = out
            *whole, rest = (rest + piece).split(b"\n")
            yield from (x.decode("utf-8", "replace").rstrip("\r") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")

    def index(self):
        """Member, offset and length of each record that the package's indexes name, each once."""
        by_file = {n.rsplit("/", 1)[-1]: n for n in self.archives()}
        seen = set()
        for name in [n for n in self.members if n.startswith(INDEXES) and n.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))]:
            places = (-3, -2, -1)  # length, offset, file
            for line in self._lines(name):
                if line.lstrip().startswith("CDX "):
                    fields = line.split()[1:]
                    places = tuple(fields.index(x) for x in "SVg")
                    continue
                if not line.strip() or line.startswith("!"):
                    continue
                if line.rstrip().endswith("}"):
                    given = json.loads(line[line.index("{") :])
                    length, offset, file = given["length"], given["offset"], given["filename"]
                else:
                    words = line.split()
                    length, offset, file = (words[i] for i in places)
                one = by_file.get(str(file).rsplit("/", 1)[-1]), int(offset), int(length)
                if one[0] is None:
                    raise ValueError(f"the index names {file}, which is no member")
                if one not in seen:
                    seen.add(one)
                    yield one

    def _through(self, name: str):
        """The records of a member, one after another, without an index."""
        if name.endswith(".gz"):
            inflate, held = zlib.decompressobj(31), []
            for piece in self.pieces(name):
                while piece:
                    held.append(inflate.decompress(piece))
                    piece = inflate.unused_data
                    if inflate.eof:
                        yield b"".join(held)
                        inflate, held = zlib.decompressobj(31), []
            return
        held = b""
        for piece in self.pieces(name):
            held += piece
            while (head := held.find(b"\r\n\r\n")) >= 0:
                size = int(_split(held[: head + 4])[0].get("content-length", 0))
                if len(held) < head + 4 + size + 4:
                    break
                yield held[: head + 4 + size]
                held = held[head + 4 + size + 4 :]

    def raw_records(self):
        """Bytes of each record: by its range where there is an index."""
        indexed = any(n.startswith(INDEXES) for n in self.members)
        for name, at, length in self.index() if indexed else ():
            raw = self.stored(name, at, length)
            yield gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        for name in () if indexed else self.archives():
            yield from self._through(name)

    def records(self, every: bool = False):
        """Parsed records: responses and revisits, or of every type."""
        for raw in self.raw_records():
            one = parse_record(raw)
            if every or one["record_type"] in ("response", "revisit"):
                yield one


class PackageWriter:
    """Streams records into a package; the index goes in at the end."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, [HEADER + "\n"]

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        raw = gzip.compress(record(page_id, url, payload, refers_to), 4, mtime=0)
        self.data.write(raw)
        self.lines.append(f"{_name(page_id)} {'response' if refers_to is None else 'revisit'} {len(raw)} {self.at} {DATA.rsplit('/', 1)[-1]}\n")
        self.at += len(raw)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.close()


class _Sink(io.RawIOBase):
    """A stream that only writes and tells, as remote stores have it."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self):
        return True

    def tell(self):
        return self.at

    def write(self, data):
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self):
        pass


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages with `refers_to`: the smallest id of equal payloads where that is another's. Equal payloads are only counted by digest
    before the join, which Spark can split where one payload has many rows."""
    keyed = pages.withColumn("__digest", F.sha2(F.coalesce(F.col(payload_col), F.lit("")), 256))
    first = keyed.groupBy("__digest").agg(F.min(id_col).alias("__first"))
    large = F.coalesce(F.octet_length(payload_col), F.lit(0)) >= min_bytes
    return keyed.join(first, "__digest", "left").withColumn("refers_to", F.when(large & ~F.col("__first").eqNullSafe(F.col(id_col)), F.col("__first"))).drop("__digest", "__first")


def write_packages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a package a partition to path; returns the table (name, n_records, n_bytes) of those that count: a repeated task writes under a new name."""
    spark = pages.sparkSession
    short_batches(spark, 200)
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)

    def write(batches):
        name = None
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name is None:
                    name = f"pages-{uuid.uuid4().hex}.zip"
                    fs, root = filesystem(path)
                    stream = fs.open_output_stream(f"{root}/{name}")
                    sink = _Sink(stream)
                    out = PackageWriter(sink)
                out.add(page, url, (html or "").encode("utf-8", "surrogatepass"), refers)
        if name:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(out.lines) - 1], "n_bytes": [sink.at]})

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    marked = mark_revisits(rows, min_bytes=min_bytes).select("page_id", "url", "html", "refers_to")
    return materialize(marked.mapInArrow(write, "name string, n_records bigint, n_bytes bigint"), "packages")


def read_packages(packages: DataFrame, path: str, with_payload: bool = False, every: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the packages (a table with their names and n_bytes);
    with_payload: also url, payload (null for a revisit), record_id and refers_to_id (texts). every: records of other types too."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary, record_id string, refers_to_id string" * with_payload
    fields = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = filesystem(f"{path}/{name}")
                with fs.open_input_file(root) as file:
                    rows, held = [], 0
                    for one in Package(file, size).records(every):
                        rows.append(one if with_payload else one | {"payload": None})
                        held += len(one["payload"] or b"") if with_payload else 0
                        if len(rows) == 200 or held > BATCH_BYTES:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, fields)

    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("name", "n_bytes").repartition(n).mapInArrow(read, schema)


def packages_in(spark, path: str) -> DataFrame:
    """The table (name, n_bytes) of the packages in a folder, for archives of others."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,wacz}").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"))


#: Arrow types of what a reader gives; payload bytes that it gathers.
TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string()}
BATCH_BYTES = 16_000_000


def _batch(rows: list[dict], fields: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], TYPES[f]) for f in fields], names=fields)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to packages in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, path, min_bytes=min_bytes), path)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The digest of (page_id, html) rows without any archive; for tests."""
    first: dict[bytes, int] = {}
    for page, html in sorted(rows):
        first.setdefault((html or "").encode(), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        of = first[raw]
        out.append((page, len(raw), sha1_base32(raw), "response" if of == page else "revisit", None if of == page else of))
    return out


#: The digest over DuckDB, without archives; base 32 from the hexadecimal digest, four characters of five digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
x AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)) AS v FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[CAST(i // 4 AS BIGINT) + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
