"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds archive/data.warc.gz (one gzip member per record) and indexes/index.cdxj, both stored. The reader parses
the end records (ZIP64 as well), the central directory and a member's local header, so it knows
where a stored member lies; index lines give the offsets of records; runs of neighbouring records
are read as byte ranges and parsed.

Scale: payloads are never shuffled. Digests alone are grouped; of the rows whose payload stands earlier, the places and the
first page's id are written, and the writers find them as they scan the pages. Writers
stream and start a new package at PACKAGE bytes. The reader deals ranges of about RANGE bytes, not packages, to
tasks of about TASK bytes. Packages are in the shared folder under a name of their own per attempt; only those of finished tasks are in the manifest,
so a lost executor leaves nothing that is read.

Nulls and repeats: null html is an empty payload, a null url an empty target, a null page_id is carried
(never the first of its group). Rows that repeat the smallest page_id of a payload are all
responses. An empty table gives no records. A very long page is one record, held whole by its writer and its reader. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._shared import Found, Places, drop_shared, located, materialize, only, shared_dir, small_batches

LEAST = 100
PACKAGE, RANGE, TASK = 256 << 20, 1 << 20, 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:page:"

_EOCD, _EOCD64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# --- the ZIP reader


def _read(f, at: int, size: int) -> bytes:
    if at < 0 or at + size > 1 << 62:
        raise ValueError(f"no place in a file: {size} bytes at {at}")
    f.seek(at)
    out = f.read(size)
    if len(out) != size:
        raise ValueError(f"truncated: {size} bytes wanted at {at}, {len(out)} there")
    return out


def directory(f, size: int) -> dict[str, dict]:
    """Members of a ZIP file by name: method, compressed and plain size, place of the local header. ValueError if it is damaged."""
    try:
        return _directory(f, size)
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"damaged ZIP directory: {e}") from None


def _directory(f, size: int) -> dict[str, dict]:
    tail_at = max(0, size - 22 - 65535)
    tail = _read(f, tail_at, size - tail_at)
    k = tail.rfind(_EOCD)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] > len(tail)):
        k = tail.rfind(_EOCD, 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        where = tail_at + k - 20
        locator = _read(f, where, 20) if where >= 0 else b""
        if locator[:4] != _LOCATOR:
            raise ValueError("ZIP64 locator is missing")
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record = _read(f, end64, 56)
        if record[:4] != _EOCD64:
            raise ValueError("ZIP64 end of central directory is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    body, at, out = _read(f, start, length), 0, {}
    for _ in range(count):
        if body[at : at + 4] != _ENTRY:
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack_from("<HH", body, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", body, at + 20)
        (local,) = struct.unpack_from("<I", body, at + 42)
        name = body[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = body[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            x += 4 + n
        out[name] = {"method": method, "packed": packed, "plain": plain, "local": local}
        at += 46 + n_name + n_extra + n_note
    return out


def stored_start(f, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"] != 0 or member["packed"] != member["plain"]:
        raise ValueError("the member is compressed; only stored members can be read by range")
    head = _read(f, member["local"], 30)
    if head[:4] != _LOCAL:
        raise ValueError("bad local header")
    return member["local"] + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- WARC records


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's block does not end where its length says")
    return headers, rest[:size]


def members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members that follow each other."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        if not one.eof:
            raise ValueError("a gzip member is cut off")
        data = one.unused_data


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _page_record(page: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{URN}{'' if page is None else page}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if first is None:
        return record(headers, _HTTP + payload)
    more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{URN}{first}>", "WARC-Truncated": "length", "X-Payload-Length": str(len(payload))}
    return record(headers | more, _HTTP)


def _written(folder: str):
    def run(triples: Iterator[Found]) -> Iterator[pa.RecordBatch]:
        package, done, index, at, n = None, [], [], 0, 0

        def close() -> None:
            nonlocal package
            zf, member, f, path = package
            member.close()
            with zf.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
                out.write("".join(index).encode())
            zf.close()
            f.close()
            done.append((path, n, at))
            package = None

        for batch, found, entries in triples:
            firsts = dict(zip(found.tolist(), entries.column("first").to_pylist(), strict=True)) if entries else {}
            for k, (page, url, html) in enumerate(zip(*[batch.column(c) for c in ("page_id", "url", "html")], strict=True)):
                if package is None:
                    files, base = _at(folder)
                    files.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    f = files.open_output_stream(path)
                    zf = zipfile.ZipFile(f, "w", zipfile.ZIP_STORED)
                    package, index, at, n = (zf, zf.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), f, f"{folder}/{path.rsplit('/', 1)[1]}"), [], 0, 0
                payload = (html.as_py() or "").encode()
                data = _gz(_page_record(page.as_py(), url.as_py(), payload, firsts.get(k), hashlib.sha256(payload).hexdigest()))
                package[1].write(data)
                index.append(json.dumps({"offset": at, "length": len(data)}) + "\n")
                at, n = at + len(data), n + 1
                if at >= PACKAGE:
                    close()
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["package", "n_records", "n_bytes"])

    return run


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages (page_id, url, html) to packages below folder; their manifest: package, n_records, n_bytes."""
    rows, file, row = located(only(pages, "page_id", "url", "html"))
    rows = small_batches(rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.col(file).alias("file"), F.col(row).alias("row")))
    digests = materialize(rows.where(F.octet_length("html") >= LEAST).select(F.unhex(F.sha2("html", 256)).alias("digest"), "page_id", "file", "row"))
    firsts = materialize(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    later = Places(digests.join(firsts, "digest").where("page_id is null or page_id <> first").select("file", "row", "first"))
    out = materialize(later.find(rows, "file", "row", _written(folder), "package string, n_records long, n_bytes long"))
    later.drop()
    drop_shared(digests, firsts)
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packages the byte ranges of runs of records."""
    for batch in batches:
        for package in batch.column("package").to_pylist():
            files, path = _at(package)
            out = []
            with files.open_input_file(path) as f:
                found = directory(f, f.size())
                start, index = stored_start(f, found[DATA]), found[INDEX]
                at, end, rest = stored_start(f, index), index["plain"], b""
                end += at
                low = high = 0
                while at < end or rest:
                    piece = _read(f, at, min(RANGE, end - at)) if at < end else b""
                    at += len(piece)
                    lines = (rest + piece).split(b"\n")
                    rest = lines.pop() if at < end else b""
                    for line in lines:
                        if line:
                            x = json.loads(line)
                            if high > low and x["offset"] + x["length"] - low > RANGE:
                                out.append((package, start + low, high - low))
                                low = x["offset"]
                            high = x["offset"] + x["length"]
                if high > low:
                    out.append((package, start + low, high - low))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["package", "start", "length"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    for batch in batches:
        for package, start, length in zip(*[batch.column(c).to_pylist() for c in ("package", "start", "length")], strict=True):
            files, path = _at(package)
            with files.open_input_file(path) as f:
                data = _read(f, start, length)
            out = []
            for one in members(data):
                headers, block = parse_record(one)
                payload, said = None, headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(headers.get("x-payload-length", 0))
                if headers["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"{headers['warc-record-id']}: the payload's digest is {digest}, its header says {said}")
                out.append((headers["warc-type"], headers["warc-record-id"], headers["warc-target-uri"], headers.get("warc-refers-to"), said, size, payload))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records of the packages: record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    # A number by the packages' bytes: rows of ranges are tiny, and merged by their own size few tasks would read all the bytes.
    size = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    dealt = manifest.select("package").repartition(parts, "package").mapInArrow(_ranges, "package string, start long, length long").repartition(parts, "package", "start")
    return dealt.mapInArrow(_records, "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def _page(column: str):
    return F.nullif(F.regexp_extract(column, rf"^<{URN}(-?\d*)>$", 1), F.lit("")).cast("long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to packages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_packages(only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"), shared_dir(spark))
    return read_packages(manifest).select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
h AS (SELECT *, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
