"""WARC archives: a deterministic sharded writer and a reader.

Records are ordered by their integer key, null last, then by their payload's digest. Boundaries come from a hash-drawn,
size-weighted sample, overfull ranges are subdivided by samples of their own, also inside one key, so the same rows give
the same files however they were partitioned. Each range is written as one or more files, rolled when the compressed size
would pass `roll_bytes`; every record is a gzip member of its own. Payloads are compressed before the only shuffle that
carries them, and a payload that occurs again is a revisit record without it.
Files are written by Spark's own file writer (any file system it knows, task commits included) below a temporary name,
then renamed to names that hold a digest of their records, so a run never replaces a file with another one. A manifest with
each file's length and SHA-256 then takes the place of the one before, and files that it doesn't list any more go: a
reader that follows the manifest sees one whole run or another.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_in, stored, tidy
from .sharding import ranges

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 32 << 20
#: A range's payloads, before compression, in files' worth; a task sorts and writes a range or a few.
RANGE_FILES = 16
#: Tasks that write, at most, and renames at one time.
TASKS, RENAMES = 50_000, 32
#: An empty gzip member: whatever comes before it, its last byte is 0.
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _clean(value: str | None) -> str:
    """A header value may hold no control characters."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, digest: str, n: int, payload: bytes | None, first: int | None, date: str = DATE, first_url: str | None = None) -> bytes:
    """A response record, or for payload None a revisit record that refers to the record with key `first` and its url."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _record_id(key, digest)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _clean(url))] * (url is not None) + [("X-Record-Key", str(key))] * (key is not None)
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Key", str(first))]
        headers += [("WARC-Refers-To-Target-URI", _clean(first_url))] * (first_url is not None)
    return _record(headers, block)


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, urls, payloads = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        members, hexes = [], []
        for key, url, x in zip(keys, urls, payloads, strict=True):
            data = (x.as_py() or "").encode()
            sha = hashlib.sha1(data)
            hexes.append(sha.hexdigest())
            members.append(_gzip(page_record(key, url, base64.b32encode(sha.digest()).decode(), len(data), data, None)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(urls, pa.string()), pa.array(hexes, pa.string()), pa.array([1] * len(keys), pa.int32()), pa.array([None] * len(keys), pa.int64()), pa.array([None] * len(keys), pa.int64()), pa.array(members, pa.binary())], names=["key", "url", "sha", "kind", "first", "n", "member"])


def _roller(prefix: str, roll_bytes: int, date: str):
    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of whole ranges in, a row for each file out. Before a page's row comes its role, if it is a revisit."""
        rid, seq, parts, size, role = None, 0, [], 0, None

        def file() -> pa.RecordBatch:
            name = f"{prefix}-{rid:06d}-{seq:05d}-{hashlib.sha256(b''.join(parts)).hexdigest()[:16]}.warc.gz"
            data = b"".join([_gzip(_info(name, date)), *parts, _EMPTY])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data[:-1]], pa.binary())], names=["file", "data"])

        for b in batches:
            cols = {n: b.column(n) for n in ("key", "url", "rid", "sha", "kind", "first", "n", "member")}
            for i in range(b.num_rows):
                key, sha, at = cols["key"][i].as_py(), cols["sha"][i].as_py(), cols["rid"][i].as_py()
                if cols["kind"][i].as_py() == 0:
                    role = (key, sha, cols["first"][i].as_py(), cols["n"][i].as_py(), cols["url"][i].as_py())
                    continue
                if role and role[:2] == (key, sha):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = _gzip(page_record(key, cols["url"][i].as_py(), digest, role[3], None, role[2], date, role[4]))
                else:
                    member = cols["member"][i].as_py()
                if parts and (at != rid or size + len(member) > roll_bytes):
                    yield file()
                    seq, parts, size = (seq + 1 if at == rid else 0), [], 0
                rid = at
                parts.append(member)
                size += len(member)
        if parts:
            yield file()

    return roll


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", prefix: str = "part", roll_bytes: int = ROLL_BYTES, min_revisit: int = 0, date: str = DATE) -> None:
    """Write a record for each row of pages to <out>/<prefix>-<range>-<n>-<digest>.warc.gz and <out>/manifest.json.

    Of rows with equal payloads of at least min_revisit bytes, those with the smallest key are responses, the others
    revisits (rows that repeat the smallest key too are all responses). Null payload: empty; null url: no target header;
    null key: no key header, and a revisit if the payload occurs under a key. Empty table: a manifest without files.
    Other columns are left out.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    sha = F.sha1(F.col("payload").cast("binary"))
    narrow = stored(rows.select("key", "url", sha.alias("sha"), F.octet_length("payload").cast("bigint").alias("n")), "warc-keys")
    total = narrow.agg(F.sum(F.col("n") + 512)).first()[0] or 0
    n_ranges = max(1, math.ceil(total / (RANGE_FILES * roll_bytes)), min(32, math.ceil(total / (1 << 20))))
    order = F.struct(F.col("key").isNull().cast("int").alias("none"), F.coalesce("key", F.lit(0)).alias("key"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint").alias("sha")).alias("o")
    cuts = ranges(narrow.select(order, (F.col("n") + 512).alias("w")), "o", "w", float(total), n_ranges)
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url")))
    firsts = narrow.where(F.col("n") >= min_revisit).groupBy("sha", "n").agg(least.alias("f"), F.count("*").alias("c")).where("c > 1").select("sha", "n", F.col("f.key").alias("first"), F.col("f.url").alias("first_url"))
    roles = narrow.select("key", "sha", "n").join(firsts, ["sha", "n"]).where("key > first OR (key IS NULL AND first IS NOT NULL)").distinct()
    rid = lambda df: df.withColumn("rid", rank_in([tuple(c) for c in cuts], order, "struct<none:int,key:bigint,sha:bigint>"))
    record = "key bigint, url string, sha string, kind int, first bigint, n bigint, member binary"
    members = rows.select("key", "url", "payload").mapInArrow(tidy(_compress), record)
    roles = roles.select("key", F.col("first_url").alias("url"), "sha", F.lit(0).alias("kind"), "first", "n", F.lit(None).cast("binary").alias("member"))
    ranged = rid(members.unionByName(roles)).repartition(min(len(cuts) + 1, TASKS), "rid").sortWithinPartitions("rid", F.col("key").asc_nulls_last(), "sha", "kind", "url")
    files = ranged.mapInArrow(tidy(_roller(prefix, roll_bytes, date)), "file string, data binary")
    tmp = f"{out}/_temporary-{uuid.uuid4().hex}"
    files.select("file", F.col("data").cast("string").alias("data")).write.option("lineSep", "\x00").partitionBy("file").text(f"{tmp}/files")
    _commit(spark, out, tmp)


def _commit(spark: SparkSession, out: str, tmp: str) -> None:
    """Move the files to their names, then the manifest, and drop the files that only the one before has."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = hadoop.Path
    fs = path(out).getFileSystem(conf)
    listed = []
    if any(s.getPath().getName().startswith("file=") for s in fs.listStatus(path(f"{tmp}/files"))):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{tmp}/files")
        listed = sorted(map(tuple, found.select(F.regexp_extract("path", "/file=([^/]+)/", 1), "length", F.sha2("content", 256), "path").collect()))  # a row for each file

    def move(file: tuple) -> None:
        name, at = path(f"{out}/{file[0]}"), path(file[3])
        if not fs.exists(name) and not fs.rename(at, name):  # a file of that name has the same records
            raise OSError(f"{file[3]} couldn't be renamed to {file[0]}")

    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(move, listed))
    manifest = path(f"{out}/manifest.json")
    before = _manifest(spark, out) if fs.exists(manifest) else []
    stream = fs.create(path(f"{tmp}/manifest.json"), True)
    stream.write("".join(json.dumps({"file": n, "length": size, "sha256": sha}) + "\n" for n, size, sha, _ in listed).encode())
    stream.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(manifest).toUri(), conf).rename(fs.makeQualified(path(f"{tmp}/manifest.json")), fs.makeQualified(manifest), overwrite)
    for name in set(before) - {x[0] for x in listed}:
        fs.delete(path(f"{out}/{name}"), False)
    fs.delete(path(tmp), True)


def _manifest(spark: SparkSession, out: str) -> list[str]:
    return [r[0] for r in spark.read.schema("file string").json(f"{out}/manifest.json").collect()]  # a row for each file


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a .warc.gz file, a gzip member at a time."""
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        if not z.eof:
            raise ValueError("truncated gzip member")
        data = memoryview(z.unused_data)
        if raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = _fields(head)
            n = int(fields["content-length"])
            if rest[n:] != b"\r\n\r\n":
                raise ValueError("record length is wrong")
            yield fields, rest[:n]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    for b in batches:
        for content in b.column(0):
            for f, block in parse(content.as_buffer()):
                if f["warc-type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                digest, n = f["warc-payload-digest"].removeprefix("sha1:"), int(_fields(head)["content-length"])
                response = f["warc-type"] == "response"
                if response and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of record {f['warc-record-id']} doesn't match its digest")
                number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                refers = None if response or f["x-refers-to-key"] == "None" else number("x-refers-to-key")
                out.append((number("x-record-key"), f.get("warc-target-uri"), n, digest, f["warc-type"], refers, payload if response else None))
                held += len(payload)
                if held > 4 << 20 or len(out) >= 5000:
                    yield batch()
                    out, held = [], 0
    if out:
        yield batch()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files in the manifest: key, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits). A record whose length or digest is wrong raises."""
    listed = _manifest(spark, out)
    schema = "key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    if not listed:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load([f"{out}/{x}" for x in listed]).select("content").mapInArrow(tidy(_records), schema)
