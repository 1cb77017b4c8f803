"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id; a shard is a range of ids. Where shards begin follows from the data alone: ids are sorted, sizes of payloads are summed up in that order over the whole
table, and a shard begins with the first id whose records begin in another multiple of the shard size. Neither samples nor the layout of the table nor the number of tasks matter, so the
same table gives the same archives. A shard's records are gzip members of their own, in the order of page_id, url and payload, appended to a file until its compressed size reaches the roll size;
then the next file of the shard begins. Headers and digests are made anew from the payload, with a fixed date. A
file is written under a temporary name that holds the task attempt, and renamed to its final name when complete; a second attempt at the same task writes the same
bytes and replaces it. The manifest, a table written by Spark's own commit after all shards, lists the files that count with size, number of records and SHA-1; readers
open those alone. When it is written, what failed attempts have left is deleted.

Of records with equal payloads of at least `smallest` bytes, the one with the largest page_id is a response and the others are revisits that refer to it and
carry no payload.

Nulls and edge cases. A null html is an empty payload, a null url leaves out the target header, a null page_id the id headers (such a record is a response unless a
numbered page has the payload); such records have no place in the order of ids and are dealt out to shards of their own by the hash of url and payload. Rows that repeat the largest page_id of a payload are all responses. Equal payloads under `smallest` are all responses. An empty table gives an empty
manifest and no records. Other columns aren't read. Archives lie in the shared folder and are opened through pyarrow's file systems by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, drop, new_path, written

SMALLEST, ROLL, DATE = 1000, 64 << 20, "2000-01-01T00:00:00Z"
#: Least and most bytes of payloads and headers (HEAD for each record) of a shard; between them the table goes to SHARDS of them.
SHARD, SHARDS, HEAD = (8 << 20, 256 << 20), 4096, 600
#: Tasks that read archives side by side, at most.
READERS = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_END = b"\r\n\r\n"


def record_id(page_id: int | None, url: str | None, sha1: bytes, copy: int = 0) -> str:
    """Distinct for distinct page, address and payload, and for rows that agree in all three by their number `copy`."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{url!r}/{sha1.hex()}/{copy}')}>"


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0, refers_url: str | None = None) -> bytes:
    """One WARC record; refers_to and refers_url are the page_id and address of the response that a revisit repeats."""
    sha1 = hashlib.sha1(payload).digest()
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, sha1, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", _label(sha1)),
        ("WARC-Block-Digest", _label(hashlib.sha1(block).digest())),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", record_id(refers_to, refers_url, sha1) if refers_to is not None else None),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _head("WARC/1.1", fields) + block + _END


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a stream; a member at a time is in memory."""
    left = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            left = left or stream.read(1 << 20)
            if not left:
                if parts:
                    raise EOFError("a record ends too early")
                return
            parts.append(z.decompress(left))
            left = z.unused_data
        head, _, rest = b"".join(parts).partition(_END)
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        if not first.startswith("WARC/") or rest[n:] != _END:
            raise ValueError("not a WARC record")
        yield fields, rest[:n]


class _Shard:
    """Writes the files of one shard."""

    def __init__(self, fs, folder: str, shard: int, attempt: int, roll: int) -> None:
        self.fs, self.dir, self.shard, self.attempt, self.roll, self.out, self.seq = fs, folder, shard, attempt, roll, None, 0

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:04d}.warc.gz"
            self.temp = posixpath.join(self.dir, "_temporary", f"{self.name}.{self.attempt}")
            self.out, self.size, self.n, self.first, self.sha1 = self.fs.open_output_stream(self.temp, compression=None), 0, 0, page_id, hashlib.sha1()
        member = gzip_member(data)
        self.out.write(member)
        self.sha1.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, posixpath.join(self.dir, self.name))
        self.out, self.seq = None, self.seq + 1
        return self.shard, self.name, self.n, self.size, self.sha1.hexdigest(), self.first, self.last


MANIFEST = "shard int, file string, records long, bytes long, sha1 string, first_page_id long, last_page_id long"
_MANIFEST_KINDS = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _write(uri: str, roll: int):
    """Rows come sorted by shard and, within it, in the order of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, out, files = TaskContext.get().taskAttemptId(), None, []
        fs = folder = None
        last, copy = None, 0
        for b in batches:
            if fs is None:
                fs, folder = pafs.FileSystem.from_uri(uri)
                fs.create_dir(posixpath.join(folder, "_temporary"), recursive=True)
            for shard, page_id, url, html, refers_to, refers_url in zip(*b.columns):
                page_id, shard = page_id.as_py(), shard.as_py()
                if out is None or out.shard != shard:
                    if out and out.out:
                        files.append(out.close())
                    out, last = _Shard(fs, folder, shard, attempt, roll), None
                own = page_id, url.as_py(), html.as_py() or ""  # equal rows stand together
                copy = copy + 1 if own == last else 0
                last = own
                files += out.add(page_id, record(page_id, own[1], own[2].encode(), refers_to.as_py(), copy, refers_url.as_py()))
        if out and out.out:
            files.append(out.close())
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files), _MANIFEST_KINDS)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _longs(numbers: list[int]) -> Column:
    """An array literal that costs the plan one string, however long it is."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def shards(rows: DataFrame, shard: int | None = None) -> tuple[list[int], int]:
    """Where each shard of numbered rows but the first begins, by exact quantiles of the bytes in the order of page_id, and the number of shards of the other rows.
    A row of 16 bytes for each page is sorted; a number a shard reaches the driver."""
    sizes = rows.groupBy("page_id").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + HEAD).alias("n"))
    ordered = written(sizes.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("part", F.spark_partition_id()), "sizes")
    total = {r.part: (r.n, r.unnumbered) for r in ordered.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n"))).alias("unnumbered")).collect()}  # a row for each partition
    if not total:
        return [], 0
    before = [0, *accumulate(total.get(part, (0, 0))[0] for part in range(max(total)))]
    shard = shard or min(SHARD[1], max(SHARD[0], sum(n for n, _ in total.values()) // SHARDS))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce(own, F.lit(0)) + F.get(_longs(before), F.col("part"))
    firsts = ordered.select("page_id", F.floor(at / F.lit(shard)).alias("shard")).where("page_id IS NOT NULL").groupBy("shard").agg(F.min("page_id").alias("first")).collect()
    drop(ordered)
    unnumbered = sum(n or 0 for _, n in total.values())
    return sorted(r["first"] for r in firsts)[1:], -(-unnumbered // shard)


def place(starts: list[int], page_id: Column) -> Column:
    """How many of the sorted starts are at or below page_id: a binary search by falling steps."""
    if not starts:
        return F.lit(0)
    held = _longs(starts)
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= page_id, at + step).otherwise(at))


def duplicates(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """digest, refers_to and refers_url: the payloads of at least `smallest` bytes that several rows hold, their largest page_id and, of its rows, the last address."""
    big = pages.where(F.octet_length("html") >= smallest)
    last = F.max(F.struct("page_id", "url")).alias("r")
    return big.groupBy("digest").agg(F.count("*").alias("n"), last).where("n > 1").select("digest", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url"))


def write_warc(pages: DataFrame, uri: str, roll: int = ROLL, smallest: int = SMALLEST, shard: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) to the folder uri; returns the manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    starts, more = shards(rows, shard)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    again = written(duplicates(rows, smallest), "duplicates")
    refers = F.when(F.col("page_id") == F.col("refers_to"), F.lit(None)).otherwise(F.col("refers_to"))
    unnumbered = len(starts) + 1 + F.pmod(F.xxhash64("url", "html"), F.lit(max(1, more))).cast("int")
    where = F.when(F.col("page_id").isNull(), unnumbered).otherwise(place(starts, F.col("page_id")))
    rows = rows.join(again, "digest", "left").select(where.alias("shard"), "page_id", "url", "html", refers.alias("refers_to"), "refers_url")
    sorted_rows = rows.repartitionById(len(starts) + 1 + more, "shard").sortWithinPartitions("shard", "page_id", "url", "html")
    manifest = written(sorted_rows.mapInArrow(_write(uri, roll), MANIFEST), "manifest")
    drop(again)
    delete(pages.sparkSession, f"{uri}/_temporary")
    return manifest


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(uri: str, payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _READ.split(", ")])
        rows, size = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(posixpath.join(folder, name), compression=None) as f:
                    for fields, block in read_records(f):
                        http, _, payload = block.partition(_END)
                        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if _label(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"] or fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
                            raise ValueError(f"digest mismatch in {name}")
                        number = lambda k: int(fields[k]) if k in fields else None
                        rows.append((number("Page-ID"), fields.get("WARC-Target-URI"), n, digest.hex(), fields["WARC-Type"], number("Refers-To-Page-ID"), payload if payloads else None))
                        size += len(payload) * payloads + 200
                        if size > 8 << 20:
                            yield give(rows)
                            rows, size = [], 0
        if rows:
            yield give(rows)

    return run


def read_warc(manifest: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's files, digests checked; payload is null unless asked for, and empty for revisits."""
    files = manifest.select("file")
    return files.repartitionByRange(max(1, min(files.count(), READERS)), "file").mapInArrow(_read(uri, payloads), _READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_warc(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, octet_length(encode(h))::BIGINT AS n, count(*) OVER (PARTITION BY h) AS k, max(page_id) OVER (PARTITION BY h) AS top FROM p),
r AS (SELECT *, n >= 1000 AND k > 1 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM q)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to
FROM r
"""
