"""A deterministic, sharded writer of WARC archives, and a reader for them.

Records are range-sorted by id. A shard's records are written one gzip member each, and the file
is rolled when its compressed size passes a bound. Every byte is a function of the rows: shard
bounds are quantiles of a sample chosen by hash, headers and digests are made anew, dates and
record ids are derived. A shard is a range of (id, payload digest), and one partition. A file is written under a
temporary name of the attempt and renamed when it is whole, to a name that tells its bytes; a file with its final name is
never touched again. The manifest, written last by Spark's own committer, says which files count. A task
that is lost leaves files that no reader looks at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bizmetrics.llm.common import ship, uri
from bizmetrics.session import fresh_dir, store_once

#: Payloads below this size are always stored in full.
LEAST_REVISITED = 100
#: Compressed size at which a file is closed.
ROLL_BYTES = 64 << 20
#: Rows a shard aims for, and keys sampled to place the bounds: for each shard, and in all.
SHARD_ROWS, SAMPLED, MOST_SAMPLED = 25_000, 64, 200_000
LEAST_SHARDS = 16
DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # a fixed value: URLs, RFC 4122

MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, first): ``first`` is the smallest id with an equal payload of at least
    ``LEAST_REVISITED`` bytes. Ids are folded per digest before the shuffle."""
    digests = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    first = digests.where(F.col("size") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"))
    return digests.join(first, "digest", "left").select("page_id", "digest", "size", "first")


def shard_bounds(keys: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(one row with ``bounds``, the sorted keys that begin a new shard; the number of shards). Rows (page_id, digest) are
    sampled by their hash, about ``SAMPLED`` to a shard and ``MOST_SAMPLED`` in all; the same table always gives the same bounds."""
    n = keys.count()
    shards = max(LEAST_SHARDS, -(-n // shard_rows))
    every = max(1, n // min(shards * SAMPLED, MOST_SAMPLED))
    key = F.struct("page_id", "digest")
    sample = keys.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0).select(key.alias("key")).distinct()
    # One value of bounded size, made in one place.
    ordered = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    chosen = F.transform(F.sequence(F.lit(1), F.lit(shards - 1)), lambda i: F.get("keys", F.floor(F.size("keys") * i / shards).cast("int")))
    return ordered.select(F.array_compact(F.array_distinct(chosen)).alias("bounds")), shards


def _shard(bounds: Column, shards: int) -> Column:
    """How many bounds aren't above the row's key, by halving steps; null ids come first."""
    steps = F.array(*[F.lit(1 << b) for b in range(shards.bit_length(), -1, -1)])
    key = F.struct("page_id", "digest")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def _header(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n").encode("utf-8", "surrogatepass")


def _quoted(url: str | None) -> str | None:
    """A header line can't hold a line break; such letters and the escape itself are percent-encoded."""
    return url and "".join(f"%{ord(c):02X}" if ord(c) < 0x21 or c == "%" else c for c in url)


def _unquoted(url: str) -> str:
    out, at = [], 0
    while (mark := url.find("%", at)) >= 0:
        out += [url[at:mark], chr(int(url[mark + 1:mark + 3], 16))]
        at = mark + 3
    return "".join([*out, url[at:]])


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, nth: int) -> bytes:
    revisit = first is not None and page_id is not None and first != page_id
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if revisit else http + payload
    name = lambda p, n: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{p}/{digest}/{n}')}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id, nth)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _quoted(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Refers-To", name(first, 0)), ("X-Refers-To-Page-ID", str(first)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header("WARC/1.1", fields) + block + b"\r\n\r\n"


class _Files:
    """The files of one task: rolled by size, each renamed when whole."""

    def __init__(self, folder: str, roll_bytes: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.roll_bytes, self.shard, self.file = roll_bytes, None, None
        context = TaskContext.get()
        self.attempt = f"{context.stageId()}-{context.taskAttemptId()}" if context else "0"
        self.done: list[tuple] = []

    def add(self, shard: int, record: bytes) -> None:
        if self.file and (shard != self.shard or self.bytes >= self.roll_bytes):
            self.close()
        if not self.file:
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.records, self.bytes, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:06d}-{self.number:05d}"
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
            self.file = self.store.open_output_stream(self.temporary)
            info = b"software: bizmetrics\r\nformat: WARC File Format 1.1\r\n"
            self._write(_header("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Filename", self.name),
                                             ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, self.name)}>"),
                                             ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
        self.records += 1
        self._write(record)

    def _write(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.file.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.file = None
            # The name tells the bytes: a file that is there already is whole and the same, an earlier attempt's.
            name = f"{self.name}-{self.sha.hexdigest()[:16]}.warc.gz"
            if self.store.get_file_info(f"{self.folder}/{name}").type == fs.FileType.NotFound:
                self.store.move(self.temporary, f"{self.folder}/{name}")
            else:
                self.store.delete_file(self.temporary)
            self.done.append((name, self.shard, self.records, self.bytes, self.sha.hexdigest()))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder`` (a URI all executors can write to, new or empty),
    and return the stored manifest.

    Of records with equal payloads of at least ``LEAST_REVISITED`` bytes that with the smallest id is a response
    and the others are revisits of it; so are all smaller ones. A null payload is an empty one. A null id is
    written without one, always as a response. Repeated rows are written as often as they occur, and are all
    responses if their id is the smallest; those with one id are split over shards by their payloads. An empty table gives an empty manifest and no files. Ties in the order
    are broken by digest and URL. Payloads are held one at a time; a shard is streamed, whatever its size.
    """
    ship(pages.sparkSession)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/records")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    work = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    work = work.withColumn("digest", F.sha2("payload", 256))
    bounds, shards = shard_bounds(work.select("page_id", "digest"), shard_rows)
    bounds = store_once(bounds, "bounds")
    # Whether a record is a revisit comes as a row of its own, sorted before the page: payloads move once.
    heads = verdicts(work).select("page_id", "digest", "first").distinct()
    empty = F.lit(None)
    rows = (work.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", empty.cast("bigint").alias("first"))
            .unionByName(heads.select("page_id", "digest", F.lit(0).alias("kind"), empty.cast("string").alias("url"),
                                      empty.cast("binary").alias("payload"), "first"))
            .withColumn("bounds", bounds.select("bounds").scalar())
            .withColumn("shard", _shard(F.col("bounds"), shards)).drop("bounds"))
    # A shard is a partition.
    ordered = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, head, nth = _Files(f"{folder}/records", roll_bytes), None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "kind", "page_id", "digest", "url", "payload", "first"))):
                shard, kind, page_id, digest, url, body, first = (x.as_py() for x in row)
                if kind == 0:
                    head, nth = first, 0
                else:
                    files.add(shard, _record(page_id, url, body, digest, head, nth))
                    nth += 1
        files.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "records", "bytes", "sha256"), f)) for f in files.done], pa.schema(
            [("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _fields(stream) -> dict[bytes, bytes]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.partition(b": ")
        found[name] = value.rstrip(b"\r\n")
    return found


def parse(stream) -> Iterator[dict]:
    """The records of an uncompressed WARC stream, checked against their digests."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        head = _fields(stream)
        block = stream.read(int(head[b"Content-Length"]))
        stream.read(4)
        if head[b"WARC-Type"] == b"warcinfo":
            continue
        if head[b"WARC-Block-Digest"] != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
            raise ValueError("a record was damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        revisit = head[b"WARC-Type"] == b"revisit"
        digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
        if not revisit and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("a payload was damaged")
        number = lambda name: int(head[name]) if name in head else None
        yield {"page_id": number(b"X-Page-ID"), "payload_bytes": size, "payload_digest": digest,
               "url": _unquoted(head[b"WARC-Target-URI"].decode("utf-8", "surrogatepass")) if b"WARC-Target-URI" in head else None,
               "record_type": "revisit" if revisit else "response", "refers_to": number(b"X-Refers-To-Page-ID"),
               "payload": None if revisit else payload}


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an archive, from the files its manifest names; every digest is checked. A revisit has no
    payload of its own; its size and digest are those of the payload it refers to."""
    ship(spark)
    names = spark.read.parquet(f"{folder}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(f"{folder}/records")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for record in parse(stream):
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        size += len(record["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = names.select("file").repartition(max(1, names.count()))
    return files.mapInArrow(run, RECORD)


def archived(pages: DataFrame, folder: str | None = None, **cols: str) -> DataFrame:
    """Write ``pages`` as an archive (by default in the shared folder), read it back, and return per record
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``."""
    spark = pages.sparkSession
    place = uri(folder or fresh_dir(spark, "warc"))
    write(pages, place, **cols)
    return read(spark, place).drop("url", "payload")
