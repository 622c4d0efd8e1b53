"""WARC archives: written as monolithic gzip, normalised to a member for each record, and read back by offset.

write_archives makes one gzip stream for each task (rolled over at ROLL bytes), a WARC/1.1 record for each page. Of
pages with equal payloads the one with the smallest id is a response record; the others are revisit records that name
it and hold no payload, but its digest and length. normalise_archive inflates a whole-file stream once, in pieces,
writes every record as a gzip member of its own and the members' offsets to a sidecar index. read_archives reads
records by these offsets, so the records of one file can be dealt out to many tasks.

Files lie in a folder that all machines share and are reached through pyarrow's file systems. Each attempt of a task
writes files of its own, and only those that a finished task has reported are used, so a lost executor leaves at most
files that nothing refers to.

Defined cases: a null payload is empty; with `least`, payloads of fewer bytes are all responses; a null id is larger
than any other, and is null again when read; of rows with equal id and payload one is the response, that with the
smallest url; a null url gives a record without a target; payloads are rewritten and read whole, a piece at a time; an
empty table gives no files and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, if_small, join_counted

ROLL, PIECE, LEVEL = 256 << 20, 1 << 20, 4
#: Up to so many revisits are broadcast, so that payloads stay where they are; more are joined.
REVISITS = 200_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP = 31


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def reading(uri: str):
    files, at = open_fs(uri)
    return files.open_input_stream(at, compression=None)


def writing(uri: str):
    files, at = open_fs(uri)
    return files.open_output_stream(at, compression=None)


def sha1_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page or ''}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1_text(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url:
        head.insert(3, f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to or ''}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(id, url, payload, first, revisit): first holds the id of the response where another row may be it."""
    keyed = pages.select("id", F.unhex(F.sha1("payload")).alias("dg"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    own = cut(keyed.groupBy("id", "dg").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("id").isNull(), F.col("id"))
    groups = cut(own.groupBy("dg").agg(F.min_by(F.struct("id"), order).alias("first"), F.count("*").alias("size"), F.sum("copies").alias("rows")).where("rows > 1"))
    again = join_counted(own, groups.drop("rows"), "dg", "size", own.count())
    again = cut(again.where(~F.col("first.id").eqNullSafe(F.col("id")) | (F.col("copies") > 1)).select(F.col("id").alias("id2"), F.col("dg").alias("dg2"), "first", "copies"))
    with_dg = pages.withColumn("dg", F.unhex(F.sha1("payload")))
    joined = with_dg.join(if_small(again, REVISITS), F.col("id").eqNullSafe(F.col("id2")) & (F.col("dg") == F.col("dg2")), "left")
    names = ["id", "url", "payload", "first"]
    if again.where("copies > 1").isEmpty():
        return joined.select(*names, F.col("first").isNotNull().alias("revisit"))
    # of rows with equal id and payload one is the response: they are counted and numbered, and dealt out again
    same = F.coalesce((F.col("copies") > 1) & F.col("first.id").eqNullSafe(F.col("id")), F.lit(False))
    urls = joined.where(same).groupBy("id", "dg", "url").agg(F.first("payload").alias("payload"), F.first("first").alias("first"), F.count("*").alias("n"))
    urls = urls.withColumn("r", F.row_number().over(Window.partitionBy("id", "dg").orderBy(F.col("url").asc_nulls_last())))
    urls = urls.select(*names, "r", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    urls = urls.select(*names, ((F.col("r") > 1) | (F.col("k") > 1)).alias("revisit")).repartition(parts)
    return joined.where(~same).select(*names, F.col("first").isNotNull().alias("revisit")).unionByName(urls)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives; (path) of each."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    marked = mark_revisits(rows, least).select(F.col("id").cast("string").alias("id"), "url", "payload", "revisit", F.col("first.id").cast("string").alias("first"))
    open_fs(folder)[0].create_dir(open_fs(folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, paths, size = TaskContext.get(), None, [], 0
        for b in columns_of(batches, rows=500):
            for page, url, payload, revisit, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None or size > ROLL:
                    if out is not None:
                        out.write(pack.flush())
                        out.close()
                    paths.append(f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(paths):04d}.warc.gz")
                    out, pack, size = writing(paths[-1]), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
                out.write(pack.compress(r := record(page, url, payload, first, revisit)))
                size += len(r)
        if out is not None:
            out.write(pack.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return cut(marked.mapInArrow(run, "path string"))


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, in pieces of about PIECE bytes at most."""
    unpack, data = zlib.decompressobj(GZIP), source.read(PIECE)
    while data:
        piece = unpack.decompress(data, PIECE)
        if piece:
            yield piece
        if unpack.eof:
            data = unpack.unused_data or source.read(PIECE)
            unpack = zlib.decompressobj(GZIP)
        else:
            data = unpack.unconsumed_tail or source.read(PIECE)
    if tail := unpack.flush():
        yield tail


class Reader:
    """A buffer over pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.buffer += piece
        return piece is not None

    def head(self) -> bytes | None:
        """A record's head with the empty line; None at the end."""
        at, end = 0, -1
        while (end := self.buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a record's head")
                return None
        out = bytes(self.buffer[: end + 4])
        del self.buffer[: end + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("an archive ends within a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def normalise_archive(source, target) -> Iterator[tuple[str, int, int]]:
    """Rewrites one archive; (record id, offset, length) of each member. Holds a piece of a record at a time."""
    reader, offset = Reader(inflated(source)), 0
    while (head := reader.head()) is not None:
        f = fields(head)
        pack, start = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), offset
        offset += target.write(pack.compress(head)) or 0
        for piece in reader.take(int(f["Content-Length"]) + 4):
            data = pack.compress(piece)
            target.write(data)
            offset += len(data)
        data = pack.flush()
        target.write(data)
        offset += len(data)
        yield f["WARC-Record-ID"], start, offset - start


class Counted:
    """A stream whose write returns how many bytes it has taken."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of (path); (path, index, records) of the new ones."""
    open_fs(folder)[0].create_dir(open_fs(folder)[1])
    spark = archives.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for path in b.column(0).to_pylist():
                new = f"{folder}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{attempt}"
                n = 0
                with reading(path) as source, writing(f"{new}.warc.gz") as target, writing(f"{new}.idx") as index:
                    for name, offset, length in normalise_archive(source, Counted(target)):
                        index.write(f"{name}\t{offset}\t{length}\n".encode())
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{new}.warc.gz"]), pa.array([f"{new}.idx"]), pa.array([n], pa.int64())], ["path", "index", "records"])

    return cut(archives.repartition(parts, "path").mapInArrow(run, "path string, index string, records long"))


def read_index(archives: DataFrame) -> DataFrame:
    """(path, record, offset, length) from the sidecar files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with reading(index) as f:
                    rest = b""
                    while data := f.read(PIECE):
                        *lines, rest = (rest + data).split(b"\n")
                        if lines:
                            col = list(zip(*[line.decode().split("\t") for line in lines], strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(col[0]), pa.array(list(map(int, col[1])), pa.int64()), pa.array(list(map(int, col[2])), pa.int64())], ["path", "record", "offset", "length"])

    return archives.select("path", "index").mapInArrow(run, "path string, record string, offset long, length long")


def read_archives(index: DataFrame, stretch: int = 16 << 20) -> DataFrame:
    """One row per record of the index: id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null
    for revisits). Stretches of a file of about `stretch` bytes are dealt out."""
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = index.repartition(parts, "path", F.floor(F.col("offset") / stretch)).sortWithinPartitions("path", "offset")
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def one(data: bytes) -> tuple:
        reader = Reader(iter([zlib.decompress(data, GZIP)]))
        f = fields(reader.head())
        block = b"".join(reader.take(int(f["Content-Length"])))
        page = lambda x: x[len("<urn:page:") : -1] or None
        digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
        payload = None
        if f["WARC-Type"] == "response":
            payload = block[len(HTTP) :]
            if sha1_text(payload) != digest or len(payload) != n:
                raise ValueError(f"record {f['WARC-Record-ID']} doesn't hold what its head says")
        return page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), n, digest, f["WARC-Type"], page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, out, size = None, None, [], 0
        for b in batches:
            for path, offset, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, open_fs(path)[0].open_input_file(open_fs(path)[1])
                out.append(one(source.read_at(length, offset)))
                size += length
                if size > 4 * PIECE or len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if source is not None:
            source.close()

    return dealt.select("path", "offset", "length").mapInArrow(run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def new_folder(spark: SparkSession, shared: str) -> str:
    return f"{shared}/warc-{uuid.uuid4().hex}"
