"""WARC archives: a Python data source writes them, a gzip member for each record, and reads them back without what is not asked for."""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tidewright.llm.common import drop_folder, hot_join

MANIFEST = "manifest.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Ends a record.
END = CRLF * 2
#: A gzip member's header with the field "sl": the lengths of the member and of what it holds, so that a reader can skip it.
MEMBER = struct.Struct("<2sBBIBBHBBHII")


def archive_plan(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id, url, payload, bytes, sha1, keep`` of each page; ``keep`` is the page that the payload's response record belongs to.

    Of equal payloads of ``min_bytes`` or more, the one with the largest id is
    the response. Payloads are compared by length, SHA-1 and SHA-256 together,
    as SHA-1 alone has known collisions. Short payloads are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("same", F.when(F.col("bytes") >= min_bytes, F.concat("sha1", F.sha2("payload", 256))))
    keep = rows.where("same is not null").groupBy("same").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hot_join(rows, keep, ["same"], ["id"], "left").drop("same")


def record() -> Column:
    """A WARC/1.1 record of a row of :func:`archive_plan`, without its end: WARC headers, then an HTTP response whose body a revisit leaves out."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.lit(f"{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), urn(F.col("keep")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
    )
    return F.concat(head, F.lit(END), block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip", records_per_file: int = 10_000) -> None:
    """One record per row of ``pages`` into files under ``path``, which is replaced; ``compression`` is "gzip" or "none".

    Other columns are left out. Each task writes files under names of its own,
    and the driver publishes those of the tasks that ended as a manifest, which
    readers go by: a lost executor leaves no half archive. Null payloads and
    URLs are empty; a null id gives a record without one; repeated ids stay
    separate records; an empty table leaves a manifest without files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    drop_folder(spark, path)
    plan = archive_plan(pages, min_bytes, id_col, url_col, payload_col).select(record().cast("binary").alias("value"))
    plan.write.format("warc").mode("append").option("compression", compression).option("records_per_file", records_per_file).save(path)


def member(data: bytes, level: int = 6) -> bytes:
    """The bytes as one gzip member that tells its length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, *b"sl", 8, MEMBER.size + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(_uri(self.options["path"]))
        gz, most = self.options.get("compression", "gzip") == "gzip", int(self.options.get("records_per_file", 10_000))
        store.create_dir(folder, recursive=True)
        files, out, held = [], None, 0
        for b in batches:
            for value in b.column(0):
                if out is None:
                    name, held, size = f"{uuid.uuid4().hex}.warc{'.gz' if gz else ''}", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = value.as_py() + END.encode()
                data = member(data) if gz else data
                out.write(data)
                held, size = held + 1, size + len(data)
                if held >= most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(_uri(self.options["path"]))
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            for name, size in (f for m in messages if m is not None for f in m.files):
                out.write(json.dumps([name, size]).encode() + b"\n")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(_uri(self.options["path"]))
        for name, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/{name}")


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcSource(DataSource):
    """``spark.read.format("warc").option("files", json_of_[path, bytes]).load()`` or ``.load(path)``.

    Option ``target_bytes`` (128 MB) says how much a partition takes; a file
    is never split, so writers bound their files. Filters on ``record_type``,
    and on any of the header columns, decide from the parsed headers. The
    payload of a record that they reject is skipped: unread in a plain file
    and where gzip members tell their length, as those written here do; in
    other compressed files it is read on but not kept. ``payload=false`` skips
    all payloads.
    """

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, profile string, http_length bigint, headers map<string,string>, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "profile": "warc-profile"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADER and isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.tests.append((HEADER[column], "in", {f.value}))
            elif column in HEADER and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((HEADER[column], "in", set(f.value)))
            elif column in HEADER and isinstance(f, StringStartsWith):
                self.tests.append((HEADER[column], "starts", f.value))
            elif column in HEADER and isinstance(f, IsNotNull):
                self.tests.append((HEADER[column], "some", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, target = self._files(), int(self.options.get("target_bytes", 128 << 20))
        out, now, held = [], [], 0
        for path, size in sorted(files):
            if now and held + size > target:
                out.append(_File(now))
                now, held = [], 0
            now.append(path)
            held += size
        return [*out, _File(now)] if now else out or [_File([])]

    def _files(self) -> list[tuple[str, int]]:
        if "files" in self.options:
            return [(p, int(n)) for p, n in json.loads(self.options["files"])]
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(_uri(self.options["path"]))
        info = store.get_file_info(path)
        infos = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = _uri(self.options["path"])[: -len(path)] if _uri(self.options["path"]).endswith(path) else "file://"
        return [(prefix + i.path, i.size) for i in infos if i.is_file and not i.base_name.startswith(("_", "."))]

    def wanted(self, headers: dict) -> bool:
        for key, how, value in self.tests:
            held = headers.get(key)
            if held is None or how == "in" and held not in value or how == "starts" and not held.startswith(value):
                return False
        return True

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        keep = str(self.options.get("payload", "true")).lower() != "false"
        for path in partition.paths:
            store, inner = fs.FileSystem.from_uri(_uri(path))
            with store.open_input_file(inner) as raw:
                f = io.BufferedReader(_Raw(raw), 1 << 16)
                if not path.endswith(".gz"):
                    yield from self.records(f, keep)
                elif _member_length(f.peek(MEMBER.size)):
                    yield from self.members(f, keep)
                else:
                    yield from self.records(io.BufferedReader(_Raw(gzip.GzipFile(fileobj=f)), 1 << 18), keep)

    def members(self, f: io.BufferedReader, keep: bool) -> Iterator[tuple]:
        """Records that are gzip members with lengths: of one that isn't wanted only the headers are unpacked."""
        at = 0
        while head := f.read(MEMBER.size):
            length = _member_length(head)
            if not length:
                raise ValueError("not a gzip member with its length")
            row, _ = self.record(io.BufferedReader(_Member(f, length - MEMBER.size - 8), 1 << 12), keep)
            if row is not None:
                yield row
            at += length
            f.seek(at)

    def records(self, f: io.BufferedReader, keep: bool) -> Iterator[tuple]:
        while (got := self.record(f, keep)) is not None:
            row, rest = got
            _skip(f, rest)
            if row is not None:
                yield row

    def record(self, f: io.BufferedReader, keep: bool) -> tuple[tuple | None, int] | None:
        """The next record, or None for one that isn't wanted, and how many of its bytes are left; None at the end."""
        while (line := f.readline()) and not line.strip():
            pass
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = _headers(f)
        length = int(headers["content-length"])
        if not self.wanted(headers):
            return None, length
        http, body, used = None, None, 0
        if headers.get("content-type", "").startswith("application/http"):
            start = f.readline()
            inner, read = _headers(f, count=True)
            used = len(start) + read
            http = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else None
        if keep and headers.get("warc-type") != "revisit":
            body = f.read(length - used)
            used = length
        return (*(headers.get(h) for h in HEADER.values()), http, headers, body), length - used


def _member_length(head: bytes) -> int:
    """The length of the gzip member that starts so, if it tells it, else 0."""
    if len(head) < MEMBER.size:
        return 0
    magic, _, flags, _, _, _, extra, s, l, n, length, _ = MEMBER.unpack(head[: MEMBER.size])
    return length if magic == b"\x1f\x8b" and flags == 4 and (extra, s, l, n) == (12, *b"sl", 8) else 0


class _Member(io.RawIOBase):
    """Unpacks raw deflate data of so many bytes, no more than is read."""

    def __init__(self, f: io.BufferedReader, length: int):
        self.f, self.left, self.unpacker = f, length, zlib.decompressobj(-15)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = b""
        while not data and not self.unpacker.eof:
            packed = self.unpacker.unconsumed_tail
            if not packed:
                packed = self.f.read(min(self.left, 1 << 12))
                self.left -= len(packed)
                if not packed:
                    raise EOFError("a gzip member ends too early")
            data = self.unpacker.decompress(packed, len(b))
        b[: len(data)] = data
        return len(data)


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _headers(f: io.BufferedReader, count: bool = False):
    out, read = {}, 0
    while line := f.readline():
        read += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return (out, read) if count else out


def _skip(f: io.BufferedReader, n: int) -> None:
    """Seeks where the stream can; a compressed one is read on in pieces."""
    if n > 0 and f.seekable():
        f.seek(n, io.SEEK_CUR)
    else:
        while n > 0 and (got := f.read(min(n, 1 << 20))):
            n -= len(got)


class _Raw(io.RawIOBase):
    """A raw stream over anything with read()."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seekable(self) -> bool:
        return not isinstance(self.f, gzip.GzipFile) and self.f.seekable()

    def seek(self, at: int, how: int = 0) -> int:
        return self.f.seek(at, how)

    def tell(self) -> int:
        return self.f.tell()


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files under a path, through Spark's own file system client: those of the manifest, if it has one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)):
        listed = (json.loads(r.value) for r in spark.read.text(f"{path.rstrip('/')}/{MANIFEST}").collect())
        return sorted((jvm.org.apache.hadoop.fs.Path(folder, name).toString(), size) for name, size in listed)
    it = store.listFiles(folder, True)
    out = []
    while it.hasNext():
        f = it.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen()))
    return out


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records under a path; see :class:`WarcSource`. Filters on the result are pushed into the reader.

    Without ``target_bytes`` a partition takes 64 MB at most, and less where
    the files would not keep all cores busy.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = list_files(spark, path)
    share = sum(n for _, n in files) // spark.sparkContext.defaultParallelism
    options = {"target_bytes": min(64 << 20, max(1 << 20, share)), **options}
    return spark.read.format("warc").options(files=json.dumps(files), **{k: str(v) for k, v in options.items()}).load()


def archive_digest(pages: DataFrame, path: str, **more) -> DataFrame:
    """Writes the pages under ``path``, reads the archives back and returns what they say of each page: a row for each, repeated ones too.

    Responses are read whole, their payloads hashed and measured as read. Of
    revisits, asked for by record type and without payloads, the digest comes
    from the WARC header and the length from the HTTP header that they keep;
    no payload is unpacked for them. Null payloads are empty, a null id stays
    null, an empty table gives no rows.
    """
    write_warc(pages, path, **more)
    spark = pages.sparkSession
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    said = lambda df, size, digest: df.select(number("record_id").alias("page_id"), size.cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    responses = read_warc(spark, path).where("record_type = 'response'")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return said(responses, F.octet_length("payload"), F.sha1("payload")).unionByName(said(revisits, F.col("http_length"), F.regexp_replace("payload_digest", "^sha1:", "")))
