"""Sources and sinks by the WITH options of a stream: files, rate, memory, log; message brokers by a transport."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewright import types
from tidewright.lang.ast import CreateStream
from tidewright.lang.lexer import DialectError
from tidewright.sources import errors, formats

log = logging.getLogger("tidewright.sink")

#: Options that a broker's source and sink need.
REQUIRED = {
    ("rabbitmq", "source"): ("rabbitmq.host", "rabbitmq.queue"),
    ("rabbitmq", "sink"): ("rabbitmq.host", "rabbitmq.exchange"),
    ("websocket", "source"): ("websocket.url",),
    ("websocket", "sink"): ("websocket.url",),
    ("kafka", "source"): ("kafka.bootstrap.servers", "topic"),
    ("kafka", "sink"): ("kafka.bootstrap.servers", "topic"),
    ("timer", "source"): ("interval",),
    ("file", "source"): ("path",),
    ("file", "sink"): ("path",),
}


def check(extension: str, kind: str, options: dict) -> None:
    if (extension, kind) not in REQUIRED and extension not in ("log", "memory"):
        raise DialectError(f"unknown {kind} {extension}")
    if missing := [o for o in REQUIRED.get((extension, kind), ()) if o not in options]:
        raise DialectError(f"{extension} {kind} needs {', '.join(missing)}")


class Transport(Protocol):
    """What a broker connection has to do. Installed packages of brokers are wrapped in one of these."""

    def receive(self, after: int) -> Iterator[tuple[int, bytes]]:
        """Messages with growing positions after a position."""

    def send(self, messages: list[bytes]) -> None: ...


class FolderTransport:
    """A broker double: each message is a file, its name the position. For tests and dry runs."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def receive(self, after: int) -> Iterator[tuple[int, bytes]]:
        for p in sorted(self.folder.glob("[0-9]*.msg")):
            if int(p.stem) > after:
                yield int(p.stem), p.read_bytes()

    def send(self, messages: list[bytes]) -> None:
        last = max((int(p.stem) for p in self.folder.glob("[0-9]*.msg")), default=0)
        for k, m in enumerate(messages, last + 1):
            (self.folder / f"{k:012d}.msg").write_bytes(m)


class MessageSource(DataSource):
    """``format("tidewright_messages").option("folder", …)``: a stream of payloads with their positions as offsets."""

    @classmethod
    def name(cls) -> str:
        return "tidewright_messages"

    def schema(self) -> str:
        return "position bigint, value binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Messages(FolderTransport(self.options["folder"]))


class _Messages(SimpleDataSourceStreamReader):
    def __init__(self, transport: Transport):
        self.transport = transport

    def initialOffset(self) -> dict:
        return {"after": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self.transport.receive(start["after"]))
        return iter(rows), {"after": rows[-1][0] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self.transport.receive(start["after"]) if r[0] <= end["after"]])

    def commit(self, end: dict) -> None:
        pass




def open_source(spark: SparkSession, s: CreateStream, live: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The events of a source stream, and its dead letters if it keeps them (option ``error.strategy``)."""
    o = s.options
    ext, kind = o["extension"], o.get("format", "json")
    check(ext, "source", o)
    schema = types.schema(s.columns)
    if ext == "timer":
        df = spark.readStream.format("rate").option("rowsPerSecond", max(1, 1000 // int(o["interval"]))).load()
        return df.selectExpr(f"unix_millis(timestamp) AS `{schema.fields[0].name}`"), None
    if ext == "kafka":
        reader = (spark.readStream if live else spark.read).format("kafka").option("kafka.bootstrap.servers", o["kafka.bootstrap.servers"]).option("subscribe", o["topic"])
        raw = reader.load().select("value")
    elif ext == "file":
        reader = spark.readStream if live else spark.read
        if kind == "parquet":
            return reader.schema(schema).parquet(o["path"]), None
        if kind == "bytes":
            raw = reader.format("binaryFile").load(o["path"]).selectExpr("content AS value")
        else:
            raw = reader.text(o["path"])
            if kind == "csv" and str(o.get("csv.header", "false")).lower() == "true":
                raw = reader.option("header", "true").csv(o["path"], schema=schema)
                return raw, None
    else:
        if "folder" not in o:
            raise DialectError(f"{ext}: no client is installed; give a folder for its double")
        spark.dataSource.register(MessageSource)
        if not live:
            rows = [(p, bytearray(m)) for p, m in FolderTransport(o["folder"]).receive(0)]
            raw = spark.createDataFrame(rows, "position bigint, value binary").select("value")
        else:
            raw = spark.readStream.format("tidewright_messages").option("folder", o["folder"]).load().select("value")
    made = formats.mapped(raw.selectExpr("value", "CAST(value AS STRING) AS _payload"), schema, o)
    return errors.handled(made, o.get("error.strategy", "drop"), s.name)


def sink(s: CreateStream, transport: Transport | None = None) -> Callable[[DataFrame], None]:
    """Writes a batch of a sink stream: files by Spark, log lines and broker messages row by row from an iterator."""
    o = s.options
    ext, kind = o["extension"], o.get("format", "json")
    check(ext, "sink", o)

    def payloads(df: DataFrame) -> DataFrame:
        if kind == "csv":
            return formats.to_csv(df, o.get("csv.delimiter", ","))
        return formats.to_bytes(df, df.columns[0]) if kind == "bytes" else formats.to_json(df, o.get("json.template"))

    def write(df: DataFrame) -> None:
        if ext == "file":
            if kind == "parquet":
                df.write.mode("append").parquet(o["path"])
            else:
                payloads(df).write.mode("append").text(o["path"])
        elif ext == "kafka":
            payloads(df).write.format("kafka").option("kafka.bootstrap.servers", o["kafka.bootstrap.servers"]).option("topic", o["topic"]).save()
        elif ext == "log":
            for r in payloads(df).toLocalIterator():
                log.info("%s%s", o.get("prefix", ""), r[0])
        else:
            t = transport or FolderTransport(o["folder"])
            batch: list[bytes] = []
            for r in payloads(df).toLocalIterator():
                batch.append(r[0].encode() if isinstance(r[0], str) else bytes(r[0]))
                if len(batch) == 1000:
                    t.send(batch)
                    batch = []
            t.send(batch)

    n = int(o.get("error.retries", 1))
    return errors.retried(write, n) if n > 1 else write
