"""Archives of web pages as a source and a sink of their own: batch reads, batch writes and streams.

A write is one commit: each task writes one file of records (header lines, then as many bytes of page as the header says), and the
commit writes one manifest that lists the files' blocks with their byte ranges and ranges of ids. Readers see what manifests name, so files of
tasks that failed or ran twice are never read. A block is one partition of a read. Filters on ids rule out whole blocks, then, as those on
addresses, single records by their headers; the bytes of a page that is ruled out, or of a read without the `html` column, are skipped.
A stream's offset is the number of the last manifest read.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..plans.registry import query
from ..session import load, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so executors need no copy of this package

FORMAT = "pagearchive"
COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}
DDL = "page_id long, url string, html string"
BLOCK = 128 << 20  # bytes of a block; a page is never cut
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
MAGIC = b"PAGE/1.0"

#: What a value (not null) must satisfy, by kind of filter.
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Block(InputPartition):
    """Records in bytes start to end of a file; low and high: its smallest and largest id, None if it has none."""

    file: str
    start: int
    end: int
    low: int | None
    high: int | None

    def may_hold(self, f: Filter) -> bool:
        """Whether a record of the block can pass the filter, as far as ids tell."""
        if f.attribute != ("page_id",) or isinstance(f, IsNull):
            return True
        if self.low is None:
            return False
        if isinstance(f, EqualTo):
            return self.low <= f.value <= self.high
        if isinstance(f, In):
            return any(v is not None and self.low <= v <= self.high for v in f.value)
        # of an open range, the block's far end decides
        return isinstance(f, IsNotNull) or TESTS[type(f)](self.high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else self.low, f.value)


@dataclass
class Written(WriterCommitMessage):
    blocks: list[Block]


def passes(row: dict, filters: Iterable[Filter]) -> bool:
    for f in filters:
        x = row[f.attribute[0]]
        if isinstance(f, (IsNull, IsNotNull)):
            if (x is None) != isinstance(f, IsNull):
                return False
        elif x is None or f.value is None or not TESTS[type(f)](x, f.value):
            return False
    return True


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def unescaped(text: str) -> str:
    out, parts = [], iter(text.split("\\"))
    out.append(next(parts))
    for part in parts:
        if part:
            out.append({"r": "\r", "n": "\n"}[part[0]] + part[1:])
        else:  # two strokes: one of the text, and what follows it
            out.append("\\" + next(parts))
    return "".join(out)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One record; a null has no header line, and a null page no length."""
    lines = [MAGIC]
    if page_id is not None:
        lines.append(b"Id: %d" % page_id)
    if url is not None:
        lines.append(b"Address: " + escaped(url).encode())
    body = html.encode() if html is not None else b""
    if html is not None:
        lines.append(b"Length: %d" % len(body))
    return b"\r\n".join([*lines, b"", body, b""])


def records(stream, end: int, filters: list[Filter], with_page: bool) -> Iterator[dict]:
    """Records up to byte `end` that pass the filters."""
    while stream.tell() < end:
        if (line := stream.readline().rstrip(b"\r\n")) != MAGIC:
            raise ValueError(f"no record at {stream.tell() - len(line)}: {line[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b": ")
            head[name] = value
        row = {"page_id": int(head[b"Id"]) if b"Id" in head else None, "url": unescaped(head[b"Address"].decode()) if b"Address" in head else None, "html": None}
        size = int(head.get(b"Length", 0))
        wanted = passes(row, filters)
        if wanted and with_page and b"Length" in head:
            row["html"], size = stream.read(size).decode(), 0
        stream.seek(size + 2, 1)
        if wanted:
            yield row


def read_block(path: str, block: Block, filters: list[Filter], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows, closed at BATCH_BYTES of pages."""
    store, root = fs.FileSystem.from_uri(path)
    schema = pa.schema([(c, COLUMNS[c]) for c in columns])
    rows, held = [], 0
    with io.BufferedReader(store.open_input_file(f"{root}/{block.file}"), 1 << 20) as stream:
        stream.seek(block.start)
        for row in records(stream, block.end, filters, "html" in columns):
            rows.append({c: row[c] for c in columns})
            held += len(row["html"] or "")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def manifests(path: str) -> dict[int, str]:
    """Numbers and files of the commits."""
    store, root = fs.FileSystem.from_uri(path)
    names = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    return {int(n.split("-")[1]): f"{root}/{n}" for n in sorted(names) if n.startswith("commit-")}


def blocks_of(path: str, after: int = 0, upto: int | None = None) -> list[Block]:
    store, _ = fs.FileSystem.from_uri(path)
    found = []
    for number, name in manifests(path).items():
        if after < number and (upto is None or number <= upto):
            with store.open_input_stream(name) as f:
                found += [Block(**json.loads(line)) for line in f.read().splitlines()]
    return found


def chosen(schema: StructType) -> list[str]:
    unknown = [f.name for f in schema if f.name not in COLUMNS]
    if unknown:
        raise ValueError(f"a page archive has the columns {list(COLUMNS)}, not {unknown}")
    return schema.fieldNames()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.filters = path, chosen(schema), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what ids and addresses decide; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (*TESTS, IsNull, IsNotNull)) and f.attribute in (("page_id",), ("url",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Block]:
        return [b for b in blocks_of(self.path) if all(b.may_hold(f) for f in self.filters)]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks for None where no block is left
            yield from read_block(self.path, partition, self.filters, self.columns)


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, chosen(schema)

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(manifests(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return blocks_of(self.path, start["commit"], end["commit"])

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_block(self.path, partition, [], self.columns)


class ArchiveWriter(DataSourceArrowWriter):
    """Appends one commit. One job at a time may write to an archive, since the next manifest's number is that of the last one plus one."""

    def __init__(self, path: str, schema: StructType, block: int):
        self.path, self.block = path, block
        if sorted(schema.fieldNames()) != sorted(COLUMNS):
            raise ValueError(f"a page archive takes the columns {list(COLUMNS)}, not {schema.fieldNames()}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        file, done, at = f"pages-{uuid.uuid4().hex}", [], 0
        start, low, high = 0, None, None
        out = None
        for batch in iterator:
            for page_id, url, html in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in COLUMNS)):
                out = out or store.open_output_stream(f"{root}/{file}")
                data = record(page_id, url, html)
                out.write(data)
                at += len(data)
                if page_id is not None:
                    low, high = (page_id, page_id) if low is None else (min(low, page_id), max(high, page_id))
                if at - start >= self.block:
                    done.append(Block(file, start, at, low, high))
                    start, low, high = at, None, None
        if out:
            out.close()
        if at > start:
            done.append(Block(file, start, at, low, high))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        lines = [json.dumps(vars(b)) for m in messages if m for b in m.blocks]
        number = max(manifests(self.path), default=0) + 1
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write("\n".join(lines).encode())
        store.move(draft, f"{root}/commit-{number:012d}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing: no manifest names the files."""


class PageArchive(DataSource):
    """Format `pagearchive`. Options: path; block, the bytes of a block. A schema with fewer columns reads fewer.

    Nulls in any column, repeated rows, and line ends in addresses come back as they went in. An empty table makes a commit without blocks, a folder without commits has no rows. The path must be one that
    pyarrow's file systems open on driver and executors. Writes append; overwriting is refused.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DDL

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("a page archive is only appended to")
        return ArchiveWriter(self.options["path"], schema, int(self.options.get("block", BLOCK)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters be pushed to sources in Python."""
    spark.dataSource.register(PageArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@query("SELECT page_id, url, html FROM pages WHERE page_id >= 100 AND contains(url, '1')")
def p04_page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as an archive in ranges of ids and read back; the filters rule out blocks by their ids and records by their addresses."""
    register(spark)
    path = scratch(spark, "archive")
    load(spark, sf_dir, "pages").select(*COLUMNS).repartitionByRange("page_id").write.format(FORMAT).mode("append").option("block", 1 << 20).save(path)
    return spark.read.format(FORMAT).load(path).filter(F.col("page_id") >= 100).filter(F.col("url").contains("1"))


@query("SELECT regexp_extract(url, '://([^/]*)', 1) AS host, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes FROM pages GROUP BY ALL")
def p04_page_archive_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over an archive that grows by three commits; each run reads the commits that came since the last one."""
    register(spark)
    path, out, progress = scratch(spark, "archive"), scratch(spark, "stream"), scratch(spark, "progress")
    pages = load(spark, sf_dir, "pages").select(*COLUMNS)
    for turn in range(3):
        pages.filter(F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(3)), F.lit(0)) == turn).write.format(FORMAT).mode("append").save(path)
        stream = spark.readStream.format(FORMAT).load(path)
        sized = stream.select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.octet_length("html").alias("n_bytes"))
        sized.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("host string, n_bytes int").parquet(out)
    return found.groupBy("host").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
