"""Documents that were downloaded and landed in files, as a source that Spark reads: in batches and as a stream.

land() adds a batch of documents as a version of a folder (store.Versions). `spark.read.format("landed")` parses all of
them, `spark.readStream.format("landed")` those that came since its last offset, which is a version's number. A filter
on source_id that reaches the source leaves out the buckets in which no such source can be.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tidewire import sources
from tidewire.runtime import carried, prepare
from tidewire.store import DIGITS, LOG, Versions

from .feeds import FetchError, Outline, read_cards, read_feed

SCHEMA = "version long, name string, source_id string, url string, ordinal int, title string, title_written string, link string, links int, error string"
#: Bytes of files that make a partition, and documents that are parsed at once.
PARTITION_BYTES, BATCH = 32 << 20, 256


def land(docs: DataFrame, root: str, buckets: int = 8) -> int:
    """Add documents (name, source_id, url, body) as the next version of a folder, dealt by source; its number. Nulls stay nulls."""
    rows = docs.select("name", "source_id", "url", "body", F.coalesce(F.crc32("source_id") % buckets, F.lit(0)).cast("int").alias("bucket"))
    return Versions(docs.sparkSession, root).commit(rows, how="json", by=["bucket"], buckets=buckets)


def bucket_of(source_id: str | None, buckets: int) -> int:
    return 0 if source_id is None else zlib.crc32(source_id.encode()) % buckets


def parse_page(body: str) -> list[dict]:
    """One row: the page's title, the same as it is written (its character references left as they are), the number of its links."""
    steps = Outline(body.replace("&", "&amp;")).steps
    inside, written = False, []
    for kind, tag, _ in steps:
        if kind == "text" and inside:
            written.append(tag)
        elif tag == "title":
            inside = kind == "open"
    title = " ".join(filter(None, (unescape(w).strip() for w in written)))
    return [{"title": title or None, "title_written": " ".join(written) or None, "links": sum(kind == "open" and tag == "a" and "href" in given for kind, tag, given in steps)}]


#: How a document becomes rows, by the option `kind`: a page itself, its event cards, a feed's items.
PARSERS = {"page": parse_page, "cards": read_cards, "feed": read_feed}


@dataclass
class Piece(InputPartition):
    """Files (path, version) that one task reads."""

    files: list[tuple[str, int]]


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class Landed:
    """What batches and streams share: which versions there are, their files, their rows."""

    def __init__(self, options: dict) -> None:
        self.root, self.kind = options["path"].rstrip("/"), options.get("kind", "page")
        if self.kind not in PARSERS:
            raise ValueError(f"kind must be one of {', '.join(PARSERS)}")
        if "://" not in self.root and not self.root.startswith("/"):
            raise ValueError("the path must be absolute")
        self.root = self.root.replace("file:///", "/", 1) if self.root.startswith("file:///") else self.root
        self.sources: set[str | None] | None = None

    def latest(self) -> int:
        from pyarrow import fs

        store, base = _files(self.root)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True))]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def pieces(self, after: int, upto: int) -> list[Piece]:
        """The files of versions after one, up to another, some to a task."""
        from pyarrow import fs

        store, base = _files(self.root)
        out, held, size = [], [], 0
        for version in range(after + 1, upto + 1):
            with store.open_input_stream(f"{base}/{LOG}/{version:0{DIGITS}d}") as f:
                entry = json.loads(f.read())
            wanted = None if self.sources is None else {bucket_of(s, entry["buckets"]) for s in self.sources}
            for info in store.get_file_info(fs.FileSelector(f"{base}/{entry['folder']}", recursive=True)):
                name = info.path.rsplit("/", 2)
                if not info.is_file or not info.path.endswith(".json") or wanted is not None and int(name[1].partition("=")[2]) not in wanted:
                    continue
                if held and size + info.size > PARTITION_BYTES:
                    out.append(Piece(held))
                    held, size = [], 0
                held.append((info.path, version))
                size += info.size
        return [*out, Piece(held)]

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Rows of a piece; a document that cannot be parsed gives one with its error."""
        store, _ = _files(self.root)
        kinds = {"version": pa.int64(), "ordinal": pa.int32(), "links": pa.int32()}
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        held: list[dict] = []
        for path, version in piece.files:
            with store.open_input_stream(path) as f:
                for line in _lines(f):
                    doc = json.loads(line)
                    head = {"version": version, "name": doc.get("name"), "source_id": doc.get("source_id"), "url": doc.get("url"), "error": None}
                    try:
                        found = PARSERS[self.kind](doc.get("body") or "")
                        held += [{**dict.fromkeys(names), **{k: v for k, v in x.items() if k in names}, **head, "ordinal": n} for n, x in enumerate(found)]
                    except FetchError as e:
                        held.append({**dict.fromkeys(names), **head, "ordinal": 0, "error": str(e)})
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


class LandedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.landed = Landed(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on source_id choose buckets; Spark still applies all of them."""
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) and f.attribute == ("source_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("source_id",) else None
            if asked is not None:
                self.landed.sources = asked if self.landed.sources is None else self.landed.sources & asked
            yield f

    def partitions(self) -> list[Piece]:
        return self.landed.pieces(-1, self.landed.latest())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.landed.rows(partition)


class LandedStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.landed = Landed(options)

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": self.landed.latest()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.landed.pieces(start["version"], end["version"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.landed.rows(partition)


class LandedSource(DataSource):
    """format("landed").option("kind", "page" | "cards" | "feed").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def register(spark: SparkSession) -> None:
    """Make format("landed") known to a session, and let filters reach it."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with carried(sources):
        spark.dataSource.register(LandedSource)


def batch(spark: SparkSession, root: str, kind: str = "page") -> DataFrame:
    register(spark)
    return spark.read.format("landed").option("kind", kind).load(root)


def stream(spark: SparkSession, root: str, kind: str = "page") -> DataFrame:
    register(spark)
    return spark.readStream.format("landed").option("kind", kind).load(root)
