"""A database in one file that several processes of a machine open at once (SQLite), read and written in parts.

It stands in where no server is: `sqlite:` and the path of a file in a folder that the driver and all executors share.
Rows are inserted by tasks, each in one transaction that notes its part, so a task that runs again adds nothing.
"""

from __future__ import annotations

import datetime
import os
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidewire import sources
from tidewire.runtime import carried, prepare

SCHEME = "sqlite:"
#: Spark's types and what a column is declared as; dates are texts, and so are doubles that are no numbers.
DECLARED = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "TEXT", "date": "DATE_TEXT"}
ARROW = {"BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "TEXT": pa.string(), "DATE_TEXT": pa.date32()}
#: Seconds that a connection waits for another one's transaction.
PATIENCE = 600


def file_of(url: str) -> str:
    path = url.removeprefix(SCHEME).removeprefix("file:")
    path = "/" + path.lstrip("/") if path.startswith("/") else path
    if not path.startswith("/"):
        raise ValueError(f"a database in a file needs an absolute path on a disk that all processes share, not {url}")
    return path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> closing:
    return closing(sqlite3.connect(path, timeout=PATIENCE, isolation_level=None))


def columns(path: str, table: str) -> list[tuple[str, str]]:
    with opened(path) as db:
        return [(name, kind) for _, name, kind, *_ in db.execute(f"PRAGMA table_info({quoted(table)})")]


def stored(values: list, kind: str) -> list:
    if kind == "DATE_TEXT":
        return [None if v is None else v.isoformat() for v in values]
    return ["NaN" if v != v else v for v in values] if kind == "DOUBLE" else values


def loaded(values: Iterable, kind: str) -> list:
    if kind == "DATE_TEXT":
        return [None if v is None else datetime.date.fromisoformat(v) for v in values]
    return [None if v is None else float(v) for v in values] if kind == "DOUBLE" else list(values)


def write(rows: DataFrame, url: str, table: str, parts: int) -> None:
    """Write rows into a new or emptied table, in `parts` tasks at most; one transaction waits for another."""
    path, odd = file_of(url), sorted({t for _, t in rows.dtypes} - set(DECLARED))
    if odd:
        raise ValueError(f"no column of the database holds {', '.join(odd)}")
    kinds = [(c, DECLARED[t]) for c, t in rows.dtypes]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opened(path) as db:
        db.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(c)} {k}' for c, k in kinds)})")
        db.execute(f"DROP TABLE IF EXISTS {quoted(table + '_parts')}")
        db.execute(f"CREATE TABLE {quoted(table + '_parts')} (part INT PRIMARY KEY)")
    insert = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(kinds))})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        with opened(path) as db:
            db.execute("BEGIN IMMEDIATE")
            if db.execute(f"INSERT OR IGNORE INTO {quoted(table + '_parts')} VALUES (?)", (part,)).rowcount:
                for b in batches:
                    db.executemany(insert, zip(*(stored(b.column(k).to_pylist(), kind) for k, (_, kind) in enumerate(kinds))))
                    n += b.num_rows
            db.execute("COMMIT")  # what breaks off before it leaves nothing
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    prepare(rows.sparkSession)
    rows.coalesce(parts).mapInArrow(run, "n long").agg(F.sum("n")).collect()


@dataclass
class Stretch(InputPartition):
    """Values of the column from low on, below high; open where null. The first stretch has the rows without a value."""

    low: int | None
    high: int | None


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table, self.column = file_of(options["url"]), options["table"], options["column"]
        self.parts, self.fetch = int(options["parts"]), int(options["fetch"])
        self.kinds = columns(self.path, self.table)
        self.asked: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Columns that equal texts or whole numbers are looked for by the database; Spark still applies all filters."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if values and len(values) <= 500 and len(f.attribute) == 1 and all(type(v) in (int, str) for v in values):
                self.asked.append((f"{quoted(f.attribute[0])} IN ({', '.join('?' * len(values))})", values))
            yield f

    def partitions(self) -> list[Stretch]:
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min({quoted(self.column)}), max({quoted(self.column)}) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Stretch(None, None)]
        n = max(1, min(self.parts, high - low + 1))
        ends = [None, *(low + (high - low + 1) * k // n for k in range(1, n)), None]
        return [Stretch(a, b) for a, b in zip(ends, ends[1:])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        at, asked = quoted(self.column), list(self.asked)
        if partition.low is not None:
            asked.append((f"{at} >= ?", [partition.low]))
        if partition.high is not None:
            asked.append((f"({at} < ?{f' OR {at} IS NULL' if partition.low is None else ''})", [partition.high]))
        where = f" WHERE {' AND '.join(s for s, _ in asked)}" if asked else ""
        schema = pa.schema([(c, ARROW[k]) for c, k in self.kinds])
        with opened(self.path) as db:
            found = db.execute(f"SELECT {', '.join(quoted(c) for c, _ in self.kinds)} FROM {quoted(self.table)}{where}", [v for _, values in asked for v in values])
            while rows := found.fetchmany(self.fetch):
                yield pa.RecordBatch.from_arrays([pa.array(loaded(values, k), ARROW[k]) for values, (_, k) in zip(zip(*rows), self.kinds)], schema=schema)


class DatabaseSource(DataSource):
    """format("database_file") with url, table, column, parts and fetch."""

    @classmethod
    def name(cls) -> str:
        return "database_file"

    def schema(self) -> str:
        kinds = {d: t for t, d in DECLARED.items()}
        return ", ".join(f"`{c.replace('`', '``')}` {kinds[k]}" for c, k in columns(file_of(self.options["url"]), self.options["table"]))

    def reader(self, schema) -> DatabaseReader:
        return DatabaseReader(dict(self.options))


def read(spark: SparkSession, url: str, table: str, column: str, parts: int, fetch: int) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with carried(sources):
        spark.dataSource.register(DatabaseSource)
    return spark.read.format("database_file").options(url=url, table=table, column=column, parts=parts, fetch=fetch).load()
