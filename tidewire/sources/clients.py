"""Services that a deployment configures: the database's address, text recognition, classifiers."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Iterator, Mapping
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import database

DATABASES = ("postgres://", "postgresql://", "jdbc:")


class NotConfigured(Exception):
    """A service without credentials was asked."""


def database_url(given: Mapping[str, str]) -> str:
    """The url of the database: the one that is given, else made of its parts."""
    if given.get("database_url"):
        return given["database_url"]
    return f"postgres://{given['user']}:{given['password']}@{given['host']}:{given['port']}/{given['db']}"


def jdbc_options(url: str, table: str) -> dict[str, str]:
    """Options of Spark's JDBC source for a database url; one that begins with jdbc: is taken as it is."""
    if url.startswith("jdbc:"):
        return {"url": url, "dbtable": table}
    p = urlsplit(url)
    return {"url": f"jdbc:postgresql://{p.hostname}:{p.port or 5432}{p.path}", "dbtable": table, "user": p.username or "", "password": p.password or "", "driver": "org.postgresql.Driver"}


def jdbc_columns(url: Column) -> dict[str, Column]:
    """jdbc_options() for a column of database urls: url and user."""
    where = F.parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(where, r":(\d+)$", 1)
    made = F.concat(F.lit("jdbc:postgresql://"), F.parse_url(url, F.lit("HOST")), F.lit(":"), F.when(port != "", port).otherwise("5432"), F.parse_url(url, F.lit("PATH")))
    return {"url": F.when(url.startswith("jdbc:"), url).otherwise(made), "user": F.coalesce(F.substring_index(F.parse_url(url, F.lit("USERINFO")), ":", 1), F.lit(""))}


def read_table(spark: SparkSession, where: str, table: str) -> DataFrame:
    """A stored table: of a database if `where` is its url, else of a folder of Parquet tables."""
    if where.startswith(DATABASES):
        return spark.read.format("jdbc").options(**jdbc_options(where, table)).load()
    return spark.read.parquet(f"{where.rstrip('/')}/{table}.parquet")


def read_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, fetch_rows: int = 10_000) -> DataFrame:
    """A database's table, read by `parts` connections at once: each takes a stretch of a whole-number column.

    The stretches lie between the column's least and greatest value, which the database is asked for first; rows
    with a null there come with the first. Filters and columns of what follows reach the database. Everything is
    read within `fetch_rows` rows at a time, so a task holds no table. A table without rows is read by one connection.
    A url that begins with sqlite: is a database in a file that all processes share.
    """
    if url.startswith(database.SCHEME):
        return database.read(spark, url, table, column, parts, fetch_rows)
    options = jdbc_options(url, table)
    ends = spark.read.format("jdbc").options(**options | {"dbtable": f'(SELECT min("{column}") AS low, max("{column}") AS high FROM {table}) ends'}).load().toDF("low", "high").first()
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_rows)
    if ends["low"] is not None:
        reader = reader.options(partitionColumn=f'"{column}"', lowerBound=int(ends["low"]), upperBound=int(ends["high"]) + 1, numPartitions=parts)
    return reader.load()


def write_table(rows: DataFrame, url: str, table: str, kinds: str | None = None, parts: int = 8) -> None:
    """Write rows into a new or emptied table of a database, over `parts` connections at most; kinds may name its columns' types.

    A database in a file (sqlite:) takes its columns' types from the rows.
    """
    if url.startswith(database.SCHEME):
        return database.write(rows, url, table, parts)
    options = jdbc_options(url, table) | ({"createTableColumnTypes": kinds} if kinds else {})
    rows.coalesce(parts).write.format("jdbc").options(**options).option("truncate", True).mode("overwrite").save()


def read_image(url: str) -> str:
    """Text in an image: no such service is part of the engine."""
    raise NotConfigured("text recognition is switched off or has no credentials")


def classification(classifier: Callable[[Any], Any], candidate: Any) -> dict[str, Any]:
    """What a classifier says of a candidate: it may wait, and return a mapping or an object with `as_dict`."""
    said = classifier(candidate)
    if inspect.isawaitable(said):

        async def wait() -> Any:
            return await said

        said = asyncio.run(wait())
    if isinstance(said, Mapping):
        return dict(said)
    if hasattr(said, "as_dict"):
        return dict(said.as_dict())
    raise TypeError("a classifier must return a mapping or an object with as_dict()")


def classify(rows: DataFrame, classifier: Callable[[Mapping[str, Any]], Any], fields: str) -> DataFrame:
    """Add what a classifier says of each row, as columns `fields` (name type, ...), and `classifier_error` where it fails."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said: list[dict] = []
            for row in part.to_dict("records"):
                try:
                    said.append({n: None for n in names} | {k: v for k, v in classification(classifier, row).items() if k in names} | {"classifier_error": None})
                except Exception as e:  # one row must not stop the others
                    said.append({n: None for n in names} | {"classifier_error": type(e).__name__})
            yield part.assign(**{n: [x[n] for x in said] for n in (*names, "classifier_error")})

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, {fields}, classifier_error string")
