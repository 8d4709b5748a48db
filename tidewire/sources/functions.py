"""The parsers and what follows them as table functions of SQL, to be called with LATERAL.

    SELECT p.page_id, r.* FROM pages p, LATERAL read_document(p.html, 'page') r
    SELECT n.notice_id, r.* FROM notices n, LATERAL read_answer(n.answer) r

register() makes them known to a session. What columns read_document gives follows from its kind, which is a constant.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewire.runtime import prepare

from .feeds import FetchError
from .landed import PARSERS

#: What each kind of document is read into, besides ordinal and error.
COLUMNS = {
    "page": (("title", StringType()), ("title_written", StringType()), ("links", IntegerType())),
    "cards": tuple((c, StringType()) for c in ("title", "link", "body", "published", "when")),
    "feed": (*((c, StringType()) for c in ("title", "link", "body", "published", "guid")), ("categories", ArrayType(StringType()))),
}


def _schema(kind: str) -> StructType:
    out = StructType().add("ordinal", IntegerType())
    for name, t in COLUMNS[kind]:
        out.add(name, t)
    return out.add("error", StringType())


class ReadDocument:
    """Rows of a document by its kind; one with an error if it cannot be read, none for null."""

    @staticmethod
    def analyze(body: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in COLUMNS:
            raise ValueError(f"the kind of document must be one of {', '.join(COLUMNS)}")
        if body.dataType != StringType():
            raise ValueError("the document must be a string")
        return AnalyzeResult(schema=_schema(kind.value))

    def eval(self, body: str | None, kind: str) -> Iterator[tuple]:
        if body is None:
            return
        names = [n for n, _ in COLUMNS[kind]]
        try:
            for k, found in enumerate(PARSERS[kind](body)):
                yield (k, *(found.get(n) for n in names), None)
        except FetchError as e:
            yield (0, *(None for _ in names), str(e))


class ReadAnswer:
    """The events of a model's answer: its list, or itself if it is one event; none of what is no JSON object."""

    @staticmethod
    def analyze(answer: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=StructType().add("ordinal", IntegerType()).add("is_event", BooleanType()).add("confidence", DoubleType()).add("title", StringType()).add("start_at", StringType()))

    def eval(self, answer: str | None) -> Iterator[tuple]:
        text = (answer or "").strip()
        if text.startswith("```"):
            text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
        try:
            said = json.loads(text)
        except ValueError:
            return
        listed = said.get("events") if isinstance(said, dict) else None
        events = listed if isinstance(listed, list) else [said] if isinstance(said, dict) and "is_event" in said else []
        for k, e in enumerate(events):
            if isinstance(e, dict):
                sure = e.get("confidence")
                yield (k, bool(e.get("is_event")), float(sure) if isinstance(sure, (int, float)) else 0.0, e.get("title"), e.get("start_at"))


def geocoder(search: Callable[[str], list[dict]]) -> type:
    """A table function of an injected geocoder: search(query) gives dicts with display_name, latitude, longitude."""

    class Geocode:
        def eval(self, query: str | None) -> Iterator[tuple]:
            for k, found in enumerate(search(query) if query else []):
                yield (k, found.get("display_name"), found.get("latitude"), found.get("longitude"))

    return udtf(Geocode, returnType="ordinal int, display_name string, latitude double, longitude double")


def register(spark: SparkSession) -> None:
    """Make read_document and read_answer known to a session's SQL."""
    prepare(spark)
    spark.udtf.register("read_document", udtf(ReadDocument))
    spark.udtf.register("read_answer", udtf(ReadAnswer))
