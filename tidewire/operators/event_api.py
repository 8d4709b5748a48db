"""What readers ask of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns in a category's name and the theme that it gets; the first that fits counts.
THEMES = ((r"m[úu]sica|recital|concierto|festival", "music"), (r"gastronom|food|feria", "food"), (r"teatro|danza|arte|cultura", "arts"), (r"deporte|gimnasia|running|torneo", "sports"), (r"academ|charla|simposio|congreso", "talks"))
#: How an event's status is shown.
STATUS = {"ACTIVE": ("Activo", "success"), "UPDATED": ("Actualizado", "warning"), "CANCELLED": ("Cancelado", "danger"), "ARCHIVED": ("Archivado", "danger")}


def matching(events: DataFrame, date_from: Column | None = None, date_to: Column | None = None, category: str | None = None, query: str | None = None) -> DataFrame:
    """Active events in a span of starts, of a category, with a text in their titles whatever its case; empty texts ask nothing."""
    out = events.filter("status = 'ACTIVE'")
    if date_from is not None:
        out = out.filter(F.col("start_at") >= date_from)
    if date_to is not None:
        out = out.filter(F.col("start_at") <= date_to)
    if category:
        out = out.filter(F.col("category") == category)
    if query:
        out = out.filter(F.contains(F.upper("title"), F.upper(F.lit(query))))
    return out


def page(events: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page by start, ids breaking ties."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 events")
    return events.orderBy("start_at", "event_id").offset((number - 1) * size).limit(size)


def with_primary(events: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Add source_url and source_name of each event's primary link, or nulls; the first by time if there are several."""
    first = links.filter("is_primary").groupBy("event_id").agg(F.min_by(F.struct("source_url", "source_id"), F.struct("contributed_at", "source_url")).alias("p")).select("event_id", "p.*")
    named = first.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")
    return events.join(named.select("event_id", "source_url", "source_name"), "event_id", "left")


def detail_source(links: DataFrame) -> DataFrame:
    """One link per event: its primary one, else the earliest."""
    order = Window.partitionBy("event_id").orderBy(F.desc("is_primary"), "contributed_at", "source_url")
    return links.withColumn("tw_n", F.row_number().over(order)).filter("tw_n = 1").drop("tw_n")


def lookup(events: DataFrame, name: str) -> DataFrame:
    """The event with an id or a slug."""
    return events.filter((F.col("event_id") == name) | (F.col("slug") == name)).orderBy((F.col("event_id") == name).desc()).limit(1)


def categories(events: DataFrame) -> DataFrame:
    return events.filter("status = 'ACTIVE' and category is not null and category <> ''").select("category").distinct().orderBy("category")


def featured(rows: DataFrame) -> DataFrame:
    """The best event of a page; the first in its order wins ties."""
    return rows.orderBy(F.desc_nulls_last("quality_score"), "start_at", "event_id").limit(1)


def page_summary(total: Column, number: Column, size: Column) -> list[Column]:
    """pages, first and last position shown."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    return [pages.alias("pages"), F.when(total == 0, 0).otherwise((number - 1) * size + 1).cast("long").alias("first_shown"), F.least(total, number * size).cast("long").alias("last_shown")]


def theme(category: Column) -> Column:
    out = F.lit("default")
    for pattern, name in reversed(THEMES):
        out = F.when(category.rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def status_label(status: Column) -> tuple[Column, Column]:
    label = variant = F.lit(None).cast("string")
    for name, (text, kind) in STATUS.items():
        label, variant = F.when(status == name, text).otherwise(label), F.when(status == name, kind).otherwise(variant)
    return label, variant


def ready(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, ok) of stored tables: whether each answers with a row; a table that cannot be read fails the query."""
    rows = [t.limit(1).agg(F.lit(name).alias("name"), (F.count("*") > 0).alias("ok")) for name, t in tables.items()]
    return reduce(DataFrame.union, rows)
