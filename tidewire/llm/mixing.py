"""Mixing sources to target weights, with DataFrame operations only, by Pareto order sampling.

Every source gets a target of words, every document the copies that are expected of it. Whole copies are
certain; the rest is an inclusion probability p. Documents of a source are ranked by their random odds
u / (1 - u) over their inclusion odds p / (1 - p), and taken in this order until the source's words are
together: a sample of fixed size, in words, with unequal probabilities. Running sums over the order are
taken in ranges, so that no source is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.operators.ordering import PLACE_BITS, numbered
from tidewire.runtime import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, over and over (fixed values of the query).
CYCLE = (3, 1, 2)
#: Hexadecimal digits of a hash that make a random number; all are exact in a double.
DIGITS = 13


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources (source, source_size, weight, ...) with target: share of all sizes, dealt by weight, at most `most` times a source's size.

    What a source cannot take is dealt to the others by weight again, until no source is above its most.
    The words each unit of weight gets only ever grow, so a round needs nothing but the last one's figure.
    Null and negative weights count as 0; if only such sources are left, the rest of the share stays undealt.
    """
    weight, capacity = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.col("source_size").cast("double") * most
    per, capped = 0.0, -1
    while True:
        above = F.lit(per) * weight > capacity
        row = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(above, capacity).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(weight)).alias("open"),
            F.count_if(above).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        per, capped = (share * row["words"] - row["full"]) / row["open"], row["capped"]
    return sources.withColumn("target", F.when(F.lit(per) * weight > capacity, capacity).otherwise(F.lit(per) * weight))


def _copies(rows: DataFrame, most: int, preference: str | None) -> DataFrame:
    """rows with expected (copies): target over size of the source, or in proportion to a preference, `most` at most."""
    if preference is None:
        return rows.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wish = F.col("wish").cast("decimal(18,0)")
    per, capped = rows.groupBy("s").agg(F.lit(0.0).alias("per")), -1
    while True:
        above = F.col("per") * F.col("wish") > most
        got = rows.join(per, "s").groupBy("s").agg(
            F.first("target").alias("target"),
            F.sum(F.when(above, F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(wish * F.col("size"))).cast("double").alias("open"),
            F.count_if(above).alias("capped"),
            F.first("per").alias("was"),
        )
        got = materialise(got.select("s", F.when(F.col("open") > 0, (F.col("target") - F.col("full") * most) / F.col("open")).otherwise(F.col("was")).alias("per"), "capped"), "mix-level")
        now = got.agg(F.sum("capped")).first()[0]
        per = got.select("s", "per")
        if now is None or now == capped:
            return rows.join(per, "s").withColumn("expected", F.least(F.col("per") * F.col("wish"), F.lit(float(most)))).drop("per")
        capped = now


def mix(docs: DataFrame, weights: DataFrame | Sequence[int] = CYCLE, share: float = 1.5, most: int = 2, seed: int = 13, preference: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken, and the columns of carry.

    size is the number of words. weights is a table (source, weight), sources that are missing there weigh
    nothing; or numbers that the sources get in turn, in code point order, null last. target is what targets() says.
    A document is taken copies times, whole; taken = copies * size, at most `most` times its size. The words of a
    source differ from its target by half of one document at most, the one at which the sum passes it.
    preference names a column of whole numbers: expected copies within a source are in proportion to it (null: 0).

    The random number of a row is the sha256 of seed and doc_id, so reruns agree, whatever the partitions. Null texts
    have no words, null sources are one source, null ids draw as an empty id. Rows of one id share their draw and are
    ordered by a hash of their text; of rows that are equal throughout, any may be the one that is taken once more.
    Repeated rows are documents of their own, an empty table gives no rows, other columns are ignored.
    """
    wish = F.greatest(F.coalesce(F.col(preference).cast("long"), F.lit(0)), F.lit(0)) if preference else F.lit(1).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialise(docs.select("doc_id", F.col("source").alias("tw_source"), size.alias("size"), F.xxhash64("text").alias("tie"), wish.alias("wish"), F.monotonically_increasing_id().alias("place"), *[F.col(c).alias(f"tw_{k}") for k, c in enumerate(carry)]), "mix-rows")
    sources = numbered(rows.groupBy("tw_source").agg(F.sum("size").alias("source_size")), "mix-sources", F.col("tw_source").asc_nulls_last())
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("tw_name"), F.col("weight"))
        sources = sources.join(given, F.col("tw_source").eqNullSafe(F.col("tw_name")), "left").drop("tw_name")
    else:
        cycle = F.array(*[F.lit(w) for w in weights])
        sources = sources.withColumn("weight", F.get(cycle, F.col("number") % len(weights)))
    sources = targets(materialise(sources.withColumnRenamed("number", "s"), "mix-weights"), share, most)
    known = sources.select(F.col("tw_source").alias("tw_name"), "s", "source_size", "target")
    each = _copies(rows.join(known, F.col("tw_source").eqNullSafe(F.col("tw_name"))).drop("tw_name"), most, preference)

    whole = F.floor("expected")
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS)
    each = each.withColumns({"certain": whole, "p": F.col("expected") - whole, "u": u})
    rank = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))  # null: nothing left to draw
    order = [F.col("s"), F.col("rank").asc_nulls_last(), F.col("u"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")]
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = each.withColumn("rank", rank).drop("wish", "expected", "p").repartitionByRange(lanes, *order).sortWithinPartitions(*order)
    ranked = materialise(ranked.drop("u", "tie", "place").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", PLACE_BITS)), "mix-order")
    drawn = F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)
    ranges = ranked.groupBy("part", "s").agg(F.sum(drawn).alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    ranges = ranges.select("part", "s", (F.sum("words").over(Window.partitionBy("s").orderBy("part")) - F.col("words")).alias("before"), F.sum("sure").over(Window.partitionBy("s")).alias("sure"))
    upto = F.sum(drawn).over(Window.partitionBy("part", "s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = ranked.withColumn("within", upto - F.col("size")).join(ranges, ["part", "s"])
    left = F.col("target") - F.col("sure") - F.col("before") - F.col("within")  # words that the source still needs when the row's turn comes
    copies = F.col("certain") + F.when(F.col("rank").isNotNull() & (F.col("size") > 0) & (2 * left >= F.col("size")), 1).otherwise(0)
    found = found.withColumn("copies", copies.cast("long"))
    return found.select("doc_id", F.col("tw_source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"tw_{k}").alias(c) for k, c in enumerate(carry)])


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of docs as often as mix() with these settings takes it."""
    placed = materialise(docs.withColumn("tw_place", F.monotonically_increasing_id()), "mix-documents")
    often = mix(placed, carry=["tw_place"], **settings).select("tw_place", F.col("copies").alias("tw_copies")).filter("tw_copies > 0")
    return placed.join(often, "tw_place").withColumn("tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), "tw_copies"))).select(*docs.columns)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 3, 1, 2, repeating, and share one and a half times all words, twice their own at most."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP13_SQL = r"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               (CAST(CAST('0x' || substring(sha256('13:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
        FROM documents
    ),
    totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM docs GROUP BY source),
    weighed AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS w, sum(words) OVER () AS every FROM totals),
    steps AS (
        SELECT *, sum(2 * words) OVER o - 2 * words AS full_before, sum(w) OVER () - sum(w) OVER o + w AS open_weight, row_number() OVER o AS k
        FROM weighed WINDOW o AS (ORDER BY 2 * words / w, source ROWS UNBOUNDED PRECEDING)
    ),
    level AS (SELECT arg_min((1.5 * every - full_before) / open_weight, k) AS per FROM steps WHERE (1.5 * every - full_before) / open_weight * w <= 2 * words),
    goals AS (SELECT source, words, least(2 * words, coalesce(per, 0) * w) AS target FROM weighed, level),
    rates AS (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0 END AS rate FROM goals),
    ranked AS (
        SELECT doc_id, size, words, target, floor(rate) AS sure, rate - floor(rate) AS p,
               sum(size) OVER (PARTITION BY docs.source ORDER BY CASE WHEN rate > floor(rate) THEN u / (1 - u) / ((rate - floor(rate)) / (1 - rate + floor(rate))) END, u, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
        FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source
    ),
    chosen AS (SELECT *, CAST(sure + CASE WHEN p > 0 AND size > 0 AND 2 * (target - sure * words - before) >= size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranked)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(words AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM chosen"""
