"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame operations only.

Two lines within one edit have an equal variant after deleting at most one character of each. All
variants of all lines would be as many as the corpus has characters, so the same idea is used
coarsely first. Each line is cut into four blocks and every variant with one block deleted is
emitted as a hashed key; lines that share a key with another line are cut again, into about as many
blocks as a block has characters; and only in blocks whose surroundings are shared are variants
without single characters emitted and joined. No pair within the bound is lost: one edit falls into
one block of each cut.

Large expressions are written as array functions on purpose: unrolled, their generated code would be
too long for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import materialise, table

#: Lines shorter than this only lose exact repeats.
NEAR_CHARS = 20
BLOCKS = 4
#: Lengths within a band of this many share the places of their cuts.
BAND = 8
#: Shared keys up to this many are sent to all tasks (8 bytes each); more meet the lines by a shuffle.
BROADCAST_KEYS = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), pos, line and its 128 bits of hash (h1, h2) of every line."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def place() -> Column:
    """A line's place in the order of doc_id (nulls first), tie and pos, as one number, which Spark can take minima of by hashing."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    text = doc * F.lit(65536).cast("decimal(5,0)") + F.pmod("tie", F.lit(65536)).cast("decimal(5,0)")
    return (text * F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(37,0)") + F.col("pos").cast("decimal(10,0)")


def around(line: Column, n: Column, q: Column, start: Column, stop: Column) -> Column:
    """A hash of a line of n characters without the block from start to stop of q; what is beyond q belongs to the block."""
    return F.xxhash64(q, start, F.substring(line, F.lit(1), start), F.substring(line, n - q + stop + 1, q - stop))


def block_keys(line: Column, n: Column) -> Column:
    """Keys of a line without one of four blocks. The cuts are those of its band's least length; at the band's start also of the band before."""
    low = n - n % BAND
    bands = F.when(n % BAND == 0, F.array(low, low - BAND)).otherwise(F.array(low))

    def of_band(q: Column) -> Column:
        cut = lambda k: F.shiftright(q * k, 2)  # noqa: E731  quarters
        return F.array(*[around(line, n, q, cut(k), cut(k + 1)) for k in range(BLOCKS)])

    return F.flatten(F.transform(bands, of_band))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """One row per distinct line but the empty one: h1, h2, the order of its first row, and that row's doc_id, tie and pos."""
    seen = lines_of(docs).filter("line <> ''").select("h1", "h2", "doc_id", "tie", "pos", place().alias("at"))
    return seen.groupBy("h1", "h2").agg(F.min("at").alias("first"), *[F.min_by(c, "at").alias(c) for c in ("doc_id", "tie", "pos")])


def near_lines(docs: DataFrame) -> DataFrame:
    """Distinct lines that may have a neighbour: h1, h2, line."""
    lines = lines_of(docs).withColumn("n", F.length("line")).filter(F.col("n") >= NEAR_CHARS)
    keyed = lines.select("h1", "h2", "line", F.explode(block_keys(F.col("line"), F.col("n"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    shared = materialise(shared, "op6-keys")
    if shared.count() <= BROADCAST_KEYS:
        rows = keyed.join(F.broadcast(shared), "key", "left_semi")
    else:
        names = keyed.select("h1", "key").join(shared, "key", "left_semi").select("h1").distinct()
        rows = lines.join(names, "h1", "left_semi")
    return rows.groupBy("h1", "h2").agg(F.first("line").alias("line"))


def blocks_of(lines: DataFrame, shorter: int, kind: str) -> DataFrame:
    """Each line seen as one of q = n - shorter characters, cut into about sqrt(q) blocks: q, k, around and the block's text."""
    rows = lines.select("h1", "h2", "first", "line", F.length("line").alias("n"))
    rows = rows.withColumn("q", F.col("n") - shorter).withColumn("b", F.ceil(F.sqrt(F.col("n") - shorter)).cast("int"))
    line, n, q, b = (F.col(c) for c in ("line", "n", "q", "b"))

    def of_block(k: Column) -> Column:
        start, stop = (q * k / b).cast("int"), (q * (k + 1) / b).cast("int")
        return F.struct(k.alias("k"), around(line, n, q, start, stop).alias("around"), F.substring(line, start + 1, n - q + stop - start).alias("block"))

    cuts = F.transform(F.sequence(F.lit(0), b - 1), of_block)
    return rows.select("h1", "h2", "first", "q", F.lit(kind).alias("kind"), F.explode(cuts).alias("x")).select("h1", "h2", "first", "q", "kind", "x.*")


def later_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines within one edit of a line that comes first earlier."""
    near = materialise(near_lines(docs), "op6-near")
    lines = materialise(near.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "op6-candidates")
    # A line of q characters is met by others of q, and by longer ones of q + 1.
    cuts = materialise(blocks_of(lines, 0, "own").unionByName(blocks_of(lines, 1, "longer")), "op6-blocks")
    shared = cuts.groupBy("q", "k", "around").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").drop("a", "b")
    cuts = cuts.join(shared, ["q", "k", "around"], "left_semi")
    block = F.col("block")
    less = F.transform(F.filter(F.sequence(F.lit(0), F.length(block)), lambda i: i > 0), lambda i: F.struct(i.alias("i"), F.xxhash64("around", F.concat(F.substring(block, F.lit(1), i - 1), F.substring(block, i + 1, F.length(block)))).alias("v")))
    variants = cuts.select("h1", "h2", "first", "q", "k", "kind", F.explode(less).alias("x")).select("h1", "h2", "first", "q", "k", "kind", "x.i", "x.v")
    # One character replaced: the same character deleted leaves equal variants. All of a group are within the bound of its earliest.
    own = variants.filter("kind = 'own'")
    group = own.groupBy("q", "k", "i", "v").agg(F.count("*").alias("many"), F.min("first").alias("lead"), F.min_by("h1", "first").alias("e1"), F.min_by("h2", "first").alias("e2")).filter("many > 1")
    replaced = own.join(group, ["q", "k", "i", "v"]).filter("first > lead").select("h1", "h2", "e1", "e2")
    # One character added: a longer line's variant is a whole other line.
    whole = cuts.filter("kind = 'own'").select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("first").alias("w"), "q", "k", F.xxhash64("around", "block").alias("v"))
    met = variants.filter("kind = 'longer'").drop("i").join(whole, ["q", "k", "v"])
    later = F.col("first") > F.col("w")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    added = met.filter("first <> w").select(pick("h1", "w1").alias("h1"), pick("h2", "w2").alias("h2"), pick("w1", "h1").alias("e1"), pick("w2", "h2").alias("e2"))
    pairs = replaced.unionByName(added).distinct()
    text = lines.select("h1", "h2", "line")
    early = text.toDF("e1", "e2", "early")
    checked = pairs.join(text, ["h1", "h2"]).join(early, ["e1", "e2"]).filter(F.levenshtein("line", "early", 1) >= 0)
    return checked.select("h1", "h2").distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) without repeated lines; adds n_lines and n_kept, other columns stay.

    Lines are parted by \\n and ordered by doc_id (nulls first), then their place. A line goes if an
    earlier line is equal, or, from NEAR_CHARS characters on, within one inserted, deleted or replaced
    character of it, whether or not that earlier line stays. Empty lines always stay. Null texts count
    as empty and become so. Rows with the same doc_id and text are one document, and all stay with what
    it keeps; rows with one doc_id and different texts are ordered by their texts' hash. Input columns
    named n_lines or n_kept are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_kept", "tw_tie", "tw_keep")
    parts = docs.select("doc_id", "text")
    distinct = materialise(distinct_lines(parts), "op6-lines")
    stay = distinct.join(later_lines(parts, distinct), ["h1", "h2"], "left_anti")
    kept = stay.groupBy(F.col("doc_id").alias("tw_id"), F.col("tie").alias("tw_tie")).agg(F.collect_list("pos").alias("tw_keep"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    joined = rows.join(kept, rows.doc_id.eqNullSafe(kept.tw_id) & (F.xxhash64(rows.text) == kept.tw_tie), "left")
    lines = F.split("text", "\n")
    blank = F.filter(F.transform(lines, lambda line, i: F.when(line == "", i)), lambda i: i.isNotNull())
    places = F.sort_array(F.concat(F.coalesce("tw_keep", F.array().cast("array<int>")), blank))
    joined = joined.withColumn("tw_lines", lines).withColumn("tw_places", places).withColumn("n_lines", F.size("tw_lines").cast("long")).withColumn("n_kept", F.size("tw_places").cast("long"))
    joined = joined.withColumn("text", F.array_join(F.transform("tw_places", lambda i: F.get(F.col("tw_lines"), i)), "\n"))
    return joined.select(*docs.columns, "n_lines", "n_kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop repeated and nearly repeated lines from all documents."""
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))
