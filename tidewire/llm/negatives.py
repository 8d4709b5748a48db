"""Hard-negative mining by exact inner products, with candidates in buckets of like norm.

Candidates are dealt over lanes at random and sorted by norm within a lane, longest first; runs of them
are buckets. Anchors are the query set: they are broadcast in blocks of a bounded size, and each block meets
every lane. No inner product exceeds the product of the norms (Cauchy-Schwarz), so a bucket is left out for
every window whose lower limit, or whose k-th best score so far, lies above that. The first
sweep finds positives; their scores make the windows of the second, which finds negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.runtime import materialise, prepare, scratch, table

#: Bytes of the anchors' vectors that are broadcast at once, and of the candidates' that make a bucket.
BLOCK_BYTES, BUCKET_BYTES = 1 << 19, 1 << 19
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Norms up to which sums of products are exact in doubles; longer vectors are multiplied as whole numbers.
EXACT = float(1 << 52)
MOST_LONG, LEAST_LONG = (1 << 63) - 1, -(1 << 63)
NONE = -np.inf


def whole_vectors(vectors: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    good = vectors.isNotNull() & F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # A double keeps what floor() to a long would cut off.
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    return F.when(good, F.transform(vectors, lambda x: floor(x.cast("double") * scale)))


class Bucket:
    """Candidates of one dimension, in the order of ids, and their greatest norm."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.lexsort((places, ids))
        self.ids, self.places, self.labels, self.vectors = ids[order], places[order], labels[order], vectors[order]
        self.norm = float(norms.max())


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of a and b, as doubles, or as Python's whole numbers where doubles might round."""
    if exact:
        return a @ b.T
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T


class Windows:
    """The best k scores of each window [low, high] over an anchor, from candidates of its label or of others.

    Scores are doubles while all products are exact, else whole numbers in object arrays; ties go to smaller ids.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, exact: bool):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.score = np.full((len(anchor), k), NONE, float if exact else object)
        self.id = np.zeros((len(anchor), k), np.int64)
        self.compared = self.skipped = 0

    def needs(self, bound: np.ndarray) -> np.ndarray:
        """Windows for which a bucket with these bounds (by anchor) may hold something."""
        b = bound[self.anchor]
        return np.flatnonzero((b >= self.low) & (b >= self.score[:, -1]))

    def offer(self, rows: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores (window, candidate) of some windows; candidates come by ascending id."""
        last = self.score[rows, -1][:, None]
        held = np.where(fits & (scores >= self.low[rows][:, None]) & (scores <= self.high[rows][:, None]) & (scores >= last), scores, NONE)
        at = np.arange(len(rows))
        best, names = [self.score[rows]], [self.id[rows]]
        for _ in range(self.k):
            top = held.argmax(axis=1)  # the first of equals has the smallest id
            best.append(held[at, top][:, None])
            names.append(ids[top][:, None])
            held[at, top] = NONE
        best, names = np.concatenate(best, axis=1), np.concatenate(names, axis=1)
        for r, b, n in zip(rows.tolist(), best, names) if best.dtype == object else ():
            order = sorted(range(len(b)), key=lambda j: (b[j] == NONE, -b[j] if b[j] != NONE else 0, n[j]))[: self.k]
            self.score[r], self.id[r] = b[order], n[order]
        if best.dtype != object:
            order = np.lexsort((names, -best), axis=1)[:, : self.k]
            self.score[rows], self.id[rows] = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Runs of rows (vec_id, place, label, norm, dim, q) of one dimension, of about BUCKET_BYTES."""
    held: list[tuple] = []
    size, dim = 0, -1

    def close() -> Bucket:
        nonlocal held, size
        out = Bucket(*(np.concatenate(x) for x in zip(*held)))
        held, size = [], 0
        return out

    for b in batches:
        ids, places, labels, norms, dims = (b.column(k).to_numpy() for k in range(5))
        flat = b.column(5).flatten().to_numpy()
        ends = np.cumsum(dims)
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
        for a, z in zip(cuts, cuts[1:]):
            while a < z:
                if held and (dims[a] != dim or size >= BUCKET_BYTES):
                    yield close()
                dim = int(dims[a])
                to = min(z, a + max(1, (BUCKET_BYTES - size) // (8 * max(dim, 1))))
                start = int(ends[a]) - dim
                held.append((ids[a:to], places[a:to], labels[a:to], flat[start : start + (to - a) * dim].reshape(to - a, dim), norms[a:to]))
                size += 8 * max(dim, 1) * (to - a)
                a = to
    if held:
        yield close()


def search(found: Iterator[Bucket], vectors: np.ndarray, norms: np.ndarray, labels: np.ndarray, places: np.ndarray, windows: Windows, same: bool, exact: bool) -> None:
    """Offer every bucket to the windows that it may matter to."""
    dim = vectors.shape[1]
    for b in found:
        shared = min(dim, b.vectors.shape[1])  # what the longer vector has beyond the shorter counts as 0
        with np.errstate(invalid="ignore"):  # 0 times a norm beyond doubles bounds nothing
            bound = np.nan_to_num(norms * b.norm * (1 + 1e-9) + 1e-6, nan=np.inf, posinf=np.inf)
        rows = windows.needs(bound)
        windows.skipped += len(windows.anchor) - len(rows)
        step = max(1, CELLS // len(b.ids))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            some = some[np.isin(some, windows.needs(bound))]
            own, where = np.unique(windows.anchor[some], return_inverse=True)
            if not len(own):
                continue
            scores = products(vectors[own, :shared], b.vectors[:, :shared], exact)
            alike = labels[own][:, None] == b.labels[None, :]
            fits = alike & (places[own][:, None] != b.places[None, :]) if same else ~alike
            windows.offer(some, scores[where], fits[where], b.ids)
            windows.compared += len(some)


def _sweep(candidates: DataFrame, anchors: dict, windows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int, same: bool, exact: bool) -> DataFrame:
    """(place, window, score, id): the best k of each lane for a block of anchors; windows: anchor's number, limits, name."""
    sc = candidates.sparkSession.sparkContext
    sent = sc.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (block, (anchor, low, high, name)) = sent.value
        w = Windows(anchor, low, high, k, exact)
        search(buckets(batches), block["vectors"], block["norms"], block["labels"], block["places"], w, same, exact)
        at, j = np.nonzero(w.score != NONE)
        scores = [max(LEAST_LONG, min(MOST_LONG, int(x))) for x in w.score[at, j]]
        for a in range(0, len(at), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(block["places"][anchor[at[part]]]), pa.array(name[at[part]]), pa.array(scores[part], pa.int64()), pa.array(w.id[at[part], j[part]])], names=["place", "window", "score", "id"])

    return candidates.select("vec_id", "place", "label", "norm", "dim", "q").mapInArrow(run, "place long, window long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each window over all lanes, a few rows for each lane."""
    rank = F.row_number().over(Window.partitionBy("place", "window").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of vectors (vec_id, label, q: whole numbers as doubles): anchor_id, anchor_place, positive_id, positive_place, rank, negative_id, positive_score, negative_score.

    Rows where the condition `anchor` holds are anchors. An anchor's positives are its first other rows of the same
    label; for each of them, negatives are the first rows of another label whose score lies between low and
    high hundredths of the positive's. Higher inner products come first, ties by smaller vec_id. All is exact: sums of
    whole numbers that doubles would round are taken as Python's numbers (a score beyond a long is returned as
    the nearest long, and the windows go by that).

    Rows with a null vec_id, label or q take no part (q is null if a component is); labels are cast to long. Of
    vectors of two lengths the shorter counts as filled with zeros; empty vectors score 0. Every row of a repeated
    vec_id is an anchor and a candidate of its own. positive_rank counts an anchor's positives, whose ids may repeat.
    Other columns are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "q", anchor.alias("is_anchor")).filter("vec_id is not null and label is not null and q is not null")
    rows = rows.withColumns({"place": F.monotonically_increasing_id(), "norm": norm, "dim": F.size("q")})
    rows = materialise(rows, "negatives-rows")
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = materialise(rows.drop("is_anchor").repartition(lanes, "place").sortWithinPartitions("dim", F.col("norm").desc()), "negatives-lanes")
    asked = rows.filter("is_anchor")
    seen = asked.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    longest = rows.agg(F.max("norm")).first()[0]
    exact = longest is None or longest * longest < EXACT
    parts = -(-seen["n"] * max(1, seen["dim"] or 1) * 8 // BLOCK_BYTES)
    schema = "anchor_id long, anchor_place long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(parts))), "negatives-anchors")

    def block(k: int) -> dict:
        """One block of anchors, of about BLOCK_BYTES; shorter vectors are filled with zeros."""
        got = asked.filter(F.col("block") == k).select("place", "label", "norm", "q").orderBy("place").collect()
        full = np.zeros((len(got), max((len(r["q"]) for r in got), default=0)))
        for row, r in zip(full, got):
            row[: len(r["q"])] = r["q"]
        return {"vectors": full, **{c: np.array([r[x] for r in got], t) for c, x, t in (("places", "place", np.int64), ("labels", "label", np.int64), ("norms", "norm", float))}}

    folder, ends = scratch(spark, "negatives-found"), "place long, window long, score long, id long, rank int"

    def store(found: DataFrame, kind: str, k: int) -> DataFrame:
        """A block's results, beside those of the others."""
        path = f"{folder}/{kind}/block={k}"
        found.write.parquet(path)
        return spark.read.schema(ends).parquet(path)

    for k in range(parts):
        anchors = block(k)
        n = len(anchors["places"])
        if not n:
            continue
        open_ = (np.arange(n), np.full(n, NONE), np.full(n, np.inf), np.zeros(n, np.int64))
        best = store(_best(_sweep(candidates, anchors, open_, positives, True, exact), positives), "positives", k)
        # Windows of one anchor with the same positive score are the same window.
        scores = best.select("place", "score").distinct().collect()
        place = np.array([r["place"] for r in scores], np.int64)
        score = [r["score"] for r in scores]
        limits = [(-(-low * s // 100), high * s // 100) for s in score]
        keep = [j for j, (a, z) in enumerate(limits) if a <= z]
        kind = float if exact else object
        windows = (np.searchsorted(anchors["places"], place[keep]), np.array([limits[j][0] for j in keep], kind), np.array([limits[j][1] for j in keep], kind), np.array([score[j] for j in keep], np.int64))
        store(_best(_sweep(candidates, anchors, windows, negatives, False, exact), negatives), "negatives", k)
    every = lambda kind: spark.read.schema(ends).parquet(f"{folder}/{kind}")
    found = every("negatives").select("place", F.col("window").alias("positive_score"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = every("positives").select("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank"))
    names = asked.select("place", F.col("vec_id").alias("anchor_id"))
    return pairs.join(found, ["place", "positive_score"]).join(names, "place").select("anchor_id", F.col("place").alias("anchor_place"), "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all; where vec_id is divisible by 7, labels move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(rows.select("vec_id", label.alias("label"), whole_vectors(F.col("embedding")).alias("q")), F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
    WITH vecs AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
        FROM vecs a JOIN vecs c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
    ),
    positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    ranked AS (
        SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, n.other AS negative_id, n.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
        FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
