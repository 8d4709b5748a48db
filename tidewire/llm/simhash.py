"""SimHash near-duplicates: fingerprints, vantage-point trees, connected components.

Fingerprints of up to `radius` differing bits are linked. The 64 bits are cut into radius + 1 blocks,
so two linked fingerprints agree on at least one whole block: for each block, fingerprints at masked
distance zero make a shard. As many bits of a block count as make shards of about SHARD fingerprints.
Inside a shard a vantage-point tree splits at the median distance; of the points on its two sides only
those are compared whose distances to the vantage point the triangle inequality lets be near. A shard
that is far too large, because its fingerprints resemble each other, is dealt again by all its bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import materialise, prepare, table

from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Points that a shard holds on average, points of a tree's leaf, points from which a shard is dealt again.
SHARD, LEAF, MOST = 1024, 24, 50_000
#: Pairs compared at once.
PAIRS = 1 << 20
#: Words hashed at once.
PART_WORDS = 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b" \t\n\x0b\x0c\r"


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits that are set in over half the hashes of a text's shingles; 0 without words."""
    import xxhash

    words = text.translate(LOWER).split()  # bytes.split parts at exactly the SPACES
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, PART_WORDS):
        some = words[a : a + PART_WORDS + size - 1]
        if len(words) < size:
            shingles = [b" ".join(some)]
        else:
            line = b" ".join(some)
            ends = np.cumsum([len(w) + 1 for w in some]) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            k = len(some) - size + 1
            shingles = [line[i:j] for i, j in zip(begins[:k].tolist(), ends[size - 1 :].tolist())]
        hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Add fp (long, the 64 bits as a signed number) to documents and drop their texts."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            out = []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                t = t or b""
                if t not in seen:
                    seen[t] = fingerprint(t, size, seed)
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), pa.array(np.array(out, np.uint64).view(np.int64))], names=[*rest, "fp"])

    kinds = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(hash_all, f"{kinds}fp long")


def masks(radius: int, n: int, bits: int = 64, shard: int = SHARD) -> list[int]:
    """Masks on at least one of which two fingerprints within the radius agree: a part of each of radius + 1 blocks.

    Of a block so many bits are taken that n even fingerprints make shards of about `shard`, all if need be.
    """
    cuts = [bits * k // (radius + 1) for k in range(radius + 2)]
    wanted = max(1, (max(n, 1) // shard).bit_length())
    return [((1 << min(wanted, z - a)) - 1) << a for a, z in zip(cuts, cuts[1:])]


def finer(mask: int, radius: int, bits: int = 64) -> list[int]:
    """Masks that hold a given one, on at least one of which two fingerprints agree that agree on it and are linked."""
    free = [k for k in range(bits) if not mask >> k & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << k for k in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_shard(points: np.ndarray, radius: int, forest: Forest, leaf: int = LEAF) -> int:
    """Join all positions of points within the radius: a vantage-point tree joined with itself. Returns its splits."""

    def join(i: np.ndarray, j: np.ndarray) -> None:
        near = np.flatnonzero(distance(points[i], points[j]) <= radius)
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            forest.join(x, y)

    def pairs(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Compare a[k] with b[lo[k]] up to b[hi[k]], some pairs at a time."""
        many = np.maximum(0, hi - lo)
        upto = np.cumsum(many)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            m = many[at:to]
            before = np.cumsum(m) - m
            join(np.repeat(a[at:to], m), b[np.repeat(lo[at:to] - before, m) + np.arange(int(m.sum()))])
            at = to

    def across(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray) -> None:
        """Pairs of one point each: their distances to the vantage point differ by the radius at most."""
        order = np.argsort(db, kind="stable")
        db = db[order]
        pairs(a, b[order], np.searchsorted(db, da - radius), np.searchsorted(db, da + radius, side="right"))

    splits = 0
    todo = [np.arange(len(points))] if len(points) else []
    while todo:
        ids = todo.pop()
        if len(ids) <= leaf:
            k = np.arange(len(ids))
            pairs(ids, ids, k + 1, np.full(len(ids), len(ids)))
            continue
        splits += 1
        d = distance(points[ids], points[ids[0]]).astype(np.int64)
        near = d <= radius
        for y in ids[near].tolist():  # all of these are linked to the vantage point, and so to each other
            forest.join(int(ids[0]), y)
        # What lies around the ball may link to any point of it.
        across(ids[near], d[near], ids[~near], d[~near])
        rest, dr = ids[~near], d[~near]
        inner = dr <= int(np.median(dr)) if len(dr) else np.zeros(0, bool)
        if inner.all():  # half of them or more are equally far
            inner = dr < dr.max() if len(dr) and dr.min() < dr.max() else np.arange(len(rest)) * 2 < len(rest)
        across(rest[inner], dr[inner], rest[~inner], dr[~inner])
        todo += [x for x in (rest[inner], rest[~inner]) if len(x) > 1]
    return splits


def dealt_by(prints: DataFrame, keys: list[int]) -> DataFrame:
    """(fp, mask, part): each fingerprint once for each mask, with the bits that the mask keeps."""
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    every = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for m in signed])
    return prints.select("fp", F.explode(every).alias("shard")).select("fp", "shard.mask", "shard.part")


def shards(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """(fp, mask, part) of distinct fingerprints: any two within the radius share a mask and part.

    A shard of over `most` is replaced by finer ones; those agree on a fifth of their other bits also.
    """
    keys = masks(radius, prints.count(), shard=shard)
    dealt = dealt_by(prints, keys)
    sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("mask", "part")
    sizes = materialise(sizes, "op8-large")
    if not sizes.take(1):
        return dealt
    small = dealt.join(sizes, ["mask", "part"], "left_anti")
    large = dealt.join(sizes, ["mask", "part"], "left_semi")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = [dealt_by(large.filter(F.col("mask") == signed(m)), finer(m, radius)) for m in keys]
    return reduce(DataFrame.union, parts, small.select("fp", "mask", "part"))


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest of each shard's exact pairs."""
    spark = prints.sparkSession
    prepare(spark)
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards(prints, radius, shard, most).repartition(lanes, "mask", "part").sortWithinPartitions("mask", "part")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple | None = None

        def done() -> pa.RecordBatch:
            points = np.unique(np.concatenate(held))
            forest = Forest(len(points))
            link_shard(points, radius, forest)
            root = np.array([forest.find(k) for k in range(len(points))], np.int64)
            own = np.flatnonzero(root != np.arange(len(points)))
            return pa.RecordBatch.from_arrays([pa.array(points[own].view(np.int64)), pa.array(points[root[own]].view(np.int64))], names=["a", "b"])

        def small(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            """Shards of two points: compared all at once."""
            a, b = fp[starts], fp[starts + 1]
            on = (distance(a, b) <= radius) & (a != b)
            return pa.RecordBatch.from_arrays([pa.array(a[on].view(np.int64)), pa.array(b[on].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy().view(np.uint64)
            mask, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.append(cut, len(fp))
            key = (int(mask[0]), int(part[0]))
            if held and key != last:
                yield done()
                held = []
            for k in (0, len(starts) - 1):  # the first and the last shard may go on in another batch
                if k == 0 or len(starts) > 1:
                    if k and held:
                        yield done()
                        held = []
                    held.append(fp[starts[k] : ends[k]])
            last = (int(mask[-1]), int(part[-1]))
            if len(starts) > 2:
                s, e = starts[1:-1], ends[1:-1]
                two = e - s == 2
                yield small(fp, s[two], e[two])
                for i, j in zip(s[e - s > 2].tolist(), e[e - s > 2].tolist()):
                    keep, held = held, [fp[i:j]]
                    yield done()
                    held = keep
        if held:
            yield done()

    return dealt.mapInArrow(link, "a long, b long")


def roots(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and root (one fingerprint for each component) of every distinct fingerprint of a written table."""
    distinct = materialise(prints.select("fp").distinct(), "op8-distinct")
    found = components(near_links(distinct, radius), "op8-components")
    return materialise(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "op8-roots")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of documents (doc_id, text); other columns are ignored.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are hashed
    whole, some words at a time. Null ids never name a component unless all its ids are null. Repeated
    rows are kept; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialise(fingerprints(rows, size, seed), "op8-prints")
    of = roots(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = of.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    found = prints.join(of.join(named, "root").select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest doc_id, null ids last, with the columns of docs.

    Rows with equal ids are told apart by their texts (128 bits of hash); of rows that agree in id and
    text one stays. Null and empty texts are near duplicates of each other. An empty table gives no rows.
    All input columns stay.
    """
    names = ["tw_a", "tw_b"]
    while set(names) & set(docs.columns):
        names = [f"{n}_" for n in names]
    key = [F.xxhash64(F.lit(k), F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias(n) for k, n in enumerate(names)]
    keyed = docs.select("*", *key)
    prints = materialise(fingerprints(keyed.select(*[F.col(n).alias(x) for n, x in zip(names, "ab")], "doc_id", "text"), size, seed), "op8-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "a", "b")).alias("first")
    stay = prints.groupBy("fp").agg(first).join(roots(prints, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = keyed.join(stay.select(F.col("first.a").alias(names[0]), F.col("first.b").alias(names[1])), names, "left_semi")
    if prints.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").take(1):
        kept = kept.dropDuplicates(names)
    return kept.select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint all documents and name each one's component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
