"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become words joined by single spaces, as bytes. A window of benchmark words is the pattern
" w1 w2 ... wn ". A shift table over blocks of bytes tells how far the search may skip; where it says
zero, the block's hash selects a bucket of patterns, and comparing bytes confirms. The search moves
cursors over many segments of the text at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import prepare, table

WINDOW = 10
BLOCK = 8
TABLE_BITS = 18
SEGMENT = 4096
CHUNK_BYTES = 4 << 20
#: Benchmark text (bytes) searched in one pass; a larger benchmark is searched in several.
PASS_BYTES = 4 << 20
#: Patterns are searched in classes of least lengths, so that a short item does not shorten all skips.
CLASSES = (3, 12, 40)

ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "tw_ranges", "tw_names"]

FOLD = np.full(256, 32, np.uint8)  # anything but word bytes becomes a space
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    FOLD[_b] = _b + 32


def fold(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as one array: each text is "\\0 w1 w2 "; and where each text begins."""
    out = np.zeros(sum(map(len, texts)) + 3 * len(texts) + 8, np.uint8)
    at = 0
    for t in texts:
        out[at + 1] = 32
        out[at + 2 : at + 2 + len(t)] = FOLD[np.frombuffer(t, np.uint8)]
        out[at + 2 + len(t)] = 32
        at += len(t) + 3
    space = out[:at] == 32
    keep = np.ones(at, bool)
    keep[1:] = ~(space[1:] & space[:-1])
    buf = out[:at][keep]
    return buf, np.flatnonzero(buf == 0)


def windows(text: bytes, size: int) -> set[bytes]:
    """The patterns of an item: its windows, or all its words if they are fewer."""
    words = fold([text])[0].tobytes()[1:].split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


def _loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ndarray((len(buf) + 8,), "<u8", padded.tobytes(), strides=(1,))


class WuManber:
    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] + bytes(16) for p in patterns), np.uint8).reshape(len(patterns), self.m + 16)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int64)
        for j in range(self.m - self.block + 1):
            v = np.ascontiguousarray(heads[:, j : j + 8]).view("<u8").ravel() & self.mask
            np.minimum.at(self.shift, self.slot(v), self.m - self.block - j)
        suffix = np.ascontiguousarray(heads[:, self.m - self.block : self.m - self.block + 8]).view("<u8").ravel() & self.mask
        order = np.argsort(suffix, kind="stable")
        self.ids = order
        self.keys, first = np.unique(suffix[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.prefix = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel() & self.mask
        self.patterns = patterns

    @staticmethod
    def slot(v: np.ndarray) -> np.ndarray:
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence."""
        none = np.zeros(0, np.int64)
        last = len(buf) - self.m
        if last < 0:
            return none, none
        at8 = _loads(buf)
        pos = np.arange(0, last + 1, SEGMENT)
        stop = np.minimum(pos + SEGMENT, last + 1)
        found = []
        while len(pos):
            step = self.shift[self.slot(at8[pos + (self.m - self.block)] & self.mask)]
            if not step.all():
                found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            if not on.all():
                pos, stop = pos[on], stop[on]
        if not found:
            return none, none
        pos = np.concatenate(found)
        suffix = at8[pos + (self.m - self.block)] & self.mask
        k = np.minimum(np.searchsorted(self.keys, suffix), len(self.keys) - 1)
        hit = self.keys[k] == suffix
        pos, k = pos[hit], k[hit]
        many = self.ends[k + 1] - self.ends[k]
        begin = np.repeat(self.ends[k] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(k) else none, many)
        pat = self.ids[begin + np.arange(len(begin))]
        pos = np.repeat(pos, many)
        hit = (at8[pos] & self.mask) == self.prefix[pat]
        pos, pat = pos[hit], pat[hit]
        raw, same = buf.tobytes(), []
        for p, q in zip(pos.tolist(), pat.tolist()):
            x = self.patterns[q]
            same.append(raw[p : p + len(x)] == x)
        same = np.array(same, bool)
        return pos[same], pat[same]


class Matcher:
    """Patterns with the items that they come from, searched in classes of length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        of: dict[bytes, list[str]] = {}
        for name, text in items:
            for p in windows(text, size):
                of.setdefault(p, []).append(name)
        self.classes = []
        for lo, hi in zip(CLASSES, [*CLASSES[1:], 1 << 60]):
            if some := [p for p in of if lo <= len(p) < hi]:
                self.classes.append((WuManber(some), [of[p] for p in some], np.array([p.count(b" ") - 1 for p in some])))

    def search(self, texts: list[bytes], known: list[np.ndarray]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Per text: number of words, hit ranges of words (with the known ones), names of the items that occur."""
        buf, begins = fold(texts)
        starts = np.flatnonzero((buf[:-1] == 32) & (buf[1:] != 0)) if len(buf) else np.zeros(0, np.int64)
        if len(buf) and len(starts) and starts[-1] == len(buf) - 1:
            starts = starts[:-1]
        first = np.searchsorted(starts, begins)
        count = np.diff(np.append(first, len(starts)))
        ranges: list[list[np.ndarray]] = [[r] if len(r) else [] for r in known]
        names: list[set[str]] = [set() for _ in texts]
        for wm, items, words in self.classes:
            pos, pat = wm.find(buf)
            if not len(pos):
                continue
            doc = np.searchsorted(begins, pos, side="right") - 1
            w = np.searchsorted(starts, pos) - first[doc]
            order = np.argsort(doc, kind="stable")
            doc, w, pat = doc[order], w[order], pat[order]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for part in np.split(np.arange(len(doc)), cuts):
                d = int(doc[part[0]])
                ranges[d].append(np.stack([w[part], w[part] + words[pat[part]]], 1))
                for q in np.unique(pat[part]).tolist():
                    names[d].update(items[q])
        return [(int(n), union(r), s) for n, r, s in zip(count, ranges, names)]


def union(parts: list[np.ndarray]) -> np.ndarray:
    """Ranges [from, to) without overlaps, in order."""
    if not parts:
        return np.zeros((0, 2), np.int64)
    r = np.concatenate(parts)
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
    return np.stack([r[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)]], 1)


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to documents (doc_id, text).

    benchmark has item_id and text. A null or empty text has no words: it is clean, or no window. Other
    columns stay; input columns of these names are replaced. Repeated rows and ids are judged row by row.
    An empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*ADDED)
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // pass_bytes))
    rows = docs.select(*docs.columns, F.lit(None).cast("binary").alias("tw_ranges"), F.lit(None).cast("array<string>").alias("tw_names"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    at = docs.columns.index("text")

    def one(held, rows: DataFrame, more: bool) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, size)
            for b in batches:
                done = []
                texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
                known = [np.zeros((0, 2), np.int64) if r is None else np.frombuffer(r, np.int64).reshape(-1, 2) for r in b.column(b.num_columns - 2).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, bytes_ = lo + 1, len(texts[lo])
                    while hi < len(texts) and bytes_ + len(texts[hi]) <= CHUNK_BYTES:
                        bytes_ += len(texts[hi])
                        hi += 1
                    done += matcher.search(texts[lo:hi], known[lo:hi])
                    lo = hi
                names = [s | set(n or ()) for (_, _, s), n in zip(done, b.column(b.num_columns - 1).to_pylist())]
                if more:
                    extra = [pa.array([r.astype(np.int64).tobytes() for _, r, _ in done], pa.binary()), pa.array([sorted(s) for s in names], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], *extra], names=b.schema.names)
                    continue
                hits = [int((r[:, 1] - r[:, 0]).sum()) for _, r, _ in done]
                digests = [hashlib.sha256(",".join(sorted(s, key=lambda x: x.encode())).encode()).hexdigest() for s in names]
                extra = [pa.array([n for n, _, _ in done], pa.int64()), pa.array(hits, pa.int64()), pa.array(list(map(len, names)), pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *extra], names=[*b.schema.names[:-2], *ADDED[:5]])

        form = f"{kinds}, tw_ranges binary, tw_names array<string>" if more else f"{kinds}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        return rows.mapInArrow(search, form)

    for k in range(passes):  # each pass holds about pass_bytes of benchmark text, and hands on what it found
        part = [(r["name"], bytes(r["text"])) for r in items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == k).collect()]
        rows = one(spark.sparkContext.broadcast(part), rows, k < passes - 1)
    return rows


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search all documents for windows of ten words of all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
