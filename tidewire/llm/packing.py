"""Best-fit packing of token pieces into sequences by large-item matching.

The plan is made on counts per length, of which there are at most `capacity`, so its size does
not depend on the number of documents. Pieces over a third of the capacity go at most two to a
sequence: the longest is matched with the longest that still fits. Shorter ones then fill, longest
first, the tightest gap that takes them. Equal steps are taken for whole groups of sequences at
once. Pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.runtime import materialise, prepare, table

from .tokens import encoder, vocabulary

CAPACITY = 2048
#: So many rows in a row of the input may share a lane because they are equal.
LANE_ROWS = 1000


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, but for the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for counts[length] pieces of each length, and the number of sequences.

    Rows: length, first rank, number of pieces, first sequence, offset. The i-th piece of a row goes
    to sequence first + i at that offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rows: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    made = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room: (first sequence, how many)

    def put(length: int, first: int, many: int, offset: int) -> None:
        rows.append((length, rank[length], many, first, offset))
        rank[length] += many
        left[length] -= many

    def leave(room: int, first: int, many: int) -> None:
        if room:
            if room not in gaps:
                heapq.heappush(heap, room)
            gaps.setdefault(room, []).append((first, many))

    heap: list[int] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            fits = (m for m in large[bisect.bisect_left(large, n - capacity, key=lambda m: -m) :] if left[m] > (m == n) and m <= n)
            mate = next(fits, 0)
            many = left[n] if not mate else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, made, many, 0)
            if mate:
                put(mate, made, many, n)
            leave(capacity - n - mate, made, many)
            made += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        tight = sorted(room for room in gaps if room >= n)
        heap = tight  # a sorted list is a heap
        while left[n]:
            while heap and not gaps.get(heap[0]):
                gaps.pop(heapq.heappop(heap), None)
            if heap:
                room = heap[0]
                first, many = gaps[room].pop()
                take = min(many, left[n])
                if many > take:
                    gaps[room].append((first + take, many - take))
                put(n, first, take, capacity - room)
                if room - n >= n:
                    leave(room - n, first, take)
                elif room > n:
                    gaps.setdefault(room - n, []).append((first, take))
            else:
                take = -(-left[n] // (capacity // n))
                full = left[n] // (capacity // n)
                for k in range(capacity // n):
                    put(n, made, min(full, left[n]) if full else 0, k * n) if full else None
                if full:
                    if (room := capacity - capacity // n * n) > 0:
                        gaps.setdefault(room, []).append((made, full))
                    made += full
                rest = left[n]
                for k in range(rest):
                    put(n, made, 1, k * n)
                if rest:
                    gaps.setdefault(capacity - rest * n, []).append((made, 1))
                    made += 1
        gaps = {room: x for room, x in gaps.items() if x}
    return np.array(rows, np.int64).reshape(-1, 5), made


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    prepare(docs.sparkSession)
    path = vocabulary(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            keys, number, starts, lengths, crcs = [], [], [], [], []
            for d, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                raw = memoryview(ids.astype("<u4").tobytes() + end)
                for k, (s, n) in enumerate(pieces_of(len(ids) + 1, capacity)):
                    keys.append(d)
                    number.append(k)
                    starts.append(s)
                    lengths.append(n)
                    crcs.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, which have a length from 1 to capacity; other columns stay.

    The pieces are written once with the lane that each falls to, and read for the counts and the places.
    """
    spark = pieces.sparkSession
    prepare(spark)
    if clash := {"sequence_id", "offset", "tw_lane", "tw_rank"} & set(pieces.columns):
        pieces = pieces.drop(*clash)
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A lane is a share of a length's pieces: a length that holds a third of all pieces is ranked by many tasks,
    # and so are pieces that agree in everything, which their places in the input tell apart.
    lane = F.pmod(F.xxhash64(*pieces.columns, F.floor(F.monotonically_increasing_id() / LANE_ROWS)), F.lit(lanes))
    dealt = materialise(pieces.withColumn("tw_lane", lane), "op4-pieces")
    per_lane = materialise(dealt.groupBy("length", "tw_lane").agg(F.count("*").alias("tw_n")), "op4-lanes")
    counts = {int(r["length"]): int(r["n"]) for r in per_lane.groupBy("length").agg(F.sum("tw_n").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece is longer than the capacity or empty")
    rows, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("tw_lane").rowsBetween(Window.unboundedPreceding, -1)
    base = per_lane.select("length", "tw_lane", F.coalesce(F.sum("tw_n").over(before), F.lit(0)).alias("tw_base"))
    within = Window.partitionBy("length", "tw_lane").orderBy(*pieces.columns)
    ranked = dealt.withColumn("tw_rank", F.row_number().over(within) - 1).join(base.hint("merge"), ["length", "tw_lane"]).withColumn("tw_rank", F.col("tw_rank") + F.col("tw_base"))
    ranked = ranked.select(*pieces.columns, F.col("tw_rank").cast("long").alias("tw_rank"))
    order = np.lexsort((rows[:, 1], rows[:, 0])) if len(rows) else np.zeros(0, np.int64)
    rows = rows[order]
    key = (rows[:, 0] << 44) + rows[:, 1]
    shared = spark.sparkContext.broadcast((key, rows[:, 1], rows[:, 3], rows[:, 4]))  # a few thousand rows, whatever the corpus
    at = ranked.columns.index("length")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            n, r = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at, b.num_columns - 1))
            row = np.searchsorted(key, (n << 44) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[row] + r - first[row]), pa.array(offset[row])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(find, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    Null texts count as empty, so each document has at least its end token. Null and repeated ids are
    packed row by row. Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset;
    no rows for an empty table.
    """
    return place(token_pieces(docs, tokenizer, end_id, capacity), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (array of int); doc_id must be unique here."""
    prepare(docs.sparkSession)
    path = vocabulary(tokenizer)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            d = b.to_pydict()
            parts = []
            for full, s, n in zip(enc.encode_all(d["text"]), d["start"], d["length"]):
                parts.append(np.append(full, np.uint32(end_id))[s : s + n].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(d["sequence_id"], pa.int64()), pa.array(d["offset"], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    joined = placed.select("doc_id", "start", "length", "sequence_id", "offset").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    parts = joined.mapInArrow(ids, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
