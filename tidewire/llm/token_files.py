"""Token-id output: fixed-width bit packing in shard files with block offsets.

A shard file holds the documents of one range of doc_id in ascending order:

    magic  "TWP2"          4 bytes
    bits, block, codes     3 x uint32   bits of an id, ids of a block, ids of the vocabulary
    docs, ids, blocks      3 x uint64
    doc_id                 docs x int64       (0 for null)
    null                   docs x uint8       (1 where doc_id is null)
    start                  docs x uint64      ids of the shard before the document
    offset                 (blocks + 1) x uint64  byte offsets of the blocks in the payload
    payload                each block packed on its own, lowest bit first, filled up to whole bytes

Ids take the fewest bits that hold the vocabulary. Any block unpacks alone (`unpack`), so any
document or range of ids can be read without the rest (`Shard.ids`).
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.runtime import materialise, prepare, scratch, table

from .tokens import encoder, vocab_size, vocabulary

MAGIC = b"TWP2"
HEAD_BYTES = 40
BLOCK_IDS = 4096
#: A shard file is closed at this many ids, so writing stays within bounded memory.
SHARD_IDS = 2_000_000
#: Blocks that are read from a file at once.
READ_BLOCKS = 64


def width(codes: int) -> int:
    """Fewest bits for ids 0 to codes - 1."""
    return max(1, (max(codes, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive numbers of that many bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """count ids from position first on, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    raw = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], parts: list[np.ndarray], codes: int, block: int = BLOCK_IDS) -> bytes:
    """One shard file of these documents."""
    bits = width(codes)
    lengths = np.array([len(p) for p in parts], np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<u8") if len(parts) else np.zeros(0, "<u8")
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >= codes:
        raise ValueError(f"id {int(ids.max())} is outside a vocabulary of {codes}")
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + np.array([bits, block, codes], "<u4").tobytes() + np.array([len(parts), len(ids), len(blocks)], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = bytes(d is None for d in doc_ids)
    return b"".join([head, keys.tobytes(), null, starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads a shard file: its head and index at once, its blocks as they are asked for."""

    def __init__(self, file: bytes | BinaryIO):
        self.file = io.BytesIO(file) if isinstance(file, bytes) else file
        head = self._bytes(0, HEAD_BYTES)
        if head[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block, self.codes = map(int, np.frombuffer(head, "<u4", 3, 4))
        docs, self.n, blocks = map(int, np.frombuffer(head, "<u8", 3, 16))
        index = self._bytes(HEAD_BYTES, 17 * docs + 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.null = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 17 * docs).astype(np.int64)
        self.payload = HEAD_BYTES + len(index)

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from a up to b; reads only the blocks that hold them."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, -(-b // self.block)
        raw = self._bytes(self.payload + int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        out = []
        for k in range(first, last):
            base, size = k * self.block, min(self.block, self.n - k * self.block)
            lo, hi = max(a, base) - base, min(b, base + size) - base
            own = raw[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]]
            out.append(unpack(own, hi, self.bits)[lo:])
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n)


def _store(folder: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under another name, then rename: a file is whole or absent, whichever attempt wrote it."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{base}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenize documents (doc_id, text; further columns are ignored) into shard files below folder.

    Rows are dealt by ranges of doc_id, equal and null ids further by their text's hash, and rows that
    agree in both by their place in the input, so no key gathers in one task; null ids come first, equal
    ids in the order of that hash. Null texts count as empty: such a document is end_id alone. Repeated
    rows are kept. An empty table writes no file.
    Returns the manifest: shard (ascending with doc_id), part, n_docs, n_ids, file.
    """
    prepare(docs.sparkSession)
    path, codes = vocabulary(tokenizer), vocab_size(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, enc, part = TaskContext.get().partitionId(), encoder(path), 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held, end = 0, np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal keys, parts, held, part
            name = f"shard-{at:06d}-{part:04d}.twp"
            _put(folder, name, shard_bytes(keys, parts, codes))
            row = pa.RecordBatch.from_pydict({"shard": [at], "part": [part], "n_docs": [len(keys)], "n_ids": [held], "file": [name]}, pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("file", pa.string())]))
            keys, parts, held, part = [], [], 0, part + 1
            return row

        for b in batches:
            got = enc.encode_all(b.column(1).to_pylist())
            for d, ids in zip(b.column(0).to_pylist(), got):
                if held and held + len(ids) >= shard_ids:
                    yield close()
                keys.append(d)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
        if keys:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie", F.monotonically_increasing_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("doc_id", "text").mapInArrow(shards, "shard long, part long, n_docs long, n_ids long, file string")


def bases(manifest: DataFrame) -> DataFrame:
    """file and base (ids of all files before it): sums within a shard, and over the shards, of which each writing task has one."""
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    within = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("within"))
    return within.join(before, "shard").select("file", (F.col("before") + F.col("within")).alias("base"))


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document of the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file is read some blocks at a time. A manifest without rows gives no rows.
    """
    spark = manifest.sparkSession
    prepare(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(*(c.to_pylist() for c in b.columns)):
                store, root = _store(folder)
                with store.open_input_file(f"{root}/{name}") as file:
                    s = Shard(file)
                    ends = np.append(s.starts[1:], s.n)
                    crcs = np.zeros(len(s.starts), np.int64)
                    ids, at = np.zeros(0, np.uint32), 0
                    for k, (a, z) in enumerate(zip(s.starts.tolist(), ends.tolist())):
                        if z > at + len(ids):  # the next run of whole documents, some blocks at a time
                            stop = max(z, min(s.n, a + READ_BLOCKS * s.block))
                            ids, at = s.ids(a, stop), a
                        crcs[k] = zlib.crc32(ids[a - at : z - at].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.null), pa.array(s.starts + base, pa.int64()), pa.array(ends - s.starts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bases(manifest).repartition(lanes, "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenize all documents into bit-packed files, read them back and report each document's ids."""
    folder = scratch(spark, "op1-files")
    manifest = materialise(write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder), "op1-manifest")
    return read(folder, manifest)
