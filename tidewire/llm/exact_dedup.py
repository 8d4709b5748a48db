"""Exact dedup by owners in Patricia tries.

Rows are partitioned by length and content hash; each partition inserts whole byte strings into a
compressed radix trie, whose terminal nodes hold the owner of a text and its number of rows. Every
input partition first inserts what it reads into a small trie of its own, so a text that a third of
all rows hold reaches its partition as one row per task.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import materialise, prepare, table

from .columns import aside

ADDED = ["keep_id", "group_size", "kept", "text_sha256", "tw_bytes", "tw_ties", "tw_row", "tw_first"]
#: Bytes of keys and nodes that a trie holds before it spills a subtree (or, before the shuffle, is emptied).
TRIE_BYTES = 48 << 20
NODE_BYTES = 400
OUT_ROWS = 500
#: (owner's id, rows that have this id, rows of the text); the owner is None where all ids are null.
Owner = tuple[int | None, int, int]


def merge(a: Owner | None, b: Owner, largest: bool) -> Owner:
    if a is None:
        return b
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    first = a[0] is not None and (b[0] is None or (a[0] > b[0]) == largest)
    return (*(a if first else b)[:2], a[2] + b[2])


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while lo + 1 < hi:  # a and b agree up to lo, and differ before hi
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo if a[lo] != b[lo] else lo + 1


class Node:
    __slots__ = ("label", "kids", "owner", "size")

    def __init__(self, label: bytes, owner: Owner | None):
        self.label, self.owner = label, owner
        self.kids: dict[int, Node | Spilled] = {}
        self.size = len(label) + NODE_BYTES


def spill_folder() -> str | None:
    """Where Spark lets this task spill: its own local folders; the task that is done again spills again."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.access(d, os.W_OK)]
    return folders[0] if folders else None


class Spilled:
    """A subtree on disk: records of (rest of the key, owner) below one edge of the root."""

    def __init__(self, label: bytes):
        self.label, self.file = label, tempfile.TemporaryFile(dir=spill_folder())

    def add(self, key: bytes, owner: Owner) -> None:
        self.file.write(struct.pack("<QqQQ?", len(key), owner[0] or 0, owner[1], owner[2], owner[0] is None) + key)

    def records(self) -> Iterator[tuple[bytes, Owner]]:
        self.file.seek(0)
        while head := self.file.read(33):
            n, first, ties, rows, null = struct.unpack("<QqQQ?", head)
            yield self.file.read(n), (None if null else first, ties, rows)


class Trie:
    """Byte strings and their owners. Over the budget, the largest subtrees below the root go to disk."""

    def __init__(self, largest: bool, budget: int = TRIE_BYTES):
        self.largest, self.budget, self.root, self.size, self.spills = largest, budget, Node(b"", None), 0, 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at, path = self.root, 0, [self.root]
        grown = 0
        while True:
            if at == len(key):
                node.owner = merge(node.owner, owner, self.largest)
                break
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = new = Node(key[at:], owner)
                grown = new.size
                break
            rest = key[at : at + len(kid.label)]
            if rest == kid.label:
                at += len(kid.label)
                if isinstance(kid, Spilled):
                    kid.add(key[at:], owner)
                    break
                node = kid
                path.append(node)
                continue
            n = shared(rest, kid.label)
            grown = self._fork(node, kid, n, key[at + n :], owner)
            break
        for x in path:
            x.size += grown
        self.size += grown

    def _fork(self, node: Node, kid: "Node | Spilled", n: int, rest: bytes, owner: Owner) -> int:
        """Split the edge to kid after n bytes, and hang the rest of a key there; the bytes that this adds."""
        mid = Node(kid.label[:n], None)
        kid.label = kid.label[n:]
        mid.kids[kid.label[0]] = kid
        mid.size += 0 if isinstance(kid, Spilled) else kid.size - n
        if isinstance(kid, Node):
            kid.size -= n
        added = NODE_BYTES
        if rest:
            mid.kids[rest[0]] = new = Node(rest, owner)
            mid.size += new.size
            added += new.size
        else:
            mid.owner = owner
        node.kids[mid.label[0]] = mid
        return added

    def shrink(self) -> None:
        """Spill the root's largest subtrees until half the budget is free."""
        while self.size > self.budget // 2:
            big = max((k for k in self.root.kids.values() if isinstance(k, Node) and (k.kids or len(self.root.kids) > 1)), key=lambda k: k.size, default=None)
            if big is None:
                return
            out = Spilled(big.label)
            for key, owner in below(big, b""):
                out.add(key, owner)
            self.root.kids[big.label[0]] = out
            self.size -= big.size
            self.root.size -= big.size
            self.spills += 1

    def owners(self) -> Iterator[tuple[bytes, Owner]]:
        """Every string with its owner; subtrees from disk one at a time, each in a trie of its own."""
        yield from below(self.root, b"", self.budget, self.largest)


def below(top: Node, prefix: bytes, budget: int = TRIE_BYTES, largest: bool = True) -> Iterator[tuple[bytes, Owner]]:
    """Keys and owners at and below a node; without the node's own label."""
    todo: list[tuple[Node | Spilled, bytes]] = [(top, prefix)]
    while todo:
        node, key = todo.pop()
        if isinstance(node, Spilled):
            part = Trie(largest, budget)
            for rest, owner in node.records():
                part.insert(rest, owner)
                if part.size > budget:
                    part.shrink()
            for rest, owner in part.owners():
                yield key + rest, owner
            node.file.close()
            continue
        if node.owner is not None:
            yield key, node.owner
        todo += [(kid, key + kid.label) for kid in node.kids.values()]


def owners(docs: DataFrame, largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per text that several rows hold: text_sha256, n_bytes, keep_id, ties (rows with keep_id), group_size."""
    spark = docs.sparkSession
    prepare(spark)
    kinds = pa.schema([("text", pa.binary()), ("id", pa.int64()), ("ties", pa.int64()), ("rows", pa.int64())])

    def batches_of(found: Iterator[tuple[bytes, Owner]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for key, owner in found:
            rows.append((key, *owner))
            held += len(key)
            if len(rows) >= OUT_ROWS or held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(largest)
        for b in batches:
            for key, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.insert(key, (d, 1, 1))
                if trie.size > budget // 2:  # what is known so far goes on; equal texts meet again after the shuffle
                    yield from batches_of(trie.owners())
                    trie = Trie(largest)
        yield from batches_of(trie.owners())

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(largest, budget)
        for b in batches:
            for key, d, ties, rows in zip(*(c.to_pylist() for c in b.columns)):
                trie.insert(key, (d, ties, rows))
                if trie.size > budget:
                    trie.shrink()
        yield from batches_of((k, o) for k, o in trie.owners() if o[2] > 1)

    form = "text binary, id long, ties long, rows long"
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("id"))
    combined = rows.mapInArrow(combine, form)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = combined.repartition(n, F.octet_length("text"), F.xxhash64("text"))
    found = dealt.mapInArrow(resolve, form)
    return found.select(F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), F.col("id").alias("keep_id"), "ties", F.col("rows").alias("group_size"))


def mark(docs: DataFrame, largest: bool = True) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to documents (doc_id, text).

    Texts are equal when their bytes are; null counts as empty. The row with the largest (or smallest)
    doc_id stays, null ids last; among fully tied rows exactly one stays. Columns of these names in the
    input are replaced; an empty table gives no rows. The tries decide equality; their verdict is
    carried back to the rows by length and SHA-256.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    found = materialise(owners(docs, largest), "op5-owners")
    found = found.select("text_sha256", F.col("n_bytes").alias("tw_bytes"), "keep_id", F.col("ties").alias("tw_ties"), "group_size")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text_sha256", F.sha2(text, 256)).withColumn("tw_bytes", F.octet_length(text))
    joined = rows.join(found, ["text_sha256", "tw_bytes"], "left")
    single = F.col("group_size").isNull()
    joined = joined.withColumn("keep_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    owner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if found.filter("tw_ties > 1").take(1):
        # Rows with the same text and id: the one with the least number stays, which partial sums find. The rows
        # are numbered and written, so that a lost executor numbers none anew.
        joined = materialise(joined.withColumn("tw_row", F.monotonically_increasing_id()), "op5-rows")
        tied = owner & (F.coalesce("tw_ties", F.lit(1)) > 1)
        first = joined.filter(tied).groupBy("text_sha256", "tw_bytes").agg(F.min("tw_row").alias("tw_row")).select("tw_row", F.lit(True).alias("tw_first"))
        joined = joined.join(first, "tw_row", "left").withColumn("kept", owner & (~tied | F.coalesce("tw_first", F.lit(False))))
    else:
        joined = joined.withColumn("kept", owner)
    return joined.select(*docs.columns, "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows that stay, with the columns of docs, whatever their names."""
    return aside(docs, ADDED, lambda rows: mark(rows, largest).filter("kept"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents by their whole text and name the row that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
