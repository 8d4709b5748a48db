"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its common n-grams (bytes of lower-cased words, with the spaces
around them). The filters are stored bit-sliced: one slot holds a bit for every language, so ANDing
an n-gram's slots gives all languages that contain it. Bits are counted per language and text, and
corrected for each filter's rate of false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import materialise, prepare, table

UNDETERMINED = "und"
GRAM = 4
HASHES = 2
SLOT_BITS = 20
#: Labelled documents of each language that the filters are fitted on (expected number; all if there are fewer).
SAMPLE_DOCS = 2000
#: Most common n-grams kept per language.
KEEP_GRAMS = 20_000
#: An n-gram seen less often in a language's sample is noise.
LEAST_SEEN = 3
CHUNK = 4 << 20
LANGS_AT_ONCE = 32

FOLD = np.full(256, 32, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def grams(texts: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, text's number) for each n-gram that has something but spaces, part by part."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= chunk:
            size += len(texts[to])
            to += 1
        buf = FOLD[np.frombuffer(b" " + b"  ".join(texts[at:to]) + b" " * GRAM, np.uint8)]
        ends = np.cumsum([len(t) + 2 for t in texts[at:to]])
        for a in range(0, max(0, len(buf) - GRAM + 1), chunk):
            part = buf[a : a + chunk + GRAM - 1].astype(np.uint32)
            n = len(part) - GRAM + 1
            if n <= 0:
                continue
            g = np.zeros(n, np.uint32)
            for k in range(GRAM):
                g |= part[k : k + n] << np.uint32(8 * k)
            # Windows over two spaces are left out: they hold the ends of two words, or nothing.
            pair = (part[:-1] == 32) & (part[1:] == 32)
            bad = np.zeros(n, bool)
            for k in range(GRAM - 1):
                bad |= pair[k : k + n]
            at_ = np.flatnonzero(~bad)
            yield g[at_], at + np.searchsorted(ends, at_ + a, side="right")
        at = to


def slots(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((g.astype(np.uint64) + np.uint64(k + 1)) * MIX[k] >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Filters:
    """words[w][slot] holds the bits of languages 64 w to 64 w + 63."""

    langs: list[str]
    words: list[np.ndarray]
    false_rate: np.ndarray
    default: int
    bits: int = SLOT_BITS
    hashes: int = HASHES

    @staticmethod
    def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, default: int, bits: int = SLOT_BITS, hashes: int = HASHES) -> "Filters":
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        words = [np.zeros(1 << bits, kind) for _ in range(max(1, -(-len(langs) // 64)))]
        for n in range(len(langs)):
            for k in range(hashes):
                words[n // 64][slots(gram[lang == n], k, bits)] |= kind(1 << (n % 64))
        fill = np.array([((words[n // 64] >> kind(n % 64)) & kind(1)).mean() for n in range(len(langs))])
        return Filters(langs, words, fill**hashes, default, bits, hashes)

    def contains(self, g: np.ndarray) -> list[np.ndarray]:
        """Bit masks of all languages that contain each n-gram."""
        out = [w[s] for s in [slots(g, 0, self.bits)] for w in self.words]
        for k in range(1, self.hashes):
            s = slots(g, k, self.bits)
            out = [m & w[s] for m, w in zip(out, self.words)]
        return out

    def judge(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the share of n-grams that the language's filter holds."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for g, doc in grams(texts):
            if not len(g):
                continue
            masks = self.contains(g)
            cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            which = doc[cut]
            total[which] += np.diff(np.append(cut, len(doc)))
            for n in range(len(self.langs)):
                m = masks[n // 64]
                hits[which, n] += np.add.reduceat((m >> m.dtype.type(n % 64)) & m.dtype.type(1), cut, dtype=np.int64)
        some = np.maximum(total, 1)[:, None]
        true = np.clip((hits / some - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, 1)
        out = []
        for t, row in zip(texts, true):
            if not self.langs or not has_letter(t):
                out.append((UNDETERMINED, 0.0))
            elif not (top := row.max()) > 0:
                out.append((self.langs[self.default], 0.0))
            else:
                out.append((self.langs[int(row.argmax())], float(top)))
        return out


ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, ASCII_LETTERS)) < len(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, keep: int = KEEP_GRAMS) -> Filters:
    """Fit filters on labelled documents (doc_id, text, lang); null languages are left out.

    A bounded sample is used: about sample_docs documents of each language, chosen by a hash.
    """
    spark = labelled.sparkSession
    prepare(spark)
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Filters([], [np.zeros(1 << SLOT_BITS, np.uint8)], np.zeros(0), 0)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / sizes[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    number = F.array_position(F.lit(langs), F.col("lang")) - 1
    sample = labelled.filter(draw < share).select(number.cast("int").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).to_numpy()
            texts = b.column(1).to_pylist()
            for g, doc in grams(texts):
                keys, n = np.unique((lang[doc].astype(np.uint64) << np.uint64(32)) | g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)
    seen = materialise(seen, "op2-grams")
    kept = []
    for at in range(0, len(langs), LANGS_AT_ONCE):
        # Each language's commonest n-grams by a distributed top-k: at most `keep` rows reach the driver for each.
        tops = [seen.filter(F.col("lang") == n).orderBy(F.desc("n"), "gram").limit(keep).select("lang", "gram") for n in range(at, min(at + LANGS_AT_ONCE, len(langs)))]
        kept.append(reduce(DataFrame.union, tops).toPandas())
    rows = pd.concat(kept)
    default = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i))
    return Filters.fit(langs, rows["lang"].to_numpy(), rows["gram"].to_numpy().astype(np.uint32), default)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Add lang_pred and score to documents; only their whole texts are looked at.

    Texts that are null or have no letter get `und` and score 0, and so do all if no language was
    learnt. A text that no filter knows gets the most frequent language and score 0; of equal scores
    the language first in the alphabet wins. Input columns of these names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(filters)  # 2 ** SLOT_BITS slots for up to 8 languages a byte
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.judge([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(judge, f"{kinds}, lang_pred string, score double")


def fold_of(parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn on three quarters of the documents, and predict the language of all."""
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.select("doc_id", "text", "lang").filter(fold_of(4) != 2))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold_of(4) == 2).alias("held_out"), "lang_pred", "score")
