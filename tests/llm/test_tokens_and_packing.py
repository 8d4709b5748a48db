import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewire.llm import packing, token_files, words
from tidewire.llm.tokens import Encoder, encoder, vocabulary
from tidewire.runtime import materialise, scratch

HARD = [None, "", " ", "a", "  two  spaces \n\n and\tmore ", "don't 'tis 's x'll", "a<|endoftext|>b", "日本 語", "x\x1c y", "é" * 50, "Ñandú-1234567 !?!", "word " * 3000]


@pytest.fixture(scope="module")
def enc():
    return encoder("byte_bpe_50k.json")


def library(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(enc):
    rng = random.Random(3)
    parts = [" ", "  ", "a", "the", "\n", "\t", ".", "1", "é", "'s", "'", "'re", "ll", "\r\n", "\xa0", "日", "😀", "İ", "<|endoftext|>"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(3000)]
    assert [x.tolist() for x in enc.encode_all(texts)] == [library(enc, t) for t in texts]


def test_long_text_and_small_cache():
    e = Encoder(vocabulary("byte_bpe_50k.json"), cache_words=3000)
    text = " ".join(f"w{k} é{k % 977}," for k in range(200_000))
    assert len(text) > 2 << 20
    assert e.encode(text[:40_000]).tolist() == library(e, text[:40_000])
    big = encoder("byte_bpe_50k.json").encode(text)
    assert big.tolist() == library(e, text)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 24, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    assert token_files.unpack(data, 1000, bits).tolist() == ids.tolist()
    assert token_files.unpack(data, 5, bits, 16).tolist() == ids[16:21].tolist() or bits in (8, 16, 32)


@pytest.mark.parametrize("codes", [2, 32000, 50257, 100000])
def test_shards_read_any_range(codes):
    rng = np.random.default_rng(codes)
    parts = [rng.integers(0, codes, n).astype(np.uint32) for n in (1, 5000, 3, 4096, 1)]
    s = token_files.Shard(token_files.shard_bytes([None, 1, 2, 3, 4], parts, codes))
    every = np.concatenate(parts)
    for a, b in ((0, 0), (0, 1), (4095, 4097), (17, 9000), (0, len(every))):
        assert s.ids(a, b).tolist() == every[a:b].tolist()
    assert [s.document(k).tolist() for k in range(5)] == [p.tolist() for p in parts]
    with pytest.raises(ValueError):
        token_files.shard_bytes([1], [np.array([codes], np.uint32)], codes)


def test_files_of_odd_rows(spark, enc):
    least = -(1 << 63)
    data = [(5, "b b", "x"), (None, "n", "y"), (5, "b b", "z"), (1, None, None), (least, "", None), (5, "a", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start string")
    folder = scratch(spark, "test-files")
    manifest = materialise(token_files.write(docs, folder, shard_ids=4), "test-manifest")
    got = token_files.read(folder, manifest).orderBy("start").collect()
    assert manifest.count() > 1
    assert [r["doc_id"] for r in got] == [None, least, 1, 5, 5, 5]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert sorted(r["ids_crc32"] for r in got) == sorted(brute.crc([*library(enc, t), 0]) for _, t, _ in data)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch(spark, "test-files")
    manifest = materialise(token_files.write(empty, folder), "test-manifest")
    assert manifest.count() == 0 and token_files.read(folder, manifest).count() == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100, 2048])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 5, 60]) for _ in range(rng.randint(0, 80))}
    rows, made = packing.plan(dict(counts), capacity)
    placed = {(n, r + i): (f + i, o) for n, r, m, f, o in rows.tolist() for i in range(m)}
    assert set(placed) == {(n, k) for n, c in counts.items() for k in range(c)}
    used = {}
    for (n, _), (s, o) in placed.items():
        used.setdefault(s, []).append((o, n))
    assert sorted(used) == list(range(made))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_plan_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(0)
    counts: dict[int, int] = {}
    for n in np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 2048).tolist():
        counts[n] = counts.get(n, 0) + 1
    gaps, bins = [0] * 2049, 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            g = next((g for g in range(n, 2049) if gaps[g]), None)
            if g is None:
                bins += 1
                gaps[2048 - n] += 1
            else:
                gaps[g] -= 1
                gaps[g - n] += 1
    assert packing.plan(counts, 2048)[1] <= bins * 1.01


def test_pack_odd_rows_and_sequences(spark, enc):
    data = [(1, "word " * 900, 7), (2, None, 8), (2, None, 8), (None, "x", 9), (3, "", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, sequence_id long")
    got = packing.pack(docs, capacity=256)
    found = got.toPandas()
    assert found.length.sum() == sum(len(library(enc, t)) + 1 for _, t, _ in data)
    assert found[found.doc_id == 1].length.max() == 256
    unique = docs.filter("doc_id in (1, 3)")
    placed = packing.pack(unique, capacity=256)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(unique, placed).collect()}
    for r in placed.collect():
        ids = [*library(enc, dict((d, t) for d, t, _ in data)[r["doc_id"]]), 0][r["start"] : r["start"] + r["length"]]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids
    assert placed.agg(F.max("length")).first()[0] <= 256


def twins(n):
    """Two words of n letters whose polynomial hashes agree modulo powers of two, whatever the base."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 128, 1024, 2048, 4096])
def test_words_of_one_hash_keep_their_ids(enc, n):
    a, b = twins(n)
    for texts in ([a, b], [b, a], [f"{a} {b}", f"x {b} {a}"], [b * 3, a * 3]):
        for e in (Encoder(vocabulary("byte_bpe_50k.json")), enc):
            assert [x.tolist() for x in e.encode_all(texts)] == [library(enc, t) for t in texts]


def test_words_whose_hashes_all_agree(enc, monkeypatch):
    """Every lookup but the first of its entry goes to the library: nothing rests on the hash."""
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    e.value = np.zeros_like(e.value)
    texts = ["one two six ten", "ten six two one", "abc " * 20 + "abd " * 20, "x" * 1000 + " y"]
    assert [x.tolist() for x in e.encode_all(texts)] == [library(enc, t) for t in texts]


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    found = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(20_000)] + ["a" * k for k in range(1, 200)] + ["aé" * k for k in range(1, 40)] + [w for n in (64, 1024, 4096) for w in twins(n)]
    h, doc = words.word_hashes(*words.bytes_of(pa.array([" ".join(found), "\t".join(w.upper() if w.isascii() else w for w in found)])))
    half = len(found)
    assert len(h) == 2 * half and (h[:half] == h[half:]).all() and doc.tolist() == [0] * half + [1] * half
    assert len(set(h.tolist())) == len(set(found))


def test_new_words_are_encoded_without_places():
    """The library need not say which word an id is of; where ids do not spell the words, it is asked."""
    text = "The quick brown fox, dañó über él Ελλάδα год 12 's don't a  b\n\tc " + " ".join(chr(97 + k % 26) * (k % 40 + 1) + "éñb"[k % 3] for k in range(1500))
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    want, asked, tok = e.tok.encode(text, add_special_tokens=False).ids, [], e.tok

    class Tok:
        def encode(self, x, add_special_tokens):
            asked.append(x)
            return tok.encode(x, add_special_tokens=add_special_tokens)

        def encode_batch_fast(self, x, add_special_tokens):
            return tok.encode_batch_fast(x, add_special_tokens=add_special_tokens)

    e.tok = Tok()
    assert e.encode(text).tolist() == want and not asked
    e._forget()
    e.size_of[:] = 1
    assert e.encode(text).tolist() == want and asked
