"""The registered queries over the smallest tables, held against SQL and plain versions."""

import zlib

import numpy as np
import pandas as pd
import pytest

from tests.llm import brute
from tests.oracle import compare
from tidewire.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pd.read_parquet(f"{sf_dir}/documents.parquet")
    return list(zip(t.doc_id.tolist(), t.text.tolist()))


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_op1(spark, sf_dir, docs, encode):
    assert rows(QUERIES["op1_token_files"](spark, sf_dir)) == brute.token_rows(docs, encode)


def test_op2(spark, sf_dir):
    found = QUERIES["op2_language_id"](spark, sf_dir).toPandas()
    truth = pd.read_parquet(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"])
    held = found.merge(truth, on="doc_id")
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]).all()
    held = held[held.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_op2_against_exact_sets(spark, sf_dir):
    """Bloom filters against sets: the same languages, and scores within what their false positives can do."""
    t = pd.read_parquet(f"{sf_dir}/documents.parquet")
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d in t.doc_id]
    sets, default = brute.language_sets([(x, lang) for x, lang, h in zip(t.text, t.lang, held) if not h])
    found = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, sf_dir).collect()}
    assert len(found) == len(t)
    for d, x in zip(t.doc_id, t.text):
        lang, score = brute.language(x, sets, default)
        assert found[d]["lang_pred"] == lang
        assert abs(found[d]["score"] - score) <= 0.01


def test_op4(spark, sf_dir, docs, encode):
    found = QUERIES["op4_best_fit_packing"](spark, sf_dir).toPandas()
    ids = {d: [*encode(t or ""), 0] for d, t in docs}
    for d, part in found.groupby("doc_id"):
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(len(part)))
        assert (part.length.iloc[1:] == 2048).all() and part.length.sum() == len(ids[d])
        assert part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert [brute.crc(ids[d][s : s + n]) for s, n in zip(part.start, part.length)] == part.ids_crc32.tolist()
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) * 1.01 + 1


def test_op8(spark, sf_dir, docs):
    assert rows(QUERIES["op8_simhash"](spark, sf_dir)) == brute.near_groups(docs)


def test_op9(spark, sf_dir, docs):
    found = QUERIES["op9_lm_scoring"](spark, sf_dir).toPandas()
    want = brute.unigram(docs, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    for r in found.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    assert np.isfinite(found.score).all() and (found.score < 0).all()


def test_op10(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    want = {p: brute.url_rule(u) for p, u in zip(pages.page_id.tolist(), pages.url.tolist())}
    for r in QUERIES["op10_url_filters"](spark, sf_dir).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (*want[r["page_id"]][:3], want[r["page_id"]][3] or "allow")
