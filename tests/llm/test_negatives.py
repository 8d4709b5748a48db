import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def plainly(rows, positives=5, negatives_=3, low=50, high=95, every=5):
    """Rows of rows (vec_id, vector of whole numbers, label), by the definition."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    out = []
    for k, (a, v, label) in enumerate(rows):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), c, j, other == label) for j, (c, w, other) in enumerate(rows) if j != k)
        for ps, p, _, _ in [r for r in scored if r[3]][:positives]:
            fit = [(-s, c) for s, c, _, same in scored if not same and low * -ps <= 100 * -s <= high * -ps][:negatives_]
            out += [(a, p, n + 1, c, -ps, s) for n, (s, c) in enumerate(fit)]
    return Counter(out)


def mined(df, **settings):
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, **settings)
    return Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed, scale", [(0, 1), (1, 30), (2, 1 << 26), (3, 1 << 40)])
def test_against_plain_version(spark, monkeypatch, seed, scale):
    """Norms of every size, ties, repeated rows and ids, vectors of several lengths, many buckets; beyond doubles too."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 300)
    rng = random.Random(seed)
    size = lambda: rng.choice([0, 3, 3, 3, 3, 7]) if seed == 1 else 4
    rows = [(rng.randrange(70) if seed else k, [rng.randint(-4, 9) * rng.choice([1, scale]) for _ in range(size())], rng.randrange(3)) for k in range(80)]
    rows += [rows[0]] * 20 + [(None, [1] * 4, 1), (5, None, 1), (10, [2] * 4, None)]
    df = spark.createDataFrame([(d, None if v is None else [float(x) for x in v], label, "x") for d, v, label in rows], SCHEMA).withColumnRenamed("embedding", "q").repartition(3)
    want = plainly(rows)
    least, most = negatives.LEAST_LONG, negatives.MOST_LONG
    if scale < 1 << 40:
        assert mined(df) == want
    else:  # products beyond a long come back as the nearest long: ids of positives stay
        clip = lambda s: max(least, min(most, s))
        fits = {r: n for r, n in want.items() if abs(r[4]) < most and abs(r[5]) < most}
        got = mined(df)
        assert fits and all(got[(*r[:4], clip(r[4]), clip(r[5]))] == n for r, n in fits.items())


def test_buckets_are_left_out(spark):
    """Long vectors first: what is shorter than the limits allow is never multiplied, and nothing is lost."""
    rng = np.random.default_rng(0)
    length = np.repeat([1000, 100, 10, 1], 500)
    vectors = np.floor(rng.normal(size=(2000, 8)) * length[:, None])
    order = np.argsort(-np.linalg.norm(vectors, axis=1))
    ids, labels, norms = np.arange(2000), np.arange(2000) % 4, np.linalg.norm(vectors, axis=1)
    found = [negatives.Bucket(*(x[order[a : a + 100]] for x in (ids, ids, labels, vectors, norms))) for a in range(0, 2000, 100)]
    own = np.arange(0, 500, 50)
    w = negatives.Windows(np.arange(10), np.full(10, negatives.NONE), np.full(10, np.inf), 5, True)
    negatives.search(iter(found), vectors[own], norms[own], labels[own], ids[own], w, True, True)
    assert w.skipped >= 10 * 14 and w.compared + w.skipped == 200
    for r, a in enumerate(own):
        s = vectors @ vectors[a]
        want = sorted((-s[c], c) for c in range(2000) if c != a and labels[c] == labels[a])[:5]
        assert [(-x, c) for x, c in zip(w.score[r], w.id[r])] == want


def test_whole_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.001, 1e30]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf]), (5, [-inf, 0.0]), (6, None), (7, [])]
    got = spark.createDataFrame(data, "vec_id long, embedding array<double>").select("vec_id", negatives.whole_vectors(F.col("embedding")).alias("q")).collect()
    assert {r["vec_id"]: r["q"] for r in got} == {1: [128.0, -1.0, 2.56e32], 2: None, 3: None, 4: None, 5: None, 6: None, 7: []}


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, q array<double>")
    assert negatives.mine(none, F.col("vec_id") % 5 == 0).count() == 0
    alone = spark.createDataFrame([(5, 1, [1.0])], none.schema)
    assert negatives.mine(alone, F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(alone, F.lit(False)).count() == 0


def test_one_vector_holds_a_third(spark):
    rng = random.Random(5)
    rows = [(k, [3, 1, 2] if k % 3 == 0 else [rng.randint(0, 4) for _ in range(3)], k % 2) for k in range(300)]
    df = spark.createDataFrame([(d, label, [float(x) for x in v]) for d, v, label in rows], "vec_id long, label int, q array<double>")
    assert mined(df) == plainly(rows)
