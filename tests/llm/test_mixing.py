import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewire.llm import mixing


def water_level(capacity, weight, amount):
    """Shares in proportion to weight, up to each one's capacity, in exact fractions."""
    full = set()
    while True:
        free = [s for s in capacity if s not in full]
        wide = sum(weight[s] for s in free)
        per = (amount - sum(capacity[s] for s in full)) / wide if wide else Fraction(0)
        more = {s for s in free if per * weight[s] > capacity[s]}
        if not more:
            return {s: capacity[s] if s in full else per * weight[s] for s in capacity}
        full |= more


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plainly(docs, weights=None, share=Fraction(3, 2), most=2, seed=13, cycle=(3, 1, 2)):
    """Rows (doc_id, source, size, source_size, target, copies) of docs with ids of their own."""
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    weights = weights or {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    total = Counter()
    for _, s, t in docs:
        total[s] += size_of(t)
    goal = water_level({s: most * total[s] for s in names}, {s: Fraction(weights.get(s, 0)) for s in names}, share * sum(total.values()))
    out = []
    for s in names:
        rate = goal[s] / total[s] if total[s] else Fraction(0)
        whole, p = rate // 1, rate % 1
        left = goal[s] - whole * total[s]
        draw = lambda d: (int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:13], 16), d)
        for d, t in sorted(((d, t) for d, x, t in docs if x == s), key=lambda r: draw(r[0])):
            n = size_of(t)
            more = p > 0 and n > 0 and 2 * left >= n
            left -= n
            out.append((d, s, n, total[s], pytest.approx(float(goal[s])), int(whole + more)))
    return sorted(out, key=lambda r: r[0])


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", "", None, "zz", "\U0001f600", "￿"]
    text = lambda: rng.choice([None, "", " \t", "w", "x y\x0bz", "w " * rng.randrange(200), "é\xa0q"])
    return [(d, names[int(len(names) * rng.random() ** 3)], text()) for d in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_version(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, source string, text string, size int, weight int")
    got = mixing.mix(df.repartition(3 + seed)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == plainly(docs)


def test_given_weights_share_and_most(spark):
    docs = corpus(9)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 5), ("b", 1), (None, 2), ("nobody", 9), ("zz", 0), ("Z", None)], "source string, weight int")
    got = mixing.mix(df, weights, share=0.5, most=3, seed=4).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == plainly(docs, {"a": 5, "b": 1, None: 2}, Fraction(1, 2), 3, 4)


def test_sources_without_weight_leave_the_rest_undealt(spark):
    df = spark.createDataFrame([(1, "a", "x y z"), (2, "b", "x y z")], "doc_id long, source string, text string")
    got = mixing.mix(df, spark.createDataFrame([("a", 1)], "source string, weight int"))
    assert sorted((r["source"], r["target"], r["taken"]) for r in got.collect()) == [("a", 6.0, 6), ("b", 0.0, 0)]


def test_rows_of_one_id_and_repeated_rows(spark):
    """A third of all rows is one row; the rest share two ids."""
    data = [(None, "s", "a b c")] * 300 + [(5, "s", "w " * k) for k in range(1, 300)] + [(None, None, "n " * (k % 7)) for k in range(301)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    for n in (1, 7):
        got = mixing.mix(df.repartition(n), cycle_of(spark, {"s": 1, None: 9}), share=0.8).collect()
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size_of(t)) for d, s, t in data)
        taken = defaultdict(int)
        for r in got:
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 2 * r["size"]
        for s, goal in {(r["source"], r["target"]) for r in got}:
            assert abs(taken[s] - goal) <= max(size_of(t) for _, x, t in data if x == s) / 2
    outcomes = {tuple(sorted((r["size"], r["copies"]) for r in mixing.mix(df.repartition(n)).collect())) for n in (1, 2, 5)}
    assert len(outcomes) == 1


def cycle_of(spark, weights):
    return spark.createDataFrame(list(weights.items()), "source string, weight int")


def test_preference(spark):
    """Copies in proportion to a preference, twice at most, and words near the target; likelier rows are taken more often."""
    rng = random.Random(3)
    data = [(d, "ab"[d % 2], "w " * rng.randrange(1, 9), rng.choice([0, 1, 4, 40, None])) for d in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, liked int")
    got = mixing.mix(df, cycle_of(spark, {"a": 1, "b": 1}), share=0.6, preference="liked", carry=["liked"]).collect()
    for s in "ab":
        rows = [r for r in got if r["source"] == s]
        capacity = {r["doc_id"]: 2 * Fraction(r["size"]) for r in rows}
        want = water_level(capacity, {r["doc_id"]: Fraction(r["size"] * (r["liked"] or 0)) for r in rows}, Fraction(rows[0]["target"]))
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 4
        for liked in (None, 0, 1, 4, 40):
            mine = [r for r in rows if r["liked"] == liked]
            expected = sum(want[r["doc_id"]] for r in mine)
            assert abs(sum(r["taken"] for r in mine) - expected) <= max(0.15 * expected, 40) if liked else not any(r["taken"] for r in mine)
        for r in rows:
            assert abs(r["copies"] - want[r["doc_id"]] / r["size"]) < 1.000001


def test_a_third_of_the_rows_is_drawn_evenly(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    got = mixing.mix(df, [1], share=1 / 3).filter("copies = 1").select("doc_id").toPandas().doc_id
    assert len(got) == 3000 and abs(got.mean() - 4499.5) < 150


def test_mixed_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y", 7), (1, "a", "x y", 8), (None, "b", "q", 9), (3, "b", None, 1)], "doc_id long, source string, text string, copies int")
    plan = mixing.mix(df, carry=["copies"])
    assert plan.columns.count("copies") == 2 and plan.count() == 4
    got = mixing.mixed(df, weights=[1], share=2.0).collect()
    assert Counter(tuple(r) for r in got) == {(1, "a", "x y", 7): 2, (1, "a", "x y", 8): 2, (None, "b", "q", 9): 2, (3, "b", None, 1): 2}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    empty = spark.createDataFrame([(1, None, None)], none.schema)
    assert [tuple(r) for r in mixing.mix(empty).collect()] == [(1, None, 0, 0, 0.0, 0, 0)]


def test_plan_is_native(spark, sf_dir):
    plan = mixing.op13_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
