import random

import numpy as np
import pytest

from tests.llm import brute
from tidewire.llm import exact_dedup, lines, simhash
from tidewire.llm.components import components
from tidewire.llm.exact_dedup import Trie, shared

WORDS = ["a", "ab", "b", "ba", "", "é", "x" * 300]


def test_shared():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = (bytes(rng.choices(b"ab", k=rng.randrange(60))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared(a, b) == n


@pytest.mark.parametrize("budget", [1 << 30, 6000, 1500])
@pytest.mark.parametrize("largest", [True, False])
def test_trie(budget, largest):
    rng = random.Random(budget)
    trie, want = Trie(largest, budget), {}
    for k in range(1500):
        key = "".join(rng.choices(WORDS, k=rng.randrange(5))).encode()
        d = rng.choice([None, rng.randrange(50)])
        trie.insert(key, (d, 1, 1))
        if trie.size > budget:
            trie.shrink()
        want.setdefault(key, []).append(d)
    got = list(trie.owners())
    assert len({k for k, _ in got}) == len(got)
    for key, (owner, ties, rows) in got:
        ids = [d for d in want[key] if d is not None]
        best = (max if largest else min)(ids) if ids else None
        assert (owner, ties, rows) == (best, want[key].count(best), len(want[key]))
    assert len(got) == len(want) and (budget > 1 << 20 or trie.spills)


def test_mark_odd_rows(spark):
    data = [(1, "a", 0), (1, "a", 0), (None, "a", 0), (2, None, 0), (3, "", 0), (None, "n", 0), (None, "n", 0), (4, "A", 0), (5, "x" * 100_000, 0), (6, "x" * 100_000, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, kept int")
    got = exact_dedup.mark(df).collect()
    assert len(got) == len(data)
    kept = sorted((r["keep_id"] is None, r["keep_id"] or 0, r["group_size"]) for r in got if r["kept"])
    assert kept == [(False, 1, 3), (False, 3, 2), (False, 4, 1), (False, 6, 2), (True, 0, 2)]
    assert exact_dedup.deduplicate(df).columns == df.columns
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    first = {r["doc_id"] for r in exact_dedup.mark(df, largest=False).collect() if r["kept"]}
    assert first == {1, 2, 4, 5, None}


def near_lines(docs):
    """Per (doc_id): the lines that stay."""
    seen, out = [], {}
    for d, t in sorted(docs):
        kept = []
        for x in (t or "").split("\n"):
            gone = x != "" and any(x == y or (min(len(x), len(y)) >= lines.NEAR_CHARS and brute.neighbours(x, y)) for y in seen)
            if x != "":
                seen.append(x)
            if not gone:
                kept.append(x)
        out[d] = (len((t or "").split("\n")), len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé ", k=rng.choice([5, 19, 20, 21, 24, 31, 32, 33, 90]))) for _ in range(12)]

    def edit(x):
        k, c = rng.randrange(len(x) + 1), rng.choice("abé")
        return rng.choice([x, x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :], ""])

    docs = [(d, "\n".join(edit(edit(rng.choice(base))) if rng.random() < 0.5 else edit(rng.choice(base)) for _ in range(rng.randrange(8)))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text"]) for r in lines.deduplicate(df).collect()}
    assert got == near_lines(docs)


def test_lines_odd_rows(spark):
    long = "y" * 3000
    data = [(None, "first line of all the lines", 1), (1, "first line of all the lines\n\nshort", 2), (1, "first line of all the lines\n\nshort", 2), (2, None, 3), (3, "", 3), (4, f"{long}\nfirst line of all the linez\nshort\nshorx", 4), (5, long + "z", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_kept int")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["n_lines"]) for r in lines.deduplicate(df).collect()))
    assert got == [(False, 0, "first line of all the lines", 1), (True, 1, "\nshort", 3), (True, 1, "\nshort", 3), (True, 2, "", 1), (True, 3, "", 1), (True, 4, f"{long}\nshorx", 4), (True, 5, "", 1)]
    assert lines.deduplicate(df.limit(0)).count() == 0


def test_fingerprints():
    for t in ["", "one", "one two three", "One two THREE four", "a b c d a b c d a", "é ü x \x0b y\x1cz q", "w " * 700]:
        assert simhash.fingerprint(t.encode()) == brute.simhash(t)
    part, simhash.PART_WORDS = simhash.PART_WORDS, 50
    try:
        assert simhash.fingerprint(b"alpha beta gamma delta eps " * 97) == brute.simhash("alpha beta gamma delta eps " * 97)
    finally:
        simhash.PART_WORDS = part


@pytest.mark.parametrize("n", [0, 1, 2, 90, 700])
def test_vantage_point_links_are_exact(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)]
    points = np.unique(np.array([int(centres[i % 8]) ^ f for i, f in enumerate(flips)], np.uint64))
    forest = simhash.Forest(len(points))
    splits = simhash.link_shard(points, 4, forest, leaf=8)
    assert (splits > 0) == (n > 8)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    want = brute.component_of(range(len(points)), zip(*np.nonzero(near)))
    assert [forest.find(k) for k in range(len(points))] == [want[k] for k in range(len(points))]


@pytest.mark.parametrize("blocks_for", [10, 10**7, 10**11])
def test_masks_lose_no_pair(blocks_for):
    keys = simhash.masks(4, blocks_for)
    rng = np.random.default_rng(0)
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
        shared = [m for m in keys if a & m == b & m]
        assert shared and all(any(a & f == b & f for f in simhash.finer(m, 4)) for m in shared)


@pytest.mark.parametrize(("shard", "most"), [(1024, 50_000), (8, 50_000), (64, 3), (1 << 20, 10)])
def test_shards_of_any_size_give_the_same_components(spark, shard, most):
    """Fingerprints that resemble each other fill few shards; those are dealt again, and no link is lost."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(400)]
    points = np.unique(np.array([centre ^ f for f in flips] + rng.integers(0, 1 << 63, 200).tolist(), np.uint64))
    df = spark.createDataFrame([(x,) for x in points.view(np.int64).tolist()], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 4, shard, most).collect()]
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    names = points.view(np.int64).tolist()
    want = brute.component_of(names, [(names[i], names[j]) for i, j in zip(*np.nonzero(near))])
    assert brute.component_of(names, links) == want


def test_one_row_of_a_component_stays(spark):
    near = "the quick brown fox jumps over the lazy dog and then some more words follow here today " * 15
    other = near.replace("today", "tonight", 1)
    assert (brute.simhash(near) ^ brute.simhash(other)).bit_count() <= 4 and near != other
    data = [(5, "unrelated words that stand alone here"), (5, near), (3, other), (3, other), (None, near), (None, None), (None, ""), (8, " ")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], "doc_id long, text string, tw_row int")
    got = [tuple(r) for r in simhash.deduplicate(df).collect()]
    assert sorted((r[0], r[1]) for r in got) == [(3, other), (5, data[0][1]), (8, " ")]
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.deduplicate(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, near), (None, near)], "doc_id long, text string")
    assert simhash.deduplicate(nulls).count() == 1


def test_near_duplicates_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and then some more words follow here today"
    data = [(7, base), (3, base.upper().lower()), (9, base), (9, base), (1, None), (2, ""), (None, " "), (5, "alone in the world"), (4, "Alone In The World")]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, component_id string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("7", 3), ("3", 3), ("9", 3), ("9", 3), ("1", 1), ("2", 1), ("None", 1), ("5", 4), ("4", 4)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, k) for k in range(300, 360)] + [(k, k + 1) for k in range(400, 460)] + [(1, None), (5, 5)]
    nodes = {x for e in links if None not in e and e[0] != e[1] for x in e}
    want = brute.component_of(nodes, [e for e in links if None not in e])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0
