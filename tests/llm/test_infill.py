import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.llm import infill


def plainly(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    spm = h[3] % 100 < spm_rate
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def hostile():
    rng = random.Random(11)
    bits = ["a", "\n", "\n\n", "\r\n", "\x1b", "\x1d", "\x1be", "\x1bd", "e", "d", "<", "<P", "S>", "é", "😀", " ", "$0", "\\", " ", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(300)]
    return [*texts, None, "", "\n", "x" * 300_000, "line\n" * 50_000, "\x1b" * 999, "\x1d\n" * 99, "<P>", "a<S>b\n", "<M", "<", ">"]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_against_plain_version(spark, rate, spm_rate):
    data = [(d if d % 9 else None, t, "n", 1) for d, t in enumerate(hostile())] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, form string, n int")
    got = infill.fill_in_middle(docs, rate, spm_rate)
    back = got.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text"))
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    want = sorted((plainly(d, t, rate, spm_rate) for d, t, *_ in data), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((d, t or "") for d, t, *_ in data), key=key)


def test_other_units(spark):
    """Words with the blanks after them: an infilling example of three stretches of whole words."""
    docs = spark.createDataFrame([(k, "one two  three four five") for k in range(40)], "doc_id long, text string")
    got = infill.fill_in_middle(docs, unit=r"\s*\S+\s*")
    assert {r["n"] for r in got.collect()} == {5}
    for r in got.collect():
        for part in re.split("<[PSM]>", r["output"]):
            assert part == part.lstrip() and (not part or part[-1] == " " or part.endswith("five"))
    assert {r["t"] for r in got.select(infill.restore(F.col("output"), F.col("form")).alias("t")).collect()} == {"one two  three four five"}


def test_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = infill.op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
