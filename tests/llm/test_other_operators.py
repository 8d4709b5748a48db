import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewire.llm import chat, decontamination, language, lm, urls


# --- decontamination ---


@pytest.mark.parametrize("pass_bytes", [1 << 22, 60])
def test_decontamination_against_brute_force(spark, pass_bytes):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "cd", "é", "x1", "longerword", "Zz"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for k in range(25)] + [(99, None), (100, "-- ,, --"), (101, "ab CD, é!"), (102, "ab cd é")]
    docs = []
    for d in range(60):
        parts = [rng.choice([word(), "-", ", ", items[rng.randrange(25)][1] or "q"]) for _ in range(rng.randrange(40))]
        docs.append((d, " ".join(parts)))
    docs += [(61, None), (62, ""), (63, "!!"), (64, "ab"), (65, "AB--cd\n\né")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    got = decontamination.mark(df, spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == sorted(brute.decontaminated(docs, items))


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.mark(docs, none).first()["contaminated"]
    assert decontamination.mark(docs.limit(0), spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0


def test_wu_manber_across_segments():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"abc "), 20_000).tolist())
    pats = [text[k : k + 41] for k in range(0, 19_000, 501)] + [b"z" * 50]
    pos, pat = decontamination.WuManber(pats).find(np.frombuffer(text, np.uint8))
    want = sorted((i, k) for k, p in enumerate(pats) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(pos.tolist(), pat.tolist())) == want


# --- language identification ---


def test_language_odd_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("el gato y el perro de la casa", "es")] * 20)]
    filters = language.fit(spark.createDataFrame([*rows, (99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"))
    assert filters.langs == ["en", "es"]
    data = [(1, "the dog of the house"), (2, "el perro de la casa"), (3, None), (4, ""), (5, "123 !!"), (6, "日本"), (7, "the dog " * 50_000)]
    df = spark.createDataFrame([(*r, "zz") for r in data], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, filters).collect()}
    assert [got[k][0] for k in range(1, 8)] == ["en", "es", "und", "und", "und", "en", "en"]
    assert got[3][1] == got[6][1] == 0 and got[1][1] > 0.9
    assert language.identify(df.limit(0), filters).count() == 0
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}


def test_many_languages():
    langs = [f"l{k:03d}" for k in range(130)]
    lang = np.repeat(np.arange(130), 3)
    gram = np.arange(390, dtype=np.uint32) * 7919
    f = language.Filters.fit(langs, lang, gram, 0, bits=16)
    masks = f.contains(gram)
    for n in range(130):
        assert ((masks[n // 64][lang == n] >> np.uint64(n % 64)) & np.uint64(1)).all()


def test_grams_by_chunks():
    texts = [b"The cat", b"", b"a", b"x" * 50, "né où".encode()]
    whole = [(int(g), int(d)) for gs, ds in language.grams(texts) for g, d in zip(gs, ds)]
    parts = [(int(g), int(d)) for gs, ds in language.grams(texts, chunk=7) for g, d in zip(gs, ds)]
    assert sorted(whole) == sorted(parts)


# --- chat formatting ---


def test_chats_read_back(spark):
    hard = ["", "</s>", "<\\|x", "<|user|>\n", "[INST]\\[/INST]", "<|+|>", "a</s>\n<|assistant|>\nb", "|>", "<|>", "\\", "[\\INST]", "<", None, "é\n\n"]
    rows = [(1, k, ["user", "user", "assistant", "assistant", "system"][k % 5], t) for k, t in enumerate(hard)] + [(2, 0, None, "x"), (2, 1, "ro|>le<|", "y"), (None, 0, "user", "n"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    made = chat.format_chats(df)
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in made.select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, n, role, t, _ in sorted([(c, n, r or "", t or "", 0) for c, n, r, t in rows], key=lambda r: (r[0] or 0, *r[1:])):
        want.setdefault(c, []).append((role, t))
    assert back == want
    texts = {r["conv_id"]: r["x"] for r in made.select("conv_id", chat.loss_texts(F.col("formatted"), F.col("loss")).alias("x")).collect()}
    assert texts[1] == [t for r, t in want[1] if r == "assistant"] and texts[2] == []
    one = made.filter("conv_id = 3").first()["formatted"]
    assert one == "<|assistant|>\na<|+|>a<|+|>b</s>\n"
    assert chat.format_chats(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(nulls).count() == 3  # none of them has a partner


# --- url filters ---


def test_aliases_carry_blocks(spark):
    link = lambda u: f'<html><link href="{u}" rel="canonical"></html>'
    pages = [
        (1, "http://a.example.com/en/1", None),
        (2, "http://b.example.org/x", link("http://a.example.com/en/1#f")),
        (3, "http://c.example.org/y", '<meta http-equiv="refresh" content="0; url=http://b.example.org/x">'),
        (4, "http://example.com/en/7?q", link("http://b.example.org/x")),
        (5, "http://d.example.org/z", link("/w")),
        (6, None, "<p>"),
        (7, "no scheme", None),
        (8, "HTTP://E.ORG", ""),
        (9, "http://f.example.org/es/1", None),
        (10, "http://d.example.org/w", None),
        (10, "http://d.example.org/w", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.RULES).collect()}
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert got[4][2] == "example.com/en/7" and got[6][:2] == ("", "") and got[8][0] == "e.org"
    crawl = spark.createDataFrame([("http://d.example.org/w", "http://a.example.com/en/1")], "from_url string, to_url string")
    more = {r["page_id"]: r["verdict"] for r in urls.judge(df, urls.RULES, crawl).collect()}
    assert more[5] == more[10] == "block"
    assert urls.judge(df.limit(0), urls.RULES).count() == 0


def test_targets_are_resolved(spark):
    page = "http://p.example.org/d/e/f.html?q"
    made = [
        ('<link rel=canonical href="../en/1">', "p.example.org/d/en/1"),
        ('<link href="x.html" rel="canonical">', "p.example.org/d/e/x.html"),
        ("<base href='http://q.example.org/z/'><link rel='canonical' href='y'>", "q.example.org/z/y"),
        ('<BASE target=_top href="../k/"><meta content="5;URL=m" http-equiv="Refresh">', "p.example.org/d/k/m"),
        ('<link rel="canonical" href="?a=1&amp;b=2">', "p.example.org/d/e/f.html?a=1&b=2"),
        ('<link rel="canonical" href="//R.example.org">', "r.example.org/"),
    ]
    none = ['<link rel="canonical" href="">', '<link rel="canonical" href="mailto:a@b">', '<link rel="canonical" href="#x">', '<link rel="alternate" href="/o">', "<base href='/q'>"]
    df = spark.createDataFrame([(page, h) for h, _ in made] + [(page, h) for h in none], "url string, html string")
    assert sorted(r["b"] for r in urls.links(df).collect()) == sorted(b for _, b in made)


def test_many_rules_agree_with_few(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "org", "x.org", ""]
    rules = [urls.Rule(rng.choice(["allow", "block"]), h, "/" * rng.randrange(2) + "ab"[: rng.randrange(3)]) for h in hosts for _ in range(4)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    df = spark.createDataFrame([(f"http://{h}{p}",) for h in ["a.example.com", "example.com", "com", "b.x.org", "xorg", "net"] for p in ["", "/", "/a", "/ab", "/b"]], "url string")
    few = sorted(tuple(r) for r in urls.decide(df, rules).select("url", "rule", "rule_verdict").fillna("").collect())
    most, urls.INLINE_RULES = urls.INLINE_RULES, 0
    try:
        assert few == sorted(tuple(r) for r in urls.decide(df, rules).select("url", "rule", "rule_verdict").fillna("").collect())
    finally:
        urls.INLINE_RULES = most


# --- language model ---


def small_model():
    rng = np.random.default_rng(0)
    texts = [rng.choice([3, 5, 7, 11, 40], 200).astype(np.uint16) for _ in range(30)]
    counts = np.bincount(np.concatenate(texts), minlength=61).astype(np.int64)
    counts[60] = 30
    return lm.fit_model(texts, counts, steps=40)


def test_gradients_learn_a_pattern():
    """A sequence that only its past foretells is learnt: attention works."""
    cycle = np.tile([1, 2, 3, 4, 5, 6, 7, 8], 40).astype(np.uint16)
    counts = np.bincount(cycle, minlength=11).astype(np.int64) * 20
    counts[10] = 20
    m = lm.fit_model([cycle] * 20, counts, steps=150)
    assert lm.score_texts(m, [cycle])[0] / len(cycle) > -0.1


def test_probabilities_sum_to_one():
    m = small_model()
    before = np.array([3, 5, 7])
    total = sum(10 ** (lm.score_texts(m, [np.append(before, x)])[0] - 0) / 10 ** _end(m, np.append(before, x)) for x in range(60)) + 10 ** lm.score_texts(m, [before])[0]
    head = 10 ** (lm.score_texts(m, [before])[0] - _end(m, before))
    assert total / head == pytest.approx(1, abs=1e-4)


def _end(m, ids):
    """log10 of the end's probability after ids."""
    y = np.append(ids, m.vocab)
    c = m.of_in[np.append(m.vocab, y[:-1])]
    _, _, z = m.forward(c[None, :].astype(np.int64))
    z = z[0, -1].astype(np.float64)
    k = m.of_out[m.vocab]
    return (z[k] - np.log(np.exp(z - z.max()).sum()) - z.max()) / np.log(10) + float(m.within(y[-1:], c[-1:])[0])


@pytest.mark.parametrize("n", [0, 1, 23, 24, 31, 32, 33, 55, 56, 57, 200])
def test_windows_score_each_token_once(n):
    starts, before = lm.windows(n + 1)
    places = [p for s, b in zip(starts, before) for p in range(s + b, min(s + lm.WINDOW, n + 1))]
    assert places == list(range(n + 1))
    assert np.isfinite(lm.score_texts(small_model(), [np.full(n, 5, np.uint16)])).all()


def test_scoring_matches_one_window_at_a_time():
    m = small_model()
    rng = np.random.default_rng(3)
    texts = [rng.choice([3, 5, 7, 50], k) for k in (0, 5, 40, 100)]
    want = []
    for ids in texts:
        y = np.append(ids, m.vocab).astype(np.int64)
        c = m.of_in[np.append(m.vocab, y[:-1])]
        total = m.within(y, c).sum(dtype=np.float64)
        for s, b in zip(*lm.windows(len(y))):
            part = c[s : s + lm.WINDOW]
            _, _, z = m.forward(part[None, :])
            z = z[0].astype(np.float64)
            p = z - np.log(np.exp(z).sum(1, keepdims=True))
            for k in range(b, len(part)):
                total += p[k, m.of_out[y[s + k]]] / np.log(10)
        want.append(total)
    assert lm.score_texts(m, texts) == pytest.approx(np.array(want), rel=1e-4)


def test_scores_of_odd_rows(spark):
    data = [(1, "a b b"), (2, None), (2, None), (None, "B c"), (3, "zz\x0bzz"), (4, "")]
    df = spark.createDataFrame([(*r, 0.0) for r in data], "doc_id long, text string, score double")
    got = lm.score(df, F.coalesce(F.col("doc_id") == 3, F.lit(False))).collect()
    rows = {(r["doc_id"], r["n_tokens"], r["n_known"]) for r in got}
    assert rows == {(1, 4, 4), (2, 1, 1), (None, 3, 3), (3, 3, 1), (4, 1, 1)}
    assert len(got) == 6 and {r["train_tokens"] for r in got} == {4 + 1 + 1 + 3 + 1}
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 for r in lm.score(df, F.lit(True)).collect())
