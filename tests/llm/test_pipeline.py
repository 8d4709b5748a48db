"""The pipeline on small documents, stage by stage against plain versions."""

import corpus_pipeline
from tests.llm import brute


def documents():
    base = {"en": "the cat and the dog of the house were in the garden when it rained on", "es": "el gato y el perro de la casa estaban en el campo cuando llueve sobre"}
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "es"
        rows.append((k, f"{base[lang]} number {k} {' '.join(base[lang].split()[k % 9 :])} {k * k}", lang))
    rows += [(100, rows[3][1], "en"), (101, "12345 !!", "en"), (102, None, None), (103, "and here is the secret item of the test set that leaks into the garden of the dog", "en"), (104, "qzxv wkjq zzzq xxqj vvkz", "en")]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]


def test_stages(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "here is the secret item of the test set that leaks")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {d: t for d, t, *_ in docs}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = dict(kept)
        now = stage(spark, now, str(tmp_path))
        if name == "language_id":
            kept = {d: t for d, t in kept.items() if t and any(c.isalpha() for c in t) and d != 104}  # 104 is in no language
        elif name == "exact_dedup":
            kept = {d: t for d, t, *_ in [(x[0], kept[x[0]]) for x in brute.exact(list(kept.items())) if x[3]]}
        elif name == "simhash_near_dedup":
            kept = {d: kept[d] for d, _, c in brute.near_groups(list(kept.items())) if d == c}
        elif name == "decontamination":
            kept = {x[0]: kept[x[0]] for x in brute.decontaminated(list(kept.items()), items) if not x[5]}
            assert 103 not in kept
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in now.collect()} == set(kept), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(now.columns) == sorted(corpus_pipeline.COLUMNS)
        assert len(kept) <= len(before)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated and null ids, null columns, empty tables and columns that bear the names which operators add."""
    good = documents()[0][1]
    odd = [(1, good, "en", None), (1, good, "en", "a"), (None, good + " more of it", None, "b"), (None, None, "es", "c"), (2, "", None, "d"), *((d, t, lang, "e") for d, t, lang, *_ in documents()[1:60])]
    kinds = "doc_id long, text string, lang string, source string, score string, kept string, contaminated string, tw_row string, n_chars long"
    rows = [(d, t, lang, s, f"s{k}", f"k{k}", f"c{k}", f"r{k}", 0) for k, (d, t, lang, s) in enumerate(odd)]
    spark.createDataFrame([(1, "no such words here at all in any text of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("some", rows), ("none", [])):
        now = spark.createDataFrame(data, kinds)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        before = {tuple(r) for r in now.collect()}
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == [c.split()[0] for c in kinds.split(", ")]
                got = [tuple(r) for r in now.collect()]
                assert len(set(got)) == len(got) and set(got) <= before, stage
                if name == "some":
                    assert got
                if stage == "exact_dedup":
                    texts = [r[1] for r in got]
                    assert len(set(texts)) == len(texts)
                before = set(got)
        assert now.select("doc_id").count() >= len(before)
