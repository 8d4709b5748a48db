"""Chains whose numbers begin like an allowed path, chains with gaps: the same verdicts as the SQL."""

import duckdb

from tidewire.llm import queries


def test_chained_verdicts_of_all_numbers(spark, tmp_path):
    ids = [*range(375, 380), *range(3675, 3680), *range(35, 40), 45, 46, 48, 49, 60, 61, 62, 90, 93, 94, 94]  # 75, 735 and 7, then chains with gaps
    spark.createDataFrame([(k,) for k in ids], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.chained_verdicts(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.execute(queries.ORACLE_SQL["chained_verdicts"]).fetchall()))
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {*range(375, 380), *range(3675, 3680), 45, 46, 48, 49, 90, 93, 94}
