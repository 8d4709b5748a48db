"""The database of a query is one for the driver and executors that are processes of their own."""

import datetime
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewire.sources import clients

CLUSTER = """
import sys
from pyspark.sql import SparkSession
from tidewire.plans import all_queries, registry
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{sys.argv[2]}", "spark.local.dir": sys.argv[2]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", registry.QUERIES["database_orders"](spark, sys.argv[1]).count())
"""


def test_orders_on_executors_of_their_own(spark, sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    said = subprocess.run([sys.executable, "-c", CLUSTER, sf_dir, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    want = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").count()
    assert f"ROWS {want}\n" in said.stdout, said.stderr[-2000:]


def test_every_value_comes_back(spark, tmp_path):
    url = f"sqlite:{tmp_path}/db"
    rows = [(k if k % 7 else None, f"o{k % 3}" if k % 5 else None, float("nan") if k == 1 else k / 4, datetime.date(2024, 1, 1 + k % 28) if k % 4 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, s string, d double, t date").repartition(5)
    for _ in range(2):  # a table that is there is emptied
        clients.write_table(df, url, "ROWS")
    got = clients.read_parts(spark, url, "ROWS", "k", 8, fetch_rows=9)
    assert got.rdd.getNumPartitions() == 8 and got.dtypes == df.dtypes
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    assert sorted(map(repr, map(tuple, got.filter(F.col("s").isin("o1", "o2") & (F.col("k") == 11)).collect()))) == sorted(repr(r) for r in rows if r[1] in ("o1", "o2") and r[0] == 11)
    clients.write_table(df.limit(0), url, "ROWS")
    assert clients.read_parts(spark, url, "ROWS", "k", 8).count() == 0
    with pytest.raises(ValueError, match="boolean"):
        clients.write_table(df.select(F.lit(True).alias("b")), url, "ROWS")
