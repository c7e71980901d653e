"""Queries over files, on tables of more rows than one file holds."""

import pandas as pd
from pyspark.sql import functions as F

from brindle.plans.queries import QUERIES
from brindle.sources import files


def parts(spark, path, n):
    p = spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") / 4).alias("p_retailprice"))
    p.write.parquet(f"{path}/part.parquet")
    return str(path)


def test_matlab_in_many_files(spark, tmp_path):
    got = QUERIES["files_matlab"](spark, parts(spark, tmp_path, 110_000))
    assert got.agg(F.count("*"), F.count_distinct("p_partkey"), F.count_if(F.col("p_retailprice") == F.col("p_partkey") / 4)).first() == (110_000,) * 3


def test_small_files_share_frames():
    many = pd.DataFrame({"path": [f"f{k}" for k in range(3000)], "content": [b"ab", b"", b"c"] * 1000})
    got = list(files._rows(iter([many]), lambda b: ((x,) for x in b), ["x"]))
    assert len(got) == 1 and got[0].values.tolist()[:4] == [["f0", 0, 97], ["f0", 1, 98], ["f2", 0, 99], ["f3", 0, 97]]
    large = many.assign(content=[bytes(5001)] * 3000).head(3)
    assert [len(x) for x in files._rows(iter([large]), lambda b: ((x,) for x in b), ["x"])] == [5000, 5000, 5000, 3]


def test_messages_need_no_join(spark, tmp_path):
    got = QUERIES["protobuf_fields"](spark, parts(spark, tmp_path, 500))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("*"), F.sum("key"), F.count_if(F.col("name") == F.concat(F.lit("part "), "key"))).first() == (500, 125_250, 500)


def test_plist_files_are_bounded(spark, tmp_path):
    files.write(spark.range(10_500).coalesce(1), f"{tmp_path}/out", "plist")
    assert files.find_files(spark, f"{tmp_path}/out", "part-*").count() == 2
