import os
import subprocess
import sys
import types
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.llm import common


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


def _session(**conf):
    return types.SimpleNamespace(conf=_Conf({k.replace("_", "."): v for k, v in conf.items()}))


def test_shared_dir():
    assert common.shared_dir(_session(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(_session(spark_master=master))
    own = _session(spark_master="local[4]")
    assert os.path.isdir(common.shared_dir(own)) and common.shared_dir(own) == common.shared_dir(own)


def test_written_without_the_setting():
    code = """
from pyspark.sql import SparkSession
from tidewater.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = common.written(spark, spark.range(3), "test")
print("rows", df.count(), common.shared_dir(spark) == common.shared_dir(spark))
common.forget(df)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2])
    assert "rows 3 True" in done.stdout, done.stderr[-2000:]


def test_forget(spark):
    df = common.written(spark, spark.range(3), "test")
    assert os.path.isdir(df._written_to)
    common.forget(df)
    assert not os.path.exists(df._written_to)


def test_kept_has_room_for_one():
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [common.kept(k, make(k)) for k in "aabba"] == list("aabba") and made == ["a", "b", "a"]


def test_ascii_lower(spark):
    df = spark.createDataFrame([("AbÇÉ",), ("XYZ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()] == ["abÇÉ", "xyz", "", None]


def test_written_survives_its_source(spark):
    df = common.written(spark, spark.range(10).selectExpr("id", "id % 3 AS k"), "test")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
