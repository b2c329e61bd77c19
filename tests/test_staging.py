"""Shared staged tables: found again for the same plan on the same files, gone with their last lease."""

import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradescope.operators import staging as st
from tradescope.operators.staging import drop_staged, plan_name, stage_once, stage_root, staging
from verification import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3).write.parquet(f"{tmp_path}/t")
    return f"{tmp_path}/t"


def shared(spark, label):
    """Shared folders of a label that this application holds a lease on."""
    root = f"{stage_root(spark)}/tradescope/shared".removeprefix("file:")
    held = (n for n in (os.listdir(root) if os.path.isdir(root) else []) if n.startswith(label + "-"))
    own = spark.sparkContext.applicationId
    return sorted(n for n in held if any(f.startswith(own) for f in os.listdir(f"{root}/{n}/leases")))


def counted(spark, folder, k=3):
    return spark.read.parquet(folder).where(F.col("k") == k).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def test_the_name_follows_plan_files_and_settings(spark, folder):
    name = plan_name(counted(spark, folder))
    assert name and name == plan_name(counted(spark, folder))
    assert name != plan_name(counted(spark, folder, 4))
    assert name != plan_name(spark.read.parquet(folder).where("k = 3").groupBy("k").agg(F.sum("id").alias("n")))
    wide = spark.read.parquet(folder).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    other = spark.read.parquet(folder).select(*[(F.col("id") + i + int(i == 59)).alias(f"c{i}") for i in range(60)])
    assert plan_name(wide) != plan_name(other)
    spark.range(3).selectExpr("id", "id AS k").write.mode("append").parquet(folder)
    assert name != plan_name(counted(spark, folder))


def test_without_files_or_a_determined_result_there_is_no_name(spark, folder):
    assert plan_name(spark.createDataFrame([(1,)], "a int")) is None
    assert plan_name(spark.read.parquet(folder).withColumn("r", F.rand())) is None
    assert plan_name(spark.read.parquet(folder).withColumn("r", F.monotonically_increasing_id())) is None
    in_subquery = spark.createDataFrame([(1,)], "a int").agg(F.max("a").alias("m")).scalar()
    assert plan_name(spark.read.parquet(folder).where(F.col("k") == in_subquery)) is None
    assert stage_once(spark.createDataFrame([(1,)], "a int"), "plain").count() == 1 and not shared(spark, "plain")


def test_staged_once_and_gone_with_the_last_lease(spark, folder):
    with staging(spark):
        first = stage_once(counted(spark, folder), "leased").collect()
        (one,) = shared(spark, "leased")
        data = f"{stage_root(spark)}/tradescope/shared/{one}/data".removeprefix("file:")
        written = os.stat(data).st_mtime_ns
        with staging(spark):
            assert stage_once(counted(spark, folder), "leased").collect() == first
            assert stage_once(counted(spark, folder, 5), "leased").collect() != first
            assert len(shared(spark, "leased")) == 2
        # The inner scope held the only lease of its own table, and one of two of the other.
        assert shared(spark, "leased") == [one] and os.stat(data).st_mtime_ns == written
    assert shared(spark, "leased") == []
    stage_once(counted(spark, folder), "leased")
    assert shared(spark, "leased") == [one]
    drop_staged(spark)
    assert shared(spark, "leased") == []


def test_a_changed_file_is_staged_anew_and_a_scope_ends_after_an_error(spark, folder):
    with pytest.raises(RuntimeError), staging(spark):
        before = stage_once(counted(spark, folder), "changed").first().n
        time.sleep(0.01)
        shutil.copy(next(f"{folder}/{f}" for f in sorted(os.listdir(folder)) if f.endswith(".parquet")), f"{folder}/more.parquet")
        assert stage_once(counted(spark, folder), "changed").first().n > before
        assert len(shared(spark, "changed")) == 2
        raise RuntimeError
    assert shared(spark, "changed") == []


def test_old_leases_do_not_count(spark, folder, monkeypatch):
    with staging(spark):
        stage_once(counted(spark, folder), "dead")
        (one,) = shared(spark, "dead")
        left = f"{stage_root(spark)}/tradescope/shared/{one}/leases/gone-application".removeprefix("file:")
        open(left, "w").close()
        os.utime(left, (1, 1))
    assert not os.path.exists(os.path.dirname(os.path.dirname(left)))


@pytest.mark.parametrize("last", ["", "spark.stop()"])
def test_leases_end_with_the_interpreter(folder, tmp_path, last):
    program = f"""
from pyspark.sql import SparkSession
from tradescope.operators.staging import stage_once
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", "{tmp_path}/staged").getOrCreate()
stage_once(spark.read.parquet("{folder}").where("k = 1"), "short")
import os
print(os.listdir("{tmp_path}/staged/tradescope/shared"))
{last}
"""
    said = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=120, cwd=ROOT)
    assert "short-" in said.stdout, said.stderr[-2000:]
    assert os.listdir(f"{tmp_path}/staged/tradescope/shared") == []


def test_a_second_insights_joins_no_fact(spark, monkeypatch):
    drop_staged(spark)
    first = catalog.queries()["insights"](spark, SF).collect()
    facts, customers = shared(spark, "sales_rollup"), shared(spark, "customers")
    assert len(facts) == len(customers) == 1
    writes = []
    real = st.Store.at
    monkeypatch.setattr(st.Store, "at", lambda self, folder: writes.append(folder) or real(self, folder))
    assert catalog.queries()["insights"](spark, SF).collect() == first
    assert not [w for w in writes if "/writing-" in w] and shared(spark, "sales_rollup") == facts
    assert catalog.queries()["report_lines"](spark, SF).count() > 8
    assert shared(spark, "sales_rollup") == facts
    drop_staged(spark)
