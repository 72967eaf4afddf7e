"""The aggregation tree: levels from bytes and partitions, bounded reads, right sums."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockfit.operators import linalg, trees
from blockfit.operators.linalg import driver_sum, gram


@pytest.mark.parametrize("partials", [1, 2, 63, 64, 65, 4096, 800_000])
@pytest.mark.parametrize("num_bytes", [1, 8, 500_000, 64 << 20, 1 << 31])
def test_levels_bound_what_a_task_reads(partials, num_bytes):
    levels = trees.tree_levels(partials, num_bytes)
    fan_in = max(2, trees.READ_LIMIT // num_bytes)
    before = partials
    for left in levels:
        assert before <= left * fan_in and left < before
        before = left
    assert before <= fan_in
    assert not levels or len(levels) <= np.ceil(np.log(partials) / np.log(fan_in))


@pytest.fixture(scope="module")
def vectors(spark):
    """30 partitions with one vector of each of three groups."""
    rng = np.random.default_rng(1)
    table = rng.integers(-9, 9, size=(90, 20)).astype(float)
    frame = spark.createDataFrame(
        pa.table({"g": pa.array(np.arange(90) % 3), "at": pa.array(np.arange(90) // 3, pa.int32()), "v": pa.array(list(table), pa.list_(pa.float64()))})
    )
    return frame.repartitionById(30, F.col("at")).drop("at"), table


@pytest.mark.parametrize("segment,limit", [(1 << 16, 1 << 20), (1 << 16, 160 * 4), (7, 56 * 2), (7, 56 * 5)])
def test_sums_are_right_at_any_depth(vectors, monkeypatch, segment, limit):
    frame, table = vectors
    monkeypatch.setattr(trees, "SEGMENT", segment)
    monkeypatch.setattr(trees, "READ_LIMIT", limit)
    got = trees.tree_sum(frame, "v", ["g"], width=20, num_partials=30, num_groups=3)
    found = {r.g: r.v for r in got.collect()}
    assert sorted(found) == [0, 1, 2]
    for g in range(3):
        np.testing.assert_allclose(found[g], table[g::3].sum(axis=0), atol=1e-12)
    (whole,) = trees.tree_sum(frame, "v", width=20, num_partials=30).collect()
    np.testing.assert_allclose(whole.v, table.sum(axis=0), atol=1e-12)
    fresh = trees.tree_sum(frame, "v", ["g"], width=20, num_partials=30, num_groups=3)
    exchanges = fresh._jdf.queryExecution().executedPlan().toString().count("direct_shuffle_partition_id(_task")
    assert exchanges == len(trees.tree_levels(30, 8 * min(20, segment), limit))


@pytest.mark.parametrize("fan_in", [2, 4, 7])
def test_no_task_of_a_level_reads_more_than_its_share(vectors, fan_in):
    frame, _ = vectors
    left, rows = 30, frame
    while left > fan_in:
        left = -(-left // fan_in)
        dealt = trees.level_of(rows, ["g"], left, 3, fan_in)
        counts = dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert max(r["count"] for r in counts) <= fan_in and len(counts) == 3 * left
        rows = dealt.groupBy("g", "_place", "_task").agg(F.count("*").alias("n")).drop("_task")
    assert rows.count() <= 3 * fan_in


def test_every_statistic_takes_the_tree(spark, frame, monkeypatch):
    rng = np.random.default_rng(3)
    X, y = rng.normal(size=(80, 12)), rng.normal(size=80)
    df = frame(X, y, parts=8)
    W = rng.normal(size=(12, 3))
    labels = df.withColumn("label", F.pmod("row_id", F.lit(3)).cast("double"))
    made = {
        "gram": lambda: gram(df, 12).select(F.explode("gram").alias("v")),
        "small gram": lambda: gram(frame(X[:, :3], y, parts=8), 3).select(F.explode("gram").alias("v")),
        "least squares": lambda: linalg.ls_gradient(df, W[:, 0]).select(F.col("value").alias("v")),
        "small least squares": lambda: linalg.ls_gradient(frame(X[:, :3], y, parts=8), W[:3, 0]).select(F.col("value").alias("v")),
        "wide softmax": lambda: linalg.softmax_gradient(labels, np.tile(W, 3)).select(F.col("value").alias("v")),
        "softmax": lambda: linalg.softmax_gradient(labels, W).select(F.col("value").alias("v")),
    }
    plain = {name: make().toPandas().v.to_numpy() for name, make in made.items()}
    monkeypatch.setattr(trees, "READ_LIMIT", 2 * 8 * 3)
    for name, make in made.items():
        deep = make()
        np.testing.assert_allclose(deep.toPandas().v.to_numpy(), plain[name], rtol=1e-9, atol=1e-12)
        plan = deep._jdf.queryExecution().executedPlan().toString()
        assert "_place" in plan, name


def test_driver_sum_by_tree(spark, vectors, monkeypatch):
    frame, table = vectors
    want = table.sum(axis=0)
    for limit in (1 << 20, 0):
        monkeypatch.setattr(linalg, "PARTIALS_LIMIT", limit)
        monkeypatch.setattr(trees, "READ_LIMIT", 400)
        np.testing.assert_allclose(driver_sum(frame, 30, {"v": 20})["v"], want, atol=1e-12)


def test_partition_bound_follows_the_files(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    least = max(spark.sparkContext.defaultParallelism, 4)
    assert trees.partition_bound(rows) == least
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert trees.partition_bound(rows) > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert trees.partition_bound(spark.createDataFrame([(1,)], "a int")) >= 1
