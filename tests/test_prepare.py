import numpy as np
import pytest
from pyspark.sql import functions as F

from blockfit.operators import blocks as B
from blockfit.operators import prepare as P
from blockfit.operators.select import kth_smallest
from blockfit.plans.coding import collect_vectors
from blockfit.plans.descent import batch_start, consecutive_batch, sample_batch


def test_label_index_conventions(frame):
    for labels in ([1.0, 2.0, 3.0], [0.0, 1.0, 2.0], ["b", "c", "d"]):
        df = frame(np.zeros((6, 1)), labels * 2)
        indexed, classes = P.index_labels(df)
        assert classes == labels
        assert sorted(r["label"] for r in indexed.collect()) == [0, 0, 1, 1, 2, 2]


def test_label_index_with_many_classes(frame):
    labels = [f"c{i:03d}" for i in range(60)]
    indexed, classes = P.index_labels(frame(np.zeros((60, 1)), labels))
    got = {r["row_id"]: r["label"] for r in indexed.collect()}
    assert classes == labels and got == {i: float(i) for i in range(60)}


def test_hash_split_ignores_layout(frame):
    X, y = np.zeros((500, 1)), np.zeros(500)
    a = P.train_test_split(frame(X, y, parts=2), 0.2)[1]
    order = np.random.default_rng(0).permutation(500)
    b = P.train_test_split(frame(X, y, ids=order, parts=7), 0.2)[1]
    ids = sorted(r["row_id"] for r in a.collect())
    assert ids == sorted(r["row_id"] for r in b.collect())
    assert 60 < len(ids) < 140


def test_random_split_keeps_all_rows(frame):
    train, test = P.train_test_split(frame(np.zeros((300, 1)), np.zeros(300)), 0.2, by="random")
    assert train.count() + test.count() == 300


def test_folds_cover_all_rows(frame):
    df = P.k_fold(frame(np.zeros((400, 1)), np.zeros(400)), 5)
    counts = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert sorted(counts) == [0, 1, 2, 3, 4] and sum(counts.values()) == 400


def test_stratified_pick_with_hot_and_single_class(frame):
    labels = ["hot"] * 4000 + ["few"] * 5 + ["one"]
    df = frame(np.zeros((len(labels), 1)), labels)
    train, test = P.stratified_pick(df, 50, seed=3)
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts == {"hot": 50, "few": 4}
    assert train.count() + test.count() == len(labels)
    hashes = df.select("row_id", "label", F.xxhash64("row_id", F.lit(3)).alias("h")).toPandas()
    want = set(hashes[hashes.label == "hot"].nsmallest(50, "h").row_id)
    assert {r["row_id"] for r in train.filter("label = 'hot'").collect()} == want


def test_kth_smallest_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr("blockfit.operators.select._LAST_SORT", 3)
    values = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(v), i % 2) for i, v in enumerate(values)], "v long, g int")
    ranks = df.groupBy("g").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(1234).cast("long").alias("k"), F.count("*").alias("n")
    )
    got = {r["g"]: r["cut"] for r in kth_smallest(df, "v", ranks, "g").collect()}
    assert got == {g: np.sort(values[g::2])[1233] for g in (0, 1)}


@pytest.mark.parametrize("most", [100_000, 0])
def test_kth_smallest_of_large_and_small_groups(spark, monkeypatch, most):
    monkeypatch.setattr("blockfit.operators.select._LAST_SORT", 50)
    rng = np.random.default_rng(4)
    group = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 200, 6000))
    values = rng.permutation(10**6)[:6000] - 500_000
    rows = [(int(v), int(g) or None if g != 0 else 0) for v, g in zip(values, group)] + [(7, None), (8, None)]
    df = spark.createDataFrame(rows, "v long, g int").repartition(5)
    half = F.ceil(F.count("*") / 2)
    ranks = df.groupBy("g").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), half.alias("k"), F.count("*").alias("n")
    )
    got = {r["g"]: r["cut"] for r in kth_smallest(df, "v", ranks, "g", most).collect()}
    want = {int(g): int(np.sort(values[group == g])[(sum(group == g) + 1) // 2 - 1]) for g in set(group)}
    assert got == want


def test_cuts_of_many_classes_do_not_pass_the_driver(spark):
    rows = spark.range(300_000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") < 100_000, 0).otherwise(F.col("id") % 50_000 + 1).alias("label"),
        F.array(F.lit(0.0)).alias("features"),
    )
    train, test = P.stratified_pick(rows, 2, by="key", max_broadcast=1000)
    assert "BroadcastHashJoin" not in train._jdf.queryExecution().executedPlan().toString()
    got = train.groupBy("label").agg(F.count("*").alias("n"), F.max("row_id").alias("last"))
    assert got.filter("n = 2").count() == got.count() == 50_001
    assert got.filter("label = 0").first()["last"] == 1 and test.count() == 300_000 - 2 * 50_001


def test_row_ids_follow_the_order(frame):
    ids = np.random.default_rng(2).permutation(700) * 3
    df = frame(np.zeros((700, 1)), np.zeros(700), ids=ids).withColumnRenamed("row_id", "key")
    got = {r["key"]: r["row_id"] for r in P.with_row_id(df, "key").collect()}
    assert got == {3 * i: i for i in range(700)}


def test_feature_block_policies():
    with pytest.raises(ValueError):
        B.feature_blocks(8, 6, "ceil")
    with pytest.raises(ValueError):
        B.feature_blocks(4, 3, "ceil")
    assert B.feature_blocks(8, 3, "ceil") == [(0, 3), (3, 6), (6, 8)]
    assert B.feature_blocks(8, 3, "balanced") == [(0, 2), (2, 5), (5, 8)]


def test_pack_splits_a_hot_block_and_keeps_every_row(frame):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(3000, 5))
    block = np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 5, 3000))
    chunks = B.pack_chunks(frame(X, np.arange(3000.0), block_id=block), max_chunk_bytes=4000).persist()
    per_block = {r["block_id"]: (r["n"], r["c"]) for r in chunks.groupBy("block_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
    assert {b: n for b, (n, _) in per_block.items()} == {b: int((block == b).sum()) for b in range(5)}
    assert per_block[0][1] >= 20
    assert chunks.select("chunk_id").distinct().count() == chunks.count()
    back = B.unpack_chunks(chunks).toPandas().sort_values("row_id")
    np.testing.assert_array_equal(np.stack(back.features), X)


def test_pack_is_the_same_for_any_order(frame):
    X = np.random.default_rng(4).normal(size=(900, 3))
    blocks = np.arange(900) % 2

    def contents(parts, order):
        df = frame(X[order], order.astype(float), ids=order, parts=parts, block_id=blocks[order])
        rows = B.pack_chunks(df, 4, max_chunk_bytes=2000).select("block_id", "chunk_id", "row_ids").collect()
        return sorted((r["block_id"], r["chunk_id"], tuple(r["row_ids"])) for r in rows)

    assert contents(2, np.arange(900)) == contents(5, np.arange(900)[::-1].copy())


def test_pack_rejects_ragged_rows(spark):
    df = spark.createDataFrame([(0, 1.0, [1.0, 2.0]), (1, 1.0, [1.0])], "row_id long, label double, features array<double>")
    with pytest.raises(Exception, match="number of features"):
        B.pack_chunks(df.coalesce(1)).count()


def test_random_batch_is_exact_and_changes(frame, monkeypatch):
    monkeypatch.setattr("blockfit.plans.descent._LAST_FETCH", 2)
    df = frame(np.zeros((1000, 1)), np.zeros(1000))
    first = {r["row_id"] for r in sample_batch(df, 123, 0).collect()}
    second = {r["row_id"] for r in sample_batch(df, 123, 1).collect()}
    assert len(first) == len(second) == 123 and first != second
    assert sample_batch(df, 5000).count() == 1000


def test_consecutive_batches_wrap(frame):
    assert [batch_start(4, t, 10) for t in range(5)] == [0, 4, 8, 0, 4]
    df = frame(np.zeros((10, 1)), np.zeros(10))
    assert sorted(r["row_id"] for r in consecutive_batch(df, 4, 2).collect()) == [8, 9]


def test_batches_go_by_position_not_by_id(frame):
    ids = np.r_[1000:1030:3, [1030] * 5, 9000]
    df = frame(np.zeros((len(ids), 1)), np.zeros(len(ids)), ids=ids)
    met = [r["row_id"] for t in range(4) for r in consecutive_batch(df, 4, t).collect()]
    assert sorted(met) == sorted(ids.tolist())
    same = frame(np.zeros((1000, 1)), np.zeros(1000), ids=np.full(1000, 7))
    assert sample_batch(same, 10).count() == 10


def test_collect_vectors_bounds_the_parts(frame):
    labels = [1] * 2000 + [2] * 30
    X = np.arange(2030.0).reshape(-1, 1)
    parts = collect_vectors(frame(X, labels), "label", rows_per_part=200).toPandas()
    assert parts.vectors.map(len).max() < 400
    assert (parts.label == 2).sum() == 1
    assert sorted(v[0] for vs in parts.vectors for v in vs) == list(range(2030))
