import numpy as np
import pytest

from blockfit.model import Model
from blockfit.operators import evaluate as H
from blockfit.operators import linalg as L
from blockfit.plans.descent import least_squares_gd
from blockfit.operators.score import predict_linear
from blockfit.session import checkpoint_dir, scratch_path
from blockfit.sources import from_table, load_model, load_train_test, read_labeled_csv, read_labeled_text, save_model


def test_csv_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.5,2,0\n3,4,1\n5,6,1\n")
    rows = read_labeled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r["label"], r["features"]) for r in rows) == [(0, [1.5, 2]), (1, [3, 4]), (1, [5, 6])]
    (tmp_path / "b.txt").write_text("-0.4,1 2  3\n2,4 5 6\n")
    rows = read_labeled_text(spark, str(tmp_path / "b.txt")).collect()
    assert sorted((r["label"], r["features"]) for r in rows) == [(-0.4, [1, 2, 3]), (2, [4, 5, 6])]
    a, b = load_train_test(spark, str(tmp_path / "a.csv"))
    assert a.count() + b.count() == 3


def _with_splits(spark, size, make):
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        return make()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [0, 64 << 20])
@pytest.mark.parametrize("kind", ["csv", "text"])
def test_row_ids_do_not_depend_on_the_splits(spark, tmp_path, kind, limit, monkeypatch):
    monkeypatch.setattr("blockfit.operators.prepare.number_file_rows.__defaults__", ("row_id", limit))
    lines = []
    for k, name in enumerate(["a", "b", "c"]):
        own = [f"{k}.5,{k * 1000 + i}" for i in range((3000, 1, 1700)[k])]
        (tmp_path / f"part-{name}.txt").write_text("\n".join([*own, "", ""]))
        lines += own
    read = read_labeled_text if kind == "text" else lambda s, p: read_labeled_csv(s, p, label="first")

    def ids():
        rows = read(spark, str(tmp_path))
        return rows.rdd.getNumPartitions() if limit else 0, [
            r["features"][0] for r in sorted(rows.collect(), key=lambda r: r["row_id"])
        ], sorted(r["row_id"] for r in rows.collect())

    found = [_with_splits(spark, size, ids) for size in ("1k", "7000b", "64m")]
    for _, values, numbers in found:
        assert values == [float(x.split(",")[1]) for x in lines] and numbers == list(range(len(lines)))
    assert not limit or found[0][0] > 20 > found[2][0]


def test_files_split_otherwise_after_counting_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},1\n" for i in range(5000)))
    rows = _with_splits(spark, "2k", lambda: read_labeled_csv(spark, str(tmp_path / "a.csv")))
    with pytest.raises(Exception, match="split otherwise"):
        _with_splits(spark, "3k", rows.collect)


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    rows = read_labeled_csv(spark, str(tmp_path / "a.csv"), num_columns=3)
    assert rows.collect() == [] and rows.columns == ["row_id", "label", "features"]


def test_vector_column_is_accepted(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, 2.0, Vectors.sparse(3, [1], [5.0]))], ["id", "y", "v"])
    row = from_table(df, "v", "y", "id").first()
    assert (row["row_id"], row["label"], row["features"]) == (1, 2.0, [0.0, 5.0, 0.0])


def test_model_round_trip(spark, tmp_path):
    model = Model(spark, np.arange(8.0).reshape(4, 2), ["a", "b"], True, [{"round": 0, "diff": 0.5}], {"lam": 1})
    save_model(model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(back.W, model.W)
    assert (back.classes, back.bias, back.params, back.num_features) == (["a", "b"], True, {"lam": 1}, 3)
    assert back.history_rows[0]["diff"] == 0.5


def test_checkpoint_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert configured in checkpoint_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_macro_precision_counts_labels_of_the_truth_only(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "z"), ("a", "z")]
    out = H.micro_macro_precision(spark.createDataFrame(rows, ["label", "prediction"])).first()
    assert out["micro"] == pytest.approx(2 / 5)
    assert out["macro"] == pytest.approx((1 + 0.5 + 0) / 3)


def test_cross_validation_summary(spark, frame):
    X = np.random.default_rng(1).normal(size=(100, 1))
    per_fold, summary = H.cross_validate(
        frame(X, 2 * X[:, 0]), lambda d: least_squares_gd(d, lr=1e-3, epochs=5), predict_linear, H.mae, k=3
    )
    values = [r["mae"] for r in per_fold.collect()]
    row = summary.first()
    assert row["mean"] == pytest.approx(np.mean(values)) and row["max"] == max(values) and row["min"] == min(values)


def test_upper_median_and_even_average(spark):
    state = spark.createDataFrame([(i, [float(v), -float(v)]) for i, v in enumerate([4, 1, 3, 2])], "block_id int, x array<double>")
    got = {r["pos"]: r["value"] for r in L.block_median(state, "x").collect()}
    assert got == {0: 3.0, 1: -2.0}
    from blockfit.functions import median_avg

    assert spark.range(1).select(median_avg(L.F.array(*[L.F.lit(v) for v in (4.0, 1.0, 3.0, 2.0)]))).first()[0] == 2.5


def test_wide_gram_is_the_product(frame):
    rng = np.random.default_rng(2)
    X, y, block = rng.normal(size=(300, 20)), rng.normal(size=300), np.arange(300) % 3
    for row in L.gram(frame(X, y, block_id=block), 20).collect():
        A, b = X[block == row["block_id"]], y[block == row["block_id"]]
        np.testing.assert_allclose(np.array(row["gram"]).reshape(20, 20), A.T @ A)
        np.testing.assert_allclose(row["cross"], A.T @ b)
        assert row["n"] == 100 and row["yy"] == pytest.approx(b @ b)


def test_plans_prune_and_push_down(spark):
    from catalog.queries import part_regression

    plan = part_regression(spark, "/root/testdata/sf0.001").filter("row_id < 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in text and "PushedFilters: [IsNotNull(p_partkey), LessThan(p_partkey" in text
