"""One query per operator, over the tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfit.functions import (
    median_avg,
    order_stat,
    residual_mae,
    residual_weights,
    shrink_pair,
    soft_threshold,
    soft_threshold_each,
)
from blockfit.model import Model
from blockfit.operators import blocks as B
from blockfit.operators import evaluate as H
from blockfit.operators import linalg as L
from blockfit.operators import prepare as P
from blockfit.operators.score import predict_class, predict_linear
from blockfit.plans import coding as E
from blockfit.plans.consensus import consensus_lasso, consensus_smlr, umlr_consensus
from blockfit.plans.descent import (
    consecutive_batch,
    least_squares_gd,
    positioned,
    sample_batch,
    umlr_adam,
    umlr_minibatch,
)
from blockfit.plans.rounds import current_weights
from blockfit.plans.sharing import sharing_lasso, sharing_smlr, umlr_sharing
from blockfit.session import scratch_path
from blockfit.sources import (
    from_table,
    load_model,
    load_train_test,
    read_labeled_csv,
    read_labeled_text,
    save_model,
    write_residuals,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def total(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


# --- inputs shared by the queries ------------------------------------------------------------

def part_features() -> list[Column]:
    return [F.col("p_partkey") / 1000, F.col("p_size") / 50]



def part_regression(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(table(spark, sf, "part"), part_features(), F.col("p_retailprice") / 1000, "p_partkey")


def part_slope(spark: SparkSession, sf: str) -> DataFrame:
    features = [F.col("p_partkey") / 1000]
    return from_table(table(spark, sf, "part"), features, F.col("p_retailprice") / 1000, "p_partkey")


def part_binary(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(table(spark, sf, "part"), part_features(), (F.col("p_size") > 25).cast("int"), "p_partkey")


def part_three(spark: SparkSession, sf: str) -> DataFrame:
    label = F.floor((F.col("p_size") - 1) / 17).cast("int")
    return from_table(table(spark, sf, "part"), part_features(), label, "p_partkey")


def embedding_rows(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")


def embedding_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Label: the largest of the first three coordinates, the first one among equals."""
    first = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    label = (F.array_position(first, F.array_max(first)) - 1).cast("int")
    return from_table(table(spark, sf, "embeddings"), "embedding", label, "vec_id")


def order_states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two state tables ``<block_id, x>``: means and maxima of orders per block."""
    orders = P.with_block_column(
        table(spark, sf, "orders").withColumn("block", F.pmod("o_orderkey", F.lit(4))), "block"
    )
    price, cust = F.col("o_totalprice") / 1e5, F.col("o_custkey") / 1e3
    grouped = orders.groupBy("block_id")
    return (
        grouped.agg(F.array(F.avg(price), F.avg(cust)).alias("x")),
        grouped.agg(F.array(F.max(price), F.max(cust)).alias("x")),
    )


def label_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


def weight_table(model: Model) -> DataFrame:
    return model.weights.select("class_idx", "feature_idx", r6("weight").alias("weight"))


SOFTMAX_W = np.array([[0.3, -0.2, 0.1], [-0.5, 0.4, 0.2]])


# --- sources and sinks -----------------------------------------------------------------------


@query
def profile(spark, sf):
    return P.profile(embedding_rows(spark, sf))


@query
def text_round_trip(spark, sf):
    path = scratch_path(spark, "text")
    line = F.concat_ws(",", "p_retailprice", F.concat_ws(" ", "p_partkey", "p_size"))
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    rows = read_labeled_text(spark, path)
    return rows.agg(
        F.count("*").alias("num_rows"),
        F.sum(F.round(F.col("label") * 100).cast("long")).alias("label_cents"),
        F.sum(F.col("features")[0].cast("long")).alias("sum_key"),
        F.sum(F.col("features")[1].cast("long")).alias("sum_size"),
    )


@query
def csv_train_test(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    train_path, test_path = scratch_path(spark, "train"), scratch_path(spark, "test")
    is_test = F.pmod("p_partkey", F.lit(5)) == 0
    part.filter(~is_test).write.csv(train_path)
    part.filter(is_test).write.csv(test_path)
    train, test = load_train_test(spark, train_path, test_path)
    # one file split in two must give every row once
    again, held_out = load_train_test(spark, test_path)
    parts = [(train, "train"), (test, "test"), (again.unionByName(held_out), "resplit")]
    frames = [
        df.agg(
            F.lit(name).alias("part"),
            F.count("*").alias("num_rows"),
            F.sum(F.round(F.col("label") * 100).cast("long")).alias("label_cents"),
            F.sum(F.col("features")[0].cast("long")).alias("sum_key"),
            F.max(F.size("features")).alias("num_features"),
        )
        for df, name in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def csv_label_first(spark, sf):
    path = scratch_path(spark, "first")
    table(spark, sf, "part").select("p_retailprice", "p_partkey", "p_size").write.csv(path)
    rows = read_labeled_csv(spark, path, label="first")
    return rows.agg(
        F.count("*").alias("num_rows"),
        F.sum(F.round(F.col("label") * 100).cast("long")).alias("label_cents"),
        F.sum(F.col("features")[1].cast("long")).alias("sum_size"),
    )


def class_mean_model(spark: SparkSession, sf: str) -> Model:
    """The class means of the embeddings as a linear classifier (K x p numbers)."""
    means = E.class_mean(embedding_rows(spark, sf)).orderBy("label").collect()
    W = np.array([m["features"] for m in means]).T
    return Model(spark, W, [m["label"] for m in means])


@query
def model_round_trip(spark, sf):
    path = scratch_path(spark, "model")
    save_model(class_mean_model(spark, sf), path)
    weights = load_model(spark, path).weights
    return weights.select("class_idx", "class_label", "feature_idx", r6("weight").alias("weight"))


@query
def residual_sink(spark, sf):
    path = scratch_path(spark, "residuals")
    residual = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("test_id"), F.col("label").alias("class_label"), residual.alias("residual")
    )
    write_residuals(rows.withColumn("mae", residual_mae("residual")), path)
    back = spark.read.parquet(path)
    return back.groupBy("class_label").agg(
        F.count("*").alias("num_rows"), r6(F.sum("mae")).alias("sum_mae"), F.max(F.size("residual")).alias("width")
    )


# --- preparation -----------------------------------------------------------------------------


@query
def assembled(spark, sf):
    numeric = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    rows = P.assemble(numeric, "p_retailprice")
    x = F.col("features")
    return rows.select(x[0].alias("key"), x[1].alias("size"), F.size(x).alias("width"), "label")


@query
def label_index(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"))
    original = lines.withColumn("flag", F.col("label"))
    indexed, classes = P.index_labels(original)
    coded = P.one_hot(indexed, len(classes))
    hot = [F.sum(F.col("onehot")[i]).cast("long").alias(f"hot_{i}") for i in range(3)]
    return coded.groupBy("flag", F.col("label").cast("int").alias("class_idx")).agg(
        F.count("*").alias("num_rows"), *hot
    )


@query
def bias_append(spark, sf):
    x = F.col("features")
    rows = P.with_bias(part_regression(spark, sf))
    return rows.select("row_id", r6(x[0]).alias("f0"), r6(x[1]).alias("f1"), x[2].alias("bias"))


@query
def train_test_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    out = []
    for df, name in zip(P.train_test_split(rows, 0.2, by="key"), ("train", "test")):
        cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
        out.append(df.agg(F.lit(name).alias("part"), F.count("*").alias("num_rows"), cents))
    return out[0].unionByName(out[1])


@query
def kfold_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return P.k_fold(rows, 5, by="key").groupBy("fold").agg(
        F.count("*").alias("num_rows"), F.sum("row_id").alias("sum_id")
    )


@query
def stratified_pick(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("label")
    )
    train, test = P.stratified_pick(rows, 40, by="key")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("label", "part").agg(
        F.count("*").alias("num_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id")
    )


@query
def pick_classes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label"))
    return P.pick_classes(rows, 3, by="key").groupBy("label").agg(
        F.count("*").alias("num_rows"), F.sum("row_id").alias("sum_id")
    )


@query
def row_ids(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return P.with_row_id(orders, ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "row_id")


@query
def class_dictionary(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label"), "p_size"
    )
    first = rows.agg(F.min("label")).first()[0]
    return P.class_dictionary(rows, first)


@query
def block_column(spark, sf):
    sized = from_table(
        table(spark, sf, "part"), [*part_features(), F.col("p_size")], F.col("p_retailprice"), "p_partkey"
    )
    blocked = P.with_block_column(sized)
    return blocked.groupBy("block_id").agg(
        F.count("*").alias("num_rows"), F.sum("row_id").alias("sum_id"), F.max(F.size("features")).alias("width")
    )


# --- blocking --------------------------------------------------------------------------------


@query
def row_blocks(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return B.row_blocks(rows, 6, by="key").groupBy("block_id").agg(
        F.count("*").alias("num_rows"), F.sum("row_id").alias("sum_id")
    )


@query
def row_range_chunks(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return B.row_range_chunks(rows, 7).groupBy("block_id").agg(
        F.count("*").alias("num_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id")
    )


@query
def packed_chunks(spark, sf):
    rows = B.row_blocks(embedding_rows(spark, sf), 4, by="key")
    back = B.unpack_chunks(B.pack_chunks(rows, max_chunk_bytes=32 << 10))
    return back.groupBy("block_id").agg(
        F.count("*").alias("num_rows"),
        F.sum("row_id").alias("sum_id"),
        F.sum(F.col("label").cast("long")).alias("sum_label"),
        r6(F.sum(total("features"))).alias("sum_values"),
    )


def _feature_block_sums(spark, sf, policy: str) -> DataFrame:
    ranges = B.feature_blocks(64, 6, policy)
    parts = B.split_features(embedding_rows(spark, sf), ranges)
    return parts.groupBy("block_id").agg(
        F.count("*").alias("num_rows"), F.max(F.size("slice")).alias("width"), r6(F.sum(total("slice"))).alias("sum_values")
    )


@query
def feature_blocks_ceil(spark, sf):
    return _feature_block_sums(spark, sf, "ceil")


@query
def feature_blocks_balanced(spark, sf):
    return _feature_block_sums(spark, sf, "balanced")


@query
def placed_blocks(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    placed = B.place_blocks(B.row_blocks(rows, 10, by="key"), 4)
    where = placed.select("block_id", F.spark_partition_id().alias("partition"))
    return where.groupBy("block_id", "partition").agg(F.count("*").alias("num_rows"))


@query
def feature_block_view(spark, sf):
    view = B.feature_block_view(embedding_rows(spark, sf), B.feature_blocks(64, 3), rows_per_chunk=128)
    return view.select(
        "block_id",
        "chunk_id",
        F.size("row_ids").alias("num_rows"),
        F.col("row_ids")[0].alias("first_id"),
        F.element_at("row_ids", -1).alias("last_id"),
        r6(F.col("X")[0]).alias("first_value"),
        r6(total("X")).alias("sum_values"),
    )


# --- linear algebra --------------------------------------------------------------------------


@query
def gram_cross(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cents = [F.round(F.col(n) * 100).cast("long").alias(n) for n in names]
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), *cents)
    entries = L.column_gram(lines, [F.col(n) for n in names], ["flag"], whole=True)
    value = (F.col("value") / F.lit(10000).cast("decimal(5,0)")).cast("double")
    return entries.select("flag", "i", "j", value.alias("value"))


@query
def block_gram(spark, sf):
    rows = B.row_blocks(embedding_rows(spark, sf), 3, by="key")
    statistics = L.gram(rows, 64)
    entries = statistics.select("block_id", "n", F.posexplode("gram").alias("pos", "value"))
    return entries.groupBy("block_id", "n").agg(
        r6(F.sum(F.when(F.col("pos") % 65 == 0, F.col("value")))).alias("trace"), r6(F.sum("value")).alias("total")
    )


def part_with_nulls(spark, sf) -> DataFrame:
    """Every seventh label is null."""
    rows = part_regression(spark, sf)
    return rows.withColumn("label", F.when(F.col("row_id") % 7 != 0, F.col("label")))


@query
def gram_nulls(spark, sf):
    """Rows without a label count nowhere, be the statistics SQL sums or those of the kernel."""
    rows = B.row_blocks(part_with_nulls(spark, sf), 3, by="key")
    wide = F.concat("features", F.array(*[F.lit(0.0)] * 7))
    out = None
    for p, frame in ((2, rows), (9, rows.withColumn("features", wide))):
        one = L.gram(frame, p).select(
            F.lit(p).alias("width"),
            "block_id",
            "n",
            r6(F.col("gram")[0]).alias("g00"),
            r6(F.col("gram")[1]).alias("g01"),
            r6(F.col("cross")[0]).alias("c0"),
            r6("yy").alias("yy"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def block_cross(spark, sf):
    rows = B.row_blocks(part_regression(spark, sf), 3, by="key")
    return L.cross(rows, 2).select(
        "block_id", r6(F.col("cross")[0]).alias("c0"), r6(F.col("cross")[1]).alias("c1")
    )


@query
def margins_softmax(spark, sf):
    scored = L.softmax(L.margins(part_three(spark, sf), SOFTMAX_W))
    return scored.select(
        "row_id", *[r6(F.col("margins")[k]).alias(f"m{k}") for k in range(3)],
        *[r6(F.col("softmax")[k]).alias(f"s{k}") for k in range(3)],
    )


@query
def softmax_gradient(spark, sf):
    g = L.softmax_gradient(part_three(spark, sf), SOFTMAX_W, scale="mean")
    return g.select("feature_idx", "class_idx", r6("value").alias("value"))


@query
def softmax_loss(spark, sf):
    return L.umlr_loss(part_three(spark, sf), SOFTMAX_W, reg=0.01, eta=0.1).select(r6("loss").alias("loss"))


@query
def uncorrelated_penalty(spark, sf):
    means = E.class_mean(embedding_rows(spark, sf))
    weights = means.select(F.col("label").alias("class_idx"), F.posexplode("features").alias("feature_idx", "weight"))
    return L.uncorrelated(weights, eta=10.0).select(
        "class_idx", "feature_idx", r6("coefficient").alias("coefficient"), r6("penalty").alias("penalty")
    )


@query
def ls_gradient(spark, sf):
    g = L.ls_gradient(part_regression(spark, sf), np.array([0.25, 0.5]))
    return g.select("feature_idx", r6("value").alias("value"))


@query
def vector_sum(spark, sf):
    vectors = embedding_rows(spark, sf).select("label", "features")
    sums = L.vector_sum(vectors, "features", ["label"], fan_in=4)
    return sums.select("label", F.posexplode("features").alias("pos", "v")).select("label", "pos", r6("v").alias("value"))


@query
def block_mean(spark, sf):
    state, _ = order_states(spark, sf)
    mean = L.block_mean(state, "x")
    return mean.select(r6(F.col("x")[0]).alias("price"), r6(F.col("x")[1]).alias("customer"))


@query
def block_median(spark, sf):
    state, _ = order_states(spark, sf)
    return L.block_median(state, "x").select("pos", r6("value").alias("value"))


@query
def state_weights(spark, sf):
    state, _ = order_states(spark, sf)
    ranges = [(2 * i, 2 * i + 2) for i in range(4)]
    mean = current_weights(state, "mean").select(F.lit("mean").alias("kind"), "feature_idx", "value")
    concat = current_weights(state, "concat", ranges).select(F.lit("concat").alias("kind"), "feature_idx", "value")
    return mean.unionByName(concat).select("kind", "feature_idx", r6("value").alias("value"))


@query
def admm_residuals(spark, sf):
    state, previous = order_states(spark, sf)
    out = L.consensus_residuals(state, previous, rho=0.2)
    return out.select(r6("primal").alias("primal"), r6("dual").alias("dual"))


@query
def sharing_residuals(spark, sf):
    state, previous = order_states(spark, sf)
    rows = table(spark, sf, "orders").select(
        F.array(F.col("o_totalprice") / 1e5).alias("abar"), F.array(F.col("o_custkey") / 1e3).alias("z")
    )
    out = L.sharing_residuals(rows, state, previous, num_blocks=4)
    return out.select(r6("primal").alias("primal"), r6("dual").alias("dual"))


@query
def coefficient_change(spark, sf):
    a, b = (s.select("block_id", F.posexplode("x").alias("pos", "weight")) for s in order_states(spark, sf))
    return L.mean_abs_change(a, b, ["block_id", "pos"]).select(r6("diff").alias("diff"))


@query
def solve_blocks(spark, sf):
    rows = B.row_blocks(part_regression(spark, sf), 3, by="key")
    solved = L.solve_blocks(L.gram(rows, 2), s=0.5, r=2.0)
    x = F.col("solution")
    return solved.select("block_id", r6(x[0]).alias("x0"), r6(x[1]).alias("x1"))


# --- shrinkage and robust weights ------------------------------------------------------------


@query
def soft_thresholds(spark, sf):
    customers = table(spark, sf, "customer")
    pair = F.array("c_acctbal", F.col("c_acctbal") / 2)
    each = soft_threshold_each(pair, F.array(F.lit(1000.0), F.lit(500.0) + F.col("c_nationkey")))
    return customers.select(
        "c_custkey",
        r6(soft_threshold("c_acctbal", 1000.0)).alias("one"),
        r6(soft_threshold_each(pair, 700.0)[1]).alias("same"),
        r6(each[0]).alias("each_0"),
        r6(each[1]).alias("each_1"),
    )


@query
def shrink_pairs(spark, sf):
    lo, hi = F.col("c_acctbal") - 2000, F.col("c_acctbal") + 500
    return table(spark, sf, "customer").select("c_custkey", r6(shrink_pair(lo, hi)).alias("value"))


@query
def residual_weight(spark, sf):
    rows = embedding_rows(spark, sf)
    means = E.class_mean(rows).withColumnRenamed("features", "mean")
    squared = F.zip_with("features", "mean", lambda a, b: (a - b) * (a - b))
    coded = rows.join(means, "label").select("row_id", squared.alias("r"))
    w = residual_weights("r", t=0.7, c=1.0)
    return coded.select(
        "row_id", r6(order_stat("r", 0.7)).alias("cut"), r6(total(w)).alias("sum_w"), r6(w[0]).alias("first_w")
    )


@query
def residual_mae_rows(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        r6(residual_mae(F.col("embedding").cast("array<double>"))).alias("truncated"),
        r6(residual_mae(F.col("embedding").cast("array<double>"), exact=True)).alias("exact"),
    )


@query
def median_avg_rows(spark, sf):
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(median_avg(values)).alias("even"), r6(median_avg(F.slice(values, 1, 63))).alias("odd")
    )


@query
def class_mean(spark, sf):
    means = E.class_mean(embedding_rows(spark, sf))
    return means.select("label", F.posexplode("features").alias("pos", "v")).select("label", "pos", r6("v").alias("value"))


@query
def collect_vectors(spark, sf):
    parts = E.collect_vectors(embedding_rows(spark, sf), "label", rows_per_part=150, by="range")
    return parts.select(
        "label",
        "part",
        F.size("vectors").alias("num_rows"),
        F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("ids"),
        r6(F.element_at("vectors", -1)[63]).alias("last_value"),
    )


# --- from a file to a model ------------------------------------------------------------------


def part_file(spark, sf, lines: Callable[[DataFrame], DataFrame], write: Callable) -> str:
    """Several files, written in parallel, whose order and that of their lines is the order of the keys."""
    path = scratch_path(spark, "rows")
    ranged = table(spark, sf, "part").repartitionByRange(6, "p_partkey").sortWithinPartitions("p_partkey")
    write(lines(ranged), path)
    return path


@query
def file_row_ids(spark, sf):
    path = part_file(
        spark,
        sf,
        lambda part: part.select("p_partkey", "p_size", "p_retailprice"),
        lambda rows, path: rows.write.csv(path),
    )
    rows = read_labeled_csv(spark, path)
    return rows.select(F.col("features")[0].cast("long").alias("p_partkey"), "row_id", F.round("label", 2).alias("label"))


@query
def text_row_ids(spark, sf):
    path = part_file(
        spark,
        sf,
        lambda part: part.select(F.concat_ws(",", "p_size", F.concat_ws(" ", "p_partkey", "p_retailprice")).alias("value")),
        lambda rows, path: rows.write.text(path),
    )
    rows = read_labeled_text(spark, path)
    return rows.select(F.col("features")[0].cast("long").alias("p_partkey"), "row_id", "label")


@query
def csv_to_lasso(spark, sf):
    path = part_file(
        spark,
        sf,
        lambda part: part.select(*part_features(), F.col("p_retailprice") / 1000),
        lambda rows, path: rows.write.csv(path),
    )
    rows = read_labeled_csv(spark, path)
    model = consensus_lasso(rows, lam=0.5, rho=1.0, num_blocks=3, max_iter=20, tol=-1, block_by="key")
    error = H.mae(predict_linear(rows, model)).select(r6("mae").alias("mae"))
    # a row for each weight against one row
    return weight_table(model).crossJoin(F.broadcast(error))


@query
def text_to_umlr(spark, sf):
    path = part_file(
        spark,
        sf,
        lambda part: part.select(
            F.concat_ws(",", (F.col("p_size") > 25).cast("int"), F.concat_ws(" ", *part_features())).alias("value")
        ),
        lambda rows, path: rows.write.text(path),
    )
    rows = read_labeled_text(spark, path)
    model = umlr_adam(rows, lr=0.01, eta=1e-4, epochs=10)
    right = H.accuracy(predict_class(rows, model)).select(r6("accuracy").alias("accuracy"))
    return weight_table(model).crossJoin(F.broadcast(right))


# --- batches ---------------------------------------------------------------------------------


@query
def consecutive_rows(spark, sf):
    rows = positioned(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")))
    n = rows.count()
    out = None
    for step in range(8):
        batch = consecutive_batch(rows, -(-n // 7), step, n).agg(
            F.lit(step).alias("step"), F.count("*").alias("num_rows"), F.min("row_id").alias("first_id")
        )
        out = batch if out is None else out.unionByName(batch)
    return out


@query
def consecutive_all(spark, sf):
    """Every row of a table with gaps in its ids, with the step of the cycle that takes it."""
    rows = table(spark, sf, "orders").where("o_custkey % 3 <> 0").select((F.col("o_orderkey") + 1000).alias("row_id"))
    rows = positioned(rows)
    n = rows.count()
    steps = [consecutive_batch(rows, -(-n // 5), step, n).withColumn("step", F.lit(step)) for step in range(5)]
    out = steps[0]
    for batch in steps[1:]:
        out = out.unionByName(batch)
    return out.select("row_id", "step")


@query
def sampled_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    n = rows.count()
    first, second = (sample_batch(rows, n // 3, step, num_rows=n) for step in (0, 1))
    return first.agg(F.count("*").alias("first")).crossJoin(second.agg(F.count("*").alias("second")))


# --- trainers --------------------------------------------------------------------------------


@query
def consensus_lasso_weights(spark, sf):
    return weight_table(
        consensus_lasso(
            part_regression(spark, sf), lam=0.5, rho=1.0, num_blocks=3, max_iter=20, tol=-1, block_by="key"
        )
    )


@query
def sharing_lasso_weights(spark, sf):
    return weight_table(sharing_lasso(part_regression(spark, sf), lam=0.5, rho=0.2, max_iter=10, tol=-1))


@query
def sharing_lasso_history(spark, sf):
    model = sharing_lasso(part_regression(spark, sf), lam=0.5, rho=0.2, max_iter=11, tol=0.0, check_every=5)
    return model.history.select("round", r6("primal").alias("primal"), r6("dual").alias("dual"))


@query
def umlr_consensus_weights(spark, sf):
    return weight_table(umlr_consensus(part_binary(spark, sf), num_blocks=3, epochs=20, block_by="key"))


@query
def umlr_adam_weights(spark, sf):
    return weight_table(umlr_adam(part_binary(spark, sf), lr=0.01, eta=1e-4, epochs=10))


@query
def umlr_minibatch_weights(spark, sf):
    rows = part_binary(spark, sf)
    batch = -(-rows.count() // 6)
    return weight_table(
        umlr_minibatch(rows, batch_size=batch, epochs=8, lr=0.05, reg=0.01, eta=0.1, update="adam")
    )


@query
def umlr_minibatch_split(spark, sf):
    """The train part of a split has gaps in its ids; six windows cover it."""
    rows = P.train_test_split(part_binary(spark, sf), by="key")[0]
    batch = -(-rows.count() // 6)
    return weight_table(
        umlr_minibatch(rows, batch_size=batch, epochs=8, lr=0.05, reg=0.01, eta=0.1, update="adam")
    )


def _full_batch_rule(spark, sf, update: str) -> DataFrame:
    model = umlr_minibatch(part_binary(spark, sf), epochs=8, lr=0.1, reg=0.01, eta=0.1, update=update)
    return weight_table(model)


@query
def umlr_sgd_weights(spark, sf):
    return _full_batch_rule(spark, sf, "sgd")


@query
def umlr_momentum_weights(spark, sf):
    return _full_batch_rule(spark, sf, "momentum")


@query
def umlr_rmsprop_weights(spark, sf):
    return _full_batch_rule(spark, sf, "rmsprop")


@query
def umlr_sharing_weights(spark, sf):
    return weight_table(umlr_sharing(part_binary(spark, sf), num_blocks=2, epochs=6, eta=0.01))


@query
def least_squares_weights(spark, sf):
    n = table(spark, sf, "part").count()
    return weight_table(least_squares_gd(part_regression(spark, sf), lr=0.2 / n, epochs=20))


# the same trainers where nothing but the answer fits the driver


@query
def consensus_lasso_table(spark, sf):
    rows = part_regression(spark, sf)
    model = consensus_lasso(rows, 0.5, 1.0, 3, max_iter=20, tol=-1, block_by="key", stats_limit=0)
    return weight_table(model)


@query
def sharing_lasso_table(spark, sf):
    rows = part_regression(spark, sf)
    return weight_table(sharing_lasso(rows, lam=0.5, rho=0.2, max_iter=10, tol=-1, stats_limit=0))


@query
def umlr_consensus_table(spark, sf):
    return weight_table(umlr_consensus(part_binary(spark, sf), num_blocks=3, epochs=20, block_by="key", stats_limit=0))


@query
def umlr_sharing_table(spark, sf):
    return weight_table(umlr_sharing(part_binary(spark, sf), num_blocks=2, epochs=6, eta=0.01, stats_limit=0))


@query
def least_squares_table(spark, sf):
    n = table(spark, sf, "part").count()
    return weight_table(least_squares_gd(part_regression(spark, sf), lr=0.2 / n, epochs=20, stats_limit=0))


@query
def consensus_smlr_weights(spark, sf):
    model = consensus_smlr(
        embedding_classes(spark, sf), lam=0.01, rho=1.0, alpha=0.01, num_blocks=5, max_iter=10, tol=-1
    )
    return weight_table(model)


def _small_smlr(spark, sf, **limits) -> DataFrame:
    args = dict(num_blocks=3, max_iter=4, tol=-1, local_steps=3, block_by="key")
    return weight_table(consensus_smlr(part_binary(spark, sf), 0.01, 1.0, 0.01, **args, **limits))


@query
def consensus_smlr_small(spark, sf):
    return _small_smlr(spark, sf)


@query
def consensus_smlr_table(spark, sf):
    return _small_smlr(spark, sf, stats_limit=0)


@query
def consensus_smlr_passes(spark, sf):
    return _small_smlr(spark, sf, stats_limit=0, max_block_bytes=1)


@query
def sharing_smlr_weights(spark, sf):
    model = sharing_smlr(
        embedding_classes(spark, sf), lam=0.01, rho=0.01, alpha=0.01, num_blocks=4, max_iter=5, tol=-1
    )
    return weight_table(model)


def _small_sharing(spark, sf, **limits) -> DataFrame:
    args = dict(lam=0.05, rho=0.5, alpha=0.05, num_blocks=2, max_iter=4, tol=-1, inner_iter=2, z_steps=2)
    return weight_table(sharing_smlr(part_binary(spark, sf), **args, **limits))


@query
def sharing_smlr_small(spark, sf):
    return _small_sharing(spark, sf)


@query
def sharing_smlr_small_table(spark, sf):
    return _small_sharing(spark, sf, stats_limit=0)


def _small_codes(spark, sf, **limits) -> DataFrame:
    """Every fifth part coded on the others, of either class."""
    rows = part_binary(spark, sf)
    held_out = F.pmod("row_id", F.lit(5)) == 0
    return E.huber_sparse_code(rows.where(held_out).drop("label"), rows.where(~held_out), **limits)


def _code_rows(codes: DataFrame) -> DataFrame:
    return codes.select("test_id", "class_label", r6("mae").alias("mae"), F.size("residual").alias("width"))


@query
def huber_code_small(spark, sf):
    return _code_rows(_small_codes(spark, sf))


@query
def huber_code_tiled(spark, sf):
    """No class counts as small: test chunks and dictionary chunks meet in the cells of a grid."""
    return _code_rows(_small_codes(spark, sf, max_dictionary_bytes=0, test_chunk_bytes=4096, cell_bytes=8192))


@query
def huber_classify_small(spark, sf):
    found = E.classify_by_residual(_small_codes(spark, sf))
    return found.select("test_id", "prediction", r6("mae").alias("mae"))


def _codes(spark, sf) -> DataFrame:
    train, test = P.train_test_split(embedding_rows(spark, sf), 0.2, by="key")
    return E.huber_sparse_code(test.drop("label"), train)


@query
def huber_code(spark, sf):
    return _codes(spark, sf).select("test_id", "class_label", r6("mae").alias("mae"), F.size("residual").alias("width"))


@query
def huber_classify(spark, sf):
    return E.classify_by_residual(_codes(spark, sf)).select("test_id", "prediction", r6("mae").alias("mae"))


# --- scoring and evaluation ------------------------------------------------------------------


@query
def predict_linear_rows(spark, sf):
    model = Model(spark, np.array([[0.4], [0.8]]))
    scored = predict_linear(part_regression(spark, sf), model)
    return scored.select("row_id", r6("prediction").alias("prediction"))


@query
def predict_nulls(spark, sf):
    """A vector that is null or holds a null has no prediction, at any width."""
    rows = part_regression(spark, sf)
    holed = F.when(F.col("row_id") % 5 == 0, F.array(F.lit(None).cast("double"), F.lit(1.0))).when(
        F.col("row_id") % 7 != 0, F.col("features")
    )
    rows = rows.withColumn("features", holed)
    wide = rows.withColumn("features", F.concat("features", F.array(*[F.lit(0.0)] * 68)))
    narrow = predict_linear(rows, Model(spark, np.array([[0.4], [0.8]])))
    other = predict_linear(wide, Model(spark, np.array([[0.4], [0.8]] + [[0.0]] * 68)))
    other = other.select("row_id", F.col("prediction").alias("wide"))
    both = narrow.join(other, "row_id")
    return both.select("row_id", *[F.coalesce(r6(c), F.lit(-1.0)).alias(n) for c, n in (("prediction", "narrow"), ("wide", "wide"))])


@query
def predict_class_rows(spark, sf):
    scored = predict_class(embedding_rows(spark, sf), class_mean_model(spark, sf))
    return scored.select("row_id", "prediction")


@query
def predict_with_bias(spark, sf):
    W = np.vstack([SOFTMAX_W, [0.05, -0.1, 0.0]])
    model = Model(spark, W, ["low", "mid", "high"], bias=True)
    scored = predict_class(part_three(spark, sf), model)
    return scored.select("row_id", "prediction")


@query
def attach_truth(spark, sf):
    pred = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("n_chars") > 1000).cast("int").alias("prediction")
    )
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return H.attach_truth(pred, truth)


@query
def accuracy(spark, sf):
    out = H.accuracy(label_predictions(spark, sf))
    return out.select(r6("accuracy").alias("accuracy"), r6("error_rate").alias("error_rate"))


@query
def micro_macro_precision(spark, sf):
    out = H.micro_macro_precision(label_predictions(spark, sf))
    return out.select(r6("micro").alias("micro"), r6("macro").alias("macro"))


@query
def mae(spark, sf):
    return H.mae(label_predictions(spark, sf)).select(r6("mae").alias("mae"))


def _slope_fit(n: int) -> Callable:
    return lambda train: least_squares_gd(train, lr=0.5 / n, epochs=40)


@query
def validate_linear(spark, sf):
    rows = part_slope(spark, sf)
    train, test = P.train_test_split(rows, 0.2, by="key")
    out = H.validate(train, test, _slope_fit(rows.count()), predict_linear, H.mae)
    return out.select(r6("mae").alias("mae"))


@query
def cross_validate_ls(spark, sf):
    rows = part_slope(spark, sf)
    _, summary = H.cross_validate(rows, _slope_fit(rows.count()), predict_linear, H.mae, k=5, by="key")
    return summary.select(*[r6(c).alias(c) for c in ("mean", "max", "min")])


def _folds_of_classes(spark, sf) -> tuple[DataFrame, DataFrame]:
    def fit(train):
        return umlr_consensus(train, epsilon=0.5, rho=0.1, eta=0.01, num_blocks=2, epochs=5, block_by="key")

    rows = part_binary(spark, sf)
    return H.cross_validate(rows, fit, predict_class, H.micro_macro_precision, k=3, by="key")


@query
def cross_validate_classes(spark, sf):
    per_fold, _ = _folds_of_classes(spark, sf)
    return per_fold.select("fold", r6("micro").alias("micro"), r6("macro").alias("macro"))


@query
def cross_validate_summary(spark, sf):
    """Every metric is summarised over the folds."""
    _, summary = _folds_of_classes(spark, sf)
    return summary.select("metric", *[r6(c).alias(c) for c in ("mean", "max", "min")])


@query
def linear_mae(spark, sf):
    """Flagship: split, consensus lasso on the training rows, score and measure the rest."""
    train, test = P.train_test_split(part_regression(spark, sf), 0.2, by="key")
    model = consensus_lasso(train, lam=0.5, rho=1.0, num_blocks=3, max_iter=20, tol=-1, block_by="key")
    return H.mae(predict_linear(test, model)).select(r6("mae").alias("mae"))
