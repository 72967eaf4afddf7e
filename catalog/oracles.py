"""SQL for the queries of :mod:`catalog.queries`, over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# sums of vectors and of products follow the rows in any order, hence the rounding
_PART = """part_rows AS (
  SELECT p_partkey AS id, p_partkey / 1000.0::DOUBLE AS a, p_size / 50.0::DOUBLE AS b,
         p_retailprice / 1000.0::DOUBLE AS y, CAST(p_size > 25 AS INTEGER) AS l,
         CAST(floor((p_size - 1) / 17.0::DOUBLE) AS INTEGER) AS l3
  FROM part)"""

_EMB = """emb AS (
  SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS v,
         generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""

_STATES = """price AS (
  SELECT o_orderkey % 4 AS block_id, o_totalprice / 1e5 AS p, o_custkey / 1e3 AS c FROM orders),
st AS (
  SELECT block_id, avg(p) AS x0, avg(c) AS x1, max(p) AS q0, max(c) AS q1 FROM price GROUP BY block_id)"""


def shrink(a: str, k: str) -> str:
    return f"(greatest({a} - {k}, 0) - greatest(-({a} + {k}), 0))"


ORACLES["profile"] = """
SELECT count(*) AS num_rows, count(DISTINCT label) AS num_classes, CAST(max(len(embedding)) AS INTEGER) AS num_features
FROM embeddings"""

ORACLES["text_round_trip"] = """
SELECT count(*) AS num_rows, CAST(sum(round(p_retailprice * 100)) AS BIGINT) AS label_cents,
       CAST(sum(p_partkey) AS BIGINT) AS sum_key, CAST(sum(p_size) AS BIGINT) AS sum_size FROM part"""

ORACLES["csv_train_test"] = """
SELECT part, count(*) AS num_rows, CAST(sum(round(p_retailprice * 100)) AS BIGINT) AS label_cents,
       CAST(sum(p_partkey) AS BIGINT) AS sum_key, 2 AS num_features
FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, * FROM part
      UNION ALL SELECT 'resplit' AS part, * FROM part WHERE p_partkey % 5 = 0)
GROUP BY part"""

ORACLES["csv_label_first"] = """
SELECT count(*) AS num_rows, CAST(sum(round(p_retailprice * 100)) AS BIGINT) AS label_cents,
       CAST(sum(p_size) AS BIGINT) AS sum_size FROM part"""

ORACLES["model_round_trip"] = f"""
WITH {_EMB}
SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx, CAST(label AS BIGINT) AS class_label,
       CAST(pos AS INTEGER) AS feature_idx, round(avg(v), 6) AS weight
FROM emb GROUP BY label, pos"""

ORACLES["residual_sink"] = """
SELECT label AS class_label, count(*) AS num_rows,
       round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:len(embedding)-1], lambda v: abs(v)))
             / len(embedding)), 6) AS sum_mae,
       CAST(max(len(embedding)) AS INTEGER) AS width
FROM embeddings GROUP BY label"""

ORACLES["assembled"] = """
SELECT CAST(p_partkey AS DOUBLE) AS key, CAST(p_size AS DOUBLE) AS size, 2 AS width,
       p_retailprice AS label FROM part"""

ORACLES["label_index"] = """
WITH c AS (SELECT l_returnflag AS flag, count(*) AS num_rows FROM lineitem GROUP BY 1),
i AS (SELECT flag, num_rows, CAST(row_number() OVER (ORDER BY flag) - 1 AS INTEGER) AS class_idx FROM c)
SELECT flag, class_idx, num_rows,
       CASE WHEN class_idx = 0 THEN num_rows ELSE 0 END AS hot_0,
       CASE WHEN class_idx = 1 THEN num_rows ELSE 0 END AS hot_1,
       CASE WHEN class_idx = 2 THEN num_rows ELSE 0 END AS hot_2 FROM i"""

ORACLES["bias_append"] = f"""
WITH {_PART} SELECT id AS row_id, round(a, 6) AS f0, round(b, 6) AS f1, 1.0::DOUBLE AS bias FROM part_rows"""

ORACLES["train_test_counts"] = """
SELECT CASE WHEN o_orderkey % 100 < 20 THEN 'test' ELSE 'train' END AS part, count(*) AS num_rows,
       CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents
FROM orders GROUP BY 1"""

ORACLES["kfold_counts"] = """
SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, count(*) AS num_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_id
FROM orders GROUP BY 1"""

ORACLES["stratified_pick"] = """
WITH r AS (
  SELECT c_mktsegment AS label, c_custkey AS id,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn,
         count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT label, CASE WHEN rn <= least(40, n - 1) THEN 'train' ELSE 'test' END AS part,
       count(*) AS num_rows, min(id) AS first_id, max(id) AS last_id
FROM r GROUP BY 1, 2"""

ORACLES["pick_classes"] = """
SELECT p_brand AS label, count(*) AS num_rows, CAST(sum(p_partkey) AS BIGINT) AS sum_id FROM part
WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 3) GROUP BY 1"""

ORACLES["row_ids"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id FROM orders"""

ORACLES["class_dictionary"] = """
SELECT p_partkey AS row_id, p_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)"""

ORACLES["block_column"] = """
SELECT CAST(p_size AS INTEGER) AS block_id, count(*) AS num_rows, CAST(sum(p_partkey) AS BIGINT) AS sum_id,
       2 AS width FROM part GROUP BY 1"""

ORACLES["row_blocks"] = """
SELECT CAST(o_orderkey % 6 AS INTEGER) AS block_id, count(*) AS num_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_id
FROM orders GROUP BY 1"""

ORACLES["row_range_chunks"] = """
SELECT CAST(floor(o_orderkey / ceil((SELECT count(*) FROM orders) / 7.0)) AS INTEGER) AS block_id,
       count(*) AS num_rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id
FROM orders GROUP BY 1"""

ORACLES["packed_chunks"] = """
SELECT vec_id % 4 AS block_id, count(*) AS num_rows, CAST(sum(vec_id) AS BIGINT) AS sum_id,
       CAST(sum(label) AS BIGINT) AS sum_label, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS sum_values
FROM embeddings GROUP BY 1"""


def _feature_blocks(case: str) -> str:
    return f"""
WITH {_EMB}, c AS (SELECT CAST({case} AS INTEGER) AS block_id, id, pos, v FROM emb)
SELECT block_id, count(DISTINCT id) AS num_rows, CAST(count(DISTINCT pos) AS INTEGER) AS width, round(sum(v), 6) AS sum_values
FROM c GROUP BY 1"""


ORACLES["feature_blocks_ceil"] = _feature_blocks("floor(pos / 11.0)")
ORACLES["feature_blocks_balanced"] = _feature_blocks(
    "CASE WHEN pos < 20 THEN floor(pos / 10.0) ELSE 2 + floor((pos - 20) / 11.0) END"
)

ORACLES["placed_blocks"] = """
SELECT CAST(o_orderkey % 10 AS INTEGER) AS block_id, CAST(o_orderkey % 10 % 4 AS INTEGER) AS partition,
       count(*) AS num_rows FROM orders GROUP BY 1, 2"""

ORACLES["feature_block_view"] = f"""
WITH {_EMB}, c AS (
  SELECT CASE WHEN pos < 21 THEN 0 WHEN pos < 42 THEN 1 ELSE 2 END AS block_id,
         CAST(floor(id / 128.0) AS BIGINT) AS chunk_id, id, pos, v FROM emb)
SELECT block_id, chunk_id, CAST(count(DISTINCT id) AS INTEGER) AS num_rows, min(id) AS first_id, max(id) AS last_id,
       round(arg_min(v, id * 64 + pos), 6) AS first_value, round(sum(v), 6) AS sum_values
FROM c GROUP BY 1, 2"""

_names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLES["gram_cross"] = " UNION ALL ".join(
    f"""SELECT l_returnflag AS flag, {i} AS i, {j} AS j,
  CAST(sum(CAST({_names[i]} AS DECIMAL(15,2)) * CAST({_names[j]} AS DECIMAL(15,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1"""
    for i in range(4)
    for j in range(i, 4)
)

ORACLES["block_gram"] = """
SELECT vec_id % 3 AS block_id, count(*) AS n,
       round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))), 6) AS trace,
       round(sum(pow(list_sum(CAST(embedding AS DOUBLE[])), 2)), 6) AS total
FROM embeddings GROUP BY 1"""

_NULL_GRAM = """SELECT {w} AS width, id % 3 AS block_id, count(*) AS n, round(sum(a * a), 6) AS g00,
       round(sum(a * b), 6) AS g01, round(sum(a * y), 6) AS c0, round(sum(y * y), 6) AS yy
FROM part_rows WHERE id % 7 <> 0 GROUP BY 2"""
ORACLES["gram_nulls"] = f"WITH {_PART} {_NULL_GRAM.format(w=2)} UNION ALL {_NULL_GRAM.format(w=9)}"

ORACLES["block_cross"] = f"""
WITH {_PART} SELECT id % 3 AS block_id, round(sum(a * y), 6) AS c0, round(sum(b * y), 6) AS c1
FROM part_rows GROUP BY 1"""

_W = [[0.3, -0.2, 0.1], [-0.5, 0.4, 0.2]]
_SOFT = f"""{_PART},
m AS (SELECT *, {", ".join(f"a * {_W[0][k]} + b * {_W[1][k]} AS m{k}" for k in range(3))} FROM part_rows),
e AS (SELECT *, exp(m0) + exp(m1) + exp(m2) AS d FROM m),
s AS (SELECT *, exp(m0) / d AS s0, exp(m1) / d AS s1, exp(m2) / d AS s2 FROM e)"""

ORACLES["margins_softmax"] = f"""
WITH {_SOFT} SELECT id AS row_id, {", ".join(f"round(m{k}, 6) AS m{k}, round(s{k}, 6) AS s{k}" for k in range(3))}
FROM s"""

ORACLES["softmax_gradient"] = f"WITH {_SOFT} " + " UNION ALL ".join(
    f"SELECT {i} AS feature_idx, {k} AS class_idx, "
    f"round(sum({x} * (s{k} - CAST(l3 = {k} AS INTEGER))) / count(*), 6) AS value FROM s"
    for i, x in enumerate("ab")
    for k in range(3)
)

_norm = [_W[0][k] ** 2 + _W[1][k] ** 2 for k in range(3)]
_pairs = _norm[0] * _norm[1] + _norm[0] * _norm[2] + _norm[1] * _norm[2]
ORACLES["softmax_loss"] = f"""
WITH {_SOFT}
SELECT round(avg(-ln(greatest(CASE l3 WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1e-10)))
       + 0.5 * 0.01 * {sum(_norm)} + 0.5 * 0.1 * {_pairs}, 6) AS loss FROM s"""

ORACLES["uncorrelated_penalty"] = f"""
WITH {_EMB}, w AS (SELECT label, pos, avg(v) AS w FROM emb GROUP BY 1, 2),
n AS (SELECT label, sum(w * w) AS norm FROM w GROUP BY 1),
c AS (SELECT label, (SELECT sum(norm) FROM n) - norm AS coefficient FROM n)
SELECT label AS class_idx, CAST(pos AS INTEGER) AS feature_idx, round(coefficient, 6) AS coefficient,
       round(10 * w * coefficient, 6) AS penalty FROM w JOIN c USING (label)"""

ORACLES["ls_gradient"] = f"""
WITH {_PART}, e AS (SELECT *, a * 0.25 + b * 0.5 - y AS e FROM part_rows)
SELECT 0 AS feature_idx, round(sum(a * e), 6) AS value FROM e
UNION ALL SELECT 1, round(sum(b * e), 6) FROM e"""

ORACLES["vector_sum"] = f"""
WITH {_EMB} SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v), 6) AS value FROM emb GROUP BY 1, 2"""

ORACLES["block_mean"] = f"""
WITH {_STATES} SELECT round(avg(x0), 6) AS price, round(avg(x1), 6) AS customer FROM st"""

ORACLES["block_median"] = f"""
WITH {_STATES}
SELECT 0 AS pos, round(list_sort(list(x0))[len(list(x0)) // 2 + 1], 6) AS value FROM st
UNION ALL SELECT 1, round(list_sort(list(x1))[len(list(x1)) // 2 + 1], 6) FROM st"""

ORACLES["state_weights"] = f"""
WITH {_STATES}
SELECT 'mean' AS kind, 0 AS feature_idx, round(avg(x0), 6) AS value FROM st
UNION ALL SELECT 'mean', 1, round(avg(x1), 6) FROM st
UNION ALL SELECT 'concat', CAST(block_id * 2 AS INTEGER), round(x0, 6) FROM st
UNION ALL SELECT 'concat', CAST(block_id * 2 + 1 AS INTEGER), round(x1, 6) FROM st"""

ORACLES["admm_residuals"] = f"""
WITH {_STATES}, m AS (SELECT avg(x0) AS a0, avg(x1) AS a1, avg(q0) AS b0, avg(q1) AS b1, count(*) AS n FROM st)
SELECT round((SELECT sum(sqrt(pow(x0 - a0, 2) + pow(x1 - a1, 2))) FROM st, m), 6) AS primal,
       round(n * 0.2 * 0.2 * sqrt(pow(a0 - b0, 2) + pow(a1 - b1, 2)), 6) AS dual FROM m"""

ORACLES["sharing_residuals"] = f"""
WITH {_STATES}
SELECT round((SELECT 4 * sqrt(sum(pow(p - c, 2))) FROM price), 6) AS primal,
       round((SELECT sum(sqrt(pow(x0 - q0, 2) + pow(x1 - q1, 2))) FROM st), 6) AS dual"""

ORACLES["coefficient_change"] = f"""
WITH {_STATES} SELECT round(avg(d), 6) AS diff
FROM (SELECT abs(x0 - q0) AS d FROM st UNION ALL SELECT abs(x1 - q1) FROM st)"""

_GRAM = "sum(a * a) AS g00, sum(a * b) AS g01, sum(b * b) AS g11, sum(a * y) AS c0, sum(b * y) AS c1"
ORACLES["solve_blocks"] = f"""
WITH {_PART}, g AS (SELECT id % 3 AS block_id, {_GRAM} FROM part_rows GROUP BY 1),
s AS (SELECT block_id, c0, c1, 0.5 * g00 + 2 AS h00, 0.5 * g01 AS h01, 0.5 * g11 + 2 AS h11 FROM g)
SELECT block_id, round((h11 * c0 - h01 * c1) / (h00 * h11 - h01 * h01), 6) AS x0,
       round((h00 * c1 - h01 * c0) / (h00 * h11 - h01 * h01), 6) AS x1 FROM s"""

ORACLES["soft_thresholds"] = f"""
SELECT c_custkey, round({shrink("c_acctbal", "1000")}, 6) AS one, round({shrink("c_acctbal / 2", "700")}, 6) AS same,
       round({shrink("c_acctbal", "1000")}, 6) AS each_0,
       round({shrink("c_acctbal / 2", "(500 + c_nationkey)")}, 6) AS each_1 FROM customer"""

ORACLES["shrink_pairs"] = """
SELECT c_custkey, round(CASE WHEN c_acctbal - 2000 > 0 THEN c_acctbal - 2000
  WHEN c_acctbal + 500 < 0 THEN c_acctbal + 500 ELSE 0 END, 6) AS value FROM customer"""

ORACLES["residual_weight"] = f"""
WITH {_EMB}, m AS (SELECT label, pos, avg(v) AS mean FROM emb GROUP BY 1, 2),
r AS (SELECT id, pos, pow(v - mean, 2) AS r FROM emb JOIN m USING (label, pos)),
c AS (SELECT id, list_sort(list(r))[CAST(floor(count(*) * 0.7) AS INTEGER) + 1] AS cut FROM r GROUP BY 1)
SELECT id AS row_id, round(any_value(cut), 6) AS cut,
       round(sum(1 / (1 + exp(1 / cut * (r - cut)))), 6) AS sum_w,
       round(max(CASE WHEN pos = 0 THEN 1 / (1 + exp(1 / cut * (r - cut))) END), 6) AS first_w
FROM r JOIN c USING (id) GROUP BY 1"""

ORACLES["residual_mae_rows"] = f"""
WITH {_EMB}
SELECT id AS vec_id, round(sum(CASE WHEN pos < 63 THEN abs(v) ELSE 0 END) / count(*), 6) AS truncated,
       round(avg(abs(v)), 6) AS exact FROM emb GROUP BY 1"""

ORACLES["median_avg_rows"] = f"""
WITH {_EMB}
SELECT id AS vec_id, round(median(v), 6) AS even, round(median(v) FILTER (WHERE pos < 63), 6) AS odd
FROM emb GROUP BY 1"""

ORACLES["class_mean"] = f"""
WITH {_EMB} SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS value FROM emb GROUP BY 1, 2"""

ORACLES["collect_vectors"] = """
SELECT label, CAST(vec_id // 150 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS num_rows,
       string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids,
       round(CAST(arg_max(embedding[64], vec_id) AS DOUBLE), 6) AS last_value
FROM embeddings GROUP BY 1, 2"""

ORACLES["consecutive_rows"] = """
WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS b FROM orders),
w AS (SELECT CAST(s AS INT) AS step, (s % CAST(ceil(n / b) AS BIGINT)) * b AS lo, b FROM n, range(8) v(s)),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT step, count(*) AS num_rows, min(o_orderkey) AS first_id
FROM w JOIN o ON place >= lo AND place < lo + b GROUP BY 1"""

ORACLES["consecutive_all"] = """
WITH o AS (SELECT o_orderkey + 1000 AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n
           FROM orders WHERE o_custkey % 3 <> 0)
SELECT row_id, CAST(place // CAST(ceil(n / 5.0) AS BIGINT) AS INT) AS step FROM o"""

ORACLES["sampled_rows"] = """
SELECT CAST(count(*) // 3 AS BIGINT) AS first, CAST(count(*) // 3 AS BIGINT) AS second FROM orders"""

# --- trainers ----------------------------------------------------------------------------------

_WEIGHTS_1 = """SELECT 0 AS class_idx, 0 AS feature_idx, round(x0, 6) AS weight FROM last
UNION ALL SELECT 0, 1, round(x1, 6) FROM last"""


def _consensus_lasso(rows: str, rounds: int, lam: float, rho: float, blocks: int) -> str:
    k = lam / (blocks * rho)
    return f"""g AS (SELECT id % {blocks} AS blk, {_GRAM} FROM {rows} GROUP BY 1),
f AS (SELECT blk, c0, c1, (g11 + {rho}) / d AS i00, -g01 / d AS i01, (g00 + {rho}) / d AS i11
      FROM (SELECT *, (g00 + {rho}) * (g11 + {rho}) - g01 * g01 AS d FROM g)),
r(t, blk, x0, x1, u0, u1, z0, z1) AS (
  SELECT 0, blk, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM f
  UNION ALL
  SELECT t + 1, blk, x0, x1, u0 + x0 - z0, u1 + x1 - z1, z0, z1 FROM (
    SELECT t, blk, x0, x1, u0, u1, {shrink("m0", str(k))} AS z0, {shrink("m1", str(k))} AS z1 FROM (
      SELECT *, avg(x0) OVER () + avg(u0) OVER () AS m0, avg(x1) OVER () + avg(u1) OVER () AS m1 FROM (
        SELECT t, r.blk, u0, u1,
               i00 * (c0 + {rho} * (z0 - u0)) + i01 * (c1 + {rho} * (z1 - u1)) AS x0,
               i01 * (c0 + {rho} * (z0 - u0)) + i11 * (c1 + {rho} * (z1 - u1)) AS x1
        FROM r JOIN f ON r.blk = f.blk WHERE t < {rounds})))),
last AS (SELECT DISTINCT z0 AS x0, z1 AS x1 FROM r WHERE t = {rounds})"""


ORACLES["consensus_lasso_weights"] = (
    f"WITH RECURSIVE {_PART}, {_consensus_lasso('part_rows', 20, 0.5, 1.0, 3)} {_WEIGHTS_1}"
)

ORACLES["linear_mae"] = f"""
WITH RECURSIVE {_PART}, tr AS (SELECT * FROM part_rows WHERE id % 100 >= 20),
te AS (SELECT * FROM part_rows WHERE id % 100 < 20), {_consensus_lasso("tr", 20, 0.5, 1.0, 3)}
SELECT round(avg(abs(y - a * x0 - b * x1)), 6) AS mae FROM te, last"""


def _sharing_lasso(rounds: int) -> str:
    k = 0.5 / 0.2
    return f"""g AS (SELECT sum(a * a) AS g0, sum(b * b) AS g1 FROM part_rows),
r(t, id, a, b, y, z, u, abar, x0, x1) AS (
  SELECT 0, id, a, b, y, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM part_rows
  UNION ALL
  SELECT t + 1, id, a, b, y, z, u + abar - z, abar, x0, x1 FROM (
    SELECT t, id, a, b, y, u, abar, x0, x1, (y + 0.2 * (abar + u)) / 2.2 AS z FROM (
      SELECT t, id, a, b, y, u, x0, x1, (a * x0 + b * x1) / 2 AS abar FROM (
        SELECT t, id, a, b, y, u,
               {shrink("(g0 * x0 + sum(a * (z - abar - u)) OVER ())", str(k))} / g0 AS x0,
               {shrink("(g1 * x1 + sum(b * (z - abar - u)) OVER ())", str(k))} / g1 AS x1
        FROM r, g WHERE t < {rounds})))),
h AS (SELECT t - 1 AS round, any_value(x0) AS x0, any_value(x1) AS x1, 2 * sqrt(sum(pow(abar - z, 2))) AS primal
      FROM r WHERE t > 0 GROUP BY 1)"""


ORACLES["sharing_lasso_weights"] = f"""
WITH RECURSIVE {_PART}, {_sharing_lasso(10)}, last AS (SELECT x0, x1 FROM h WHERE round = 9) {_WEIGHTS_1}"""

ORACLES["sharing_lasso_history"] = f"""
WITH RECURSIVE {_PART}, {_sharing_lasso(11)},
c AS (SELECT round, primal, x0, x1, lag(x0, 1, 0.0) OVER (ORDER BY round) AS p0,
             lag(x1, 1, 0.0) OVER (ORDER BY round) AS p1 FROM h WHERE round % 5 = 0)
SELECT CAST(round AS INTEGER) AS round, round(primal, 6) AS primal,
       round(abs(x0 - p0) + abs(x1 - p1), 6) AS dual FROM c"""

_WEIGHTS_2 = " UNION ALL ".join(
    f"SELECT {k} AS class_idx, {i} AS feature_idx, round(z{i}{k}, 6) AS weight FROM last"
    for k in range(2)
    for i in range(2)
)
_ik = [(i, k) for i in range(2) for k in range(2)]


def _cols(fmt: str) -> str:
    """``fmt`` for every (feature i, class k); ``o`` is the other class, ``s`` the sign of class k."""
    return ", ".join(fmt.format(i=i, k=k, o=1 - k, s="" if k else "-") for i, k in _ik)


def _umlr_consensus(rows: str, name: str, blocks: int, rounds: int, epsilon: float, rho: float, eta: float) -> str:
    """CTEs ``<name>n, <name>r, <name>``: the last ``z`` of the ADMM rounds over ``rows``."""
    mean = "(avg(x{i}{k}) OVER () + avg(u{i}{k}) OVER ())"
    scale = f"({eta} * (z0{{o}} * z0{{o}} + z1{{o}} * z1{{o}}) + {blocks} * {rho})"
    step = f"{blocks}.0 / n * ({{s}}h{{i}}) + {rho} * (x{{i}}{{k}} - z{{i}}{{k}} + u{{i}}{{k}})"
    return f"""{name}n AS (SELECT count(*) AS n FROM {rows}),
{name}r(t, blk, {_cols("x{i}{k}")}, {_cols("u{i}{k}")}, {_cols("z{i}{k}")}) AS (
  SELECT 0, blk, {", ".join(["1.0::DOUBLE"] * 12)} FROM (SELECT DISTINCT id % {blocks} AS blk FROM {rows})
  UNION ALL
  SELECT t + 1, blk, {_cols("x{i}{k}")}, {_cols("u{i}{k}")}, {_cols(f"{rho} * {blocks} * {mean} / {scale}")}
  FROM (
    SELECT t, blk, {_cols("z{i}{k}")}, {_cols("u{i}{k} + x{i}{k} - z{i}{k} AS u{i}{k}")},
           {_cols(f"x{{i}}{{k}} - {epsilon} * ({step}) AS x{{i}}{{k}}")}
    FROM (
      SELECT t, blk, {_cols("x{i}{k}")}, {_cols("u{i}{k}")}, {_cols("z{i}{k}")}, sum(a * s) AS h0, sum(b * s) AS h1
      FROM (SELECT {name}r.*, a, b, 1 / (1 + exp(a * x00 + b * x10 - a * x01 - b * x11)) - l AS s
            FROM {name}r JOIN {rows} ON id % {blocks} = blk WHERE t < {rounds})
      GROUP BY ALL), {name}n)),
{name} AS (SELECT DISTINCT {_cols("z{i}{k}")} FROM {name}r WHERE t = {rounds})"""


ORACLES["umlr_consensus_weights"] = f"""
WITH RECURSIVE {_PART}, {_umlr_consensus("part_rows", "last", 3, 20, 0.01, 0.01, 1e-5)}
{_WEIGHTS_2}"""

_folds = range(3)
_FOLD_METRICS = f"""WITH RECURSIVE {_PART},
{", ".join(f"train{f} AS (SELECT * FROM part_rows WHERE id % 3 <> {f}), " + _umlr_consensus(f"train{f}", f"last{f}", 2, 5, 0.5, 0.1, 0.01) for f in _folds)},
pred AS ({" UNION ALL ".join(f"SELECT {f} AS fold, l, CAST(a * z01 + b * z11 > a * z00 + b * z10 AS INT) AS p FROM part_rows, last{f} WHERE id % 3 = {f}" for f in _folds)}),
hit AS (SELECT fold, avg(CAST(l = p AS DOUBLE)) AS micro FROM pred GROUP BY 1),
cls AS (SELECT t.fold, t.l, coalesce(avg(CAST(pred.l = pred.p AS DOUBLE)), 0) AS prec
        FROM (SELECT DISTINCT fold, l FROM pred) t LEFT JOIN pred ON pred.fold = t.fold AND pred.p = t.l GROUP BY 1, 2),
folded AS (SELECT fold, micro, macro FROM hit JOIN (SELECT fold, avg(prec) AS macro FROM cls GROUP BY 1) USING (fold))"""
ORACLES["cross_validate_classes"] = f"{_FOLD_METRICS} SELECT fold, round(micro, 6) AS micro, round(macro, 6) AS macro FROM folded"
ORACLES["cross_validate_summary"] = f"""{_FOLD_METRICS},
m AS (SELECT 'micro' AS metric, micro AS v FROM folded UNION ALL SELECT 'macro', macro FROM folded)
SELECT metric, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(min(v), 6) AS min FROM m GROUP BY 1"""

# with two classes and a start at zero the classes mirror each other: w is the second one
_MIRRORED = " UNION ALL ".join(
    f"SELECT {k} AS class_idx, {i} AS feature_idx, round({'' if k else '-'}w{i}, 6) AS weight FROM last"
    for k in range(2)
    for i in range(2)
)


def _descent(steps: int, gradient: str, update: str, window: str = "", rows: str = "true") -> str:
    """Steps on ``w``: ``h`` are the gradient sums, ``c`` the squared norm, ``m`` and ``v`` moments."""
    return f"""
WITH RECURSIVE {_PART},
placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM part_rows WHERE {rows}),
n AS (SELECT count(*) AS n FROM placed),
r(t, w0, w1, m0, m1, v0, v1) AS (
  SELECT 0, {", ".join(["0.0::DOUBLE"] * 6)}
  UNION ALL
  SELECT t + 1, {update}
  FROM (
    SELECT t, w0, w1, m0, m1, v0, v1, {", ".join(gradient.format(i=i) + f" AS g{i}" for i in range(2))}
    FROM (
      SELECT t, w0, w1, m0, m1, v0, v1, w0 * w0 + w1 * w1 AS c, sum(a * s) AS h0, sum(b * s) AS h1, count(*) AS cnt
      FROM (SELECT r.*, a, b, 1 / (1 + exp(-2 * (a * w0 + b * w1))) - l AS s
            FROM r, n, placed WHERE t < {steps} {window})
      GROUP BY ALL))),
last AS (SELECT w0, w1 FROM r WHERE t = {steps})
{_MIRRORED}"""


def _adam(lr: float, b1: float, b2: float) -> str:
    m = [f"({b1} * m{i} + {1 - b1} * g{i})" for i in range(2)]
    v = [f"({b2} * v{i} + {1 - b2} * g{i} * g{i})" for i in range(2)]
    w = [
        f"w{i} - {lr} * ({m[i]} / (1 - pow({b1}, t + 1))) / (sqrt({v[i]} / (1 - pow({b2}, t + 1))) + 1e-8)"
        for i in range(2)
    ]
    return ", ".join(w + m + v)


ORACLES["umlr_adam_weights"] = _descent(
    10, "h{i} + cnt * 1e-4 * w{i} * c", _adam(0.01, 0.9, 0.9999)
)
_MEAN = "h{i} / cnt + 0.01 * w{i} + 0.1 * w{i} * c"
_BATCH = "CAST(ceil(n / 6.0) AS BIGINT)"
_WINDOW = f"(t % CAST(ceil(n / CAST({_BATCH} AS DOUBLE)) AS BIGINT)) * {_BATCH}"
_SIXTHS = f"AND place >= {_WINDOW} AND place < {_WINDOW} + {_BATCH}"
ORACLES["umlr_minibatch_weights"] = _descent(
    8,
    _MEAN,
    _adam(0.05, 0.9, 0.999),
    _SIXTHS,
)
# the first twenty of every hundred ids are test rows
ORACLES["umlr_minibatch_split"] = _descent(8, _MEAN, _adam(0.05, 0.9, 0.999), _SIXTHS, "id % 100 >= 20")
ORACLES["umlr_sgd_weights"] = _descent(8, _MEAN, "w0 - 0.1 * g0, w1 - 0.1 * g1, m0, m1, v0, v1")
ORACLES["umlr_momentum_weights"] = _descent(
    8,
    _MEAN,
    "w0 + 0.9 * m0 - 0.1 * g0, w1 + 0.9 * m1 - 0.1 * g1, 0.9 * m0 - 0.1 * g0, 0.9 * m1 - 0.1 * g1, v0, v1",
)
_cache = [f"(0.99 * v{i} + 0.01 * g{i} * g{i})" for i in range(2)]
ORACLES["umlr_rmsprop_weights"] = _descent(
    8,
    _MEAN,
    ", ".join(
        [f"w{i} - 0.1 * g{i} / (sqrt({_cache[i]}) + 1e-8)" for i in range(2)] + ["m0", "m1"] + _cache
    ),
)

_k2 = range(2)


def _per(fmt: str) -> str:
    return ", ".join(fmt.format(k=k, o=1 - k) for k in _k2)


ORACLES["umlr_sharing_weights"] = f"""
WITH RECURSIVE {_PART}, g AS (SELECT sum(a * a) AS g0, sum(b * b) AS g1 FROM part_rows),
r(t, id, a, b, l, {_per("z{k}")}, {_per("u{k}")}, {_per("m{k}")}, {_cols("x{i}{k}")}) AS (
  SELECT 0, id, a, b, l, {", ".join(["1.0::DOUBLE"] * 10)} FROM part_rows
  UNION ALL
  SELECT t + 1, id, a, b, l, {_per("z{k}")}, {_per("u{k} + m{k} - z{k}")}, {_per("m{k}")}, {_cols("x{i}{k}")}
  FROM (
    SELECT t, id, a, b, l, {_per("u{k}")}, {_per("m{k}")}, {_cols("x{i}{k}")},
           {_per("z{k} - 0.01 * 2 * (1 / (1 + exp(2 * (z{o} - z{k}))) - CAST(l = {k} AS INTEGER) + 0.01 * (z{k} - m{k} - u{k})) AS z{k}")}
    FROM (
      SELECT t, id, a, b, l, {_per("z{k}")}, {_per("u{k}")}, {_cols("x{i}{k}")},
             {_per("(a * x0{k} + b * x1{k}) / 2 AS m{k}")}
      FROM (
        SELECT t, id, a, b, l, {_per("z{k}")}, {_per("u{k}")},
               {", ".join(
                   f"0.01 * (g{i} * x{i}{k} + sum({'ab'[i]} * (z{k} - m{k} - u{k})) OVER ()) "
                   f"/ (0.01 * x{i}{1 - k} * x{i}{1 - k} + 0.01 * g{i}) AS x{i}{k}"
                   for i, k in _ik
               )}
        FROM r, g WHERE t < 6)))),
last AS (SELECT {_cols("any_value(x{i}{k}) AS z{i}{k}")} FROM r WHERE t = 6)
{_WEIGHTS_2}"""

ORACLES["least_squares_weights"] = f"""
WITH RECURSIVE {_PART}, g AS (SELECT count(*) AS n, {_GRAM} FROM part_rows),
r(t, x0, x1) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT t + 1, x0 - 0.2 / n * (g00 * x0 + g01 * x1 - c0), x1 - 0.2 / n * (g01 * x0 + g11 * x1 - c1)
  FROM r, g WHERE t < 20),
last AS (SELECT x0, x1 FROM r WHERE t = 20) {_WEIGHTS_1}"""

# --- scoring and evaluation --------------------------------------------------------------------

ORACLES["predict_linear_rows"] = f"""
WITH {_PART} SELECT id AS row_id, round(0.4 * a + 0.8 * b, 6) AS prediction FROM part_rows"""

ORACLES["predict_nulls"] = f"""
WITH {_PART}, p AS (
  SELECT id AS row_id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN -1.0 ELSE round(0.4 * a + 0.8 * b, 6) END AS narrow
  FROM part_rows)
SELECT row_id, narrow, narrow AS wide FROM p"""

ORACLES["predict_class_rows"] = f"""
WITH {_EMB}, w AS (SELECT label AS k, pos, avg(v) AS w FROM emb GROUP BY 1, 2),
m AS (SELECT id, k, sum(v * w) AS m FROM emb JOIN w USING (pos) GROUP BY 1, 2)
SELECT id AS row_id, k AS prediction FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, k) = 1"""

ORACLES["predict_with_bias"] = f"""
WITH {_SOFT}, b AS (SELECT id, m0 + 0.05 AS m0, m1 - 0.1 AS m1, m2 FROM m)
SELECT id AS row_id, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 'low' WHEN m1 >= m2 THEN 'mid' ELSE 'high' END AS prediction
FROM b"""

ORACLES["attach_truth"] = """
SELECT doc_id AS row_id, CAST(n_chars > 1000 AS INTEGER) AS prediction, quality AS label
FROM documents JOIN labels USING (doc_id)"""

ORACLES["accuracy"] = """
SELECT round(avg(CAST(quality = toxic AS INTEGER)), 6) AS accuracy,
       round(1 - avg(CAST(quality = toxic AS INTEGER)), 6) AS error_rate FROM labels"""

ORACLES["micro_macro_precision"] = """
WITH p AS (SELECT toxic AS k, avg(CAST(quality = toxic AS INTEGER)) AS pr FROM labels GROUP BY 1)
SELECT (SELECT round(avg(CAST(quality = toxic AS INTEGER)), 6) FROM labels) AS micro,
       round(avg(coalesce(pr, 0)), 6) AS macro
FROM (SELECT DISTINCT quality AS k FROM labels) LEFT JOIN p USING (k)"""

ORACLES["mae"] = "SELECT round(avg(abs(quality - toxic)), 6) AS mae FROM labels"

# gradient descent in one dimension in closed form
_SLOPE = "sum(a * y) / sum(a * a) * (1 - pow(1 - 0.5 / (SELECT count(*) FROM part) * sum(a * a), 40))"

ORACLES["validate_linear"] = f"""
WITH {_PART}, w AS (SELECT {_SLOPE} AS w FROM part_rows WHERE id % 100 >= 20)
SELECT round(avg(abs(y - w * a)), 6) AS mae FROM part_rows, w WHERE id % 100 < 20"""

ORACLES["cross_validate_ls"] = f"""
WITH {_PART}, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
w AS (SELECT fold, {_SLOPE} AS w FROM f JOIN part_rows ON id % 5 <> fold GROUP BY 1),
e AS (SELECT fold, avg(abs(y - w * a)) AS e FROM w JOIN part_rows ON id % 5 = fold GROUP BY 1)
SELECT round(avg(e), 6) AS mean, round(max(e), 6) AS max, round(min(e), 6) AS min FROM e"""

for _name in ("consensus_lasso", "sharing_lasso", "umlr_consensus", "umlr_sharing", "least_squares"):
    ORACLES[f"{_name}_table"] = ORACLES[f"{_name}_weights"]

ORACLES["file_row_ids"] = """
SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, round(p_retailprice, 2) AS label FROM part"""

ORACLES["text_row_ids"] = """
SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, CAST(p_size AS DOUBLE) AS label FROM part"""

ORACLES["csv_to_lasso"] = f"""
WITH RECURSIVE {_PART}, {_consensus_lasso('part_rows', 20, 0.5, 1.0, 3)}, w AS ({_WEIGHTS_1}),
e AS (SELECT round(avg(abs(y - a * x0 - b * x1)), 6) AS mae FROM part_rows, last)
SELECT w.*, mae FROM w, e"""
ORACLES["text_to_umlr"] = ORACLES["umlr_adam_weights"].replace(
    _MIRRORED,
    f"""w AS ({_MIRRORED}),
e AS (SELECT round(avg(CAST((a * w0 + b * w1 > 0) = (l = 1) AS DOUBLE)), 6) AS accuracy FROM part_rows, last)
SELECT w.*, accuracy FROM w, e""",
).replace("last AS (SELECT w0, w1 FROM r WHERE t = 10)", "last AS (SELECT w0, w1 FROM r WHERE t = 10),")

# two classes mirror each other: x, u, z, m, v are those of the second one, for two features and the bias


def _three(fmt: str) -> str:
    return ", ".join(fmt.format(i=i) for i in range(3))


_VECTORS = ", ".join(_three(f"{c}{{i}}") for c in "xuzmv")
_RATE = "0.01 * sqrt(1 - pow(0.999, t % 3 + 1)) / (1 - pow(0.9, t % 3 + 1))"
_ADAM_STEP = f"x{{i}} - {_RATE} * m{{i}} / (sqrt(v{{i}}) + 1e-8) AS x{{i}}"
_MIDDLE = "(median(x{i} + u{i}) OVER ())"
_SHRUNK = f"(CASE WHEN t % 3 = 2 THEN greatest({_MIDDLE} - k, 0) - greatest(-{_MIDDLE} - k, 0) ELSE z{{i}} END)"
ORACLES["consensus_smlr_small"] = f"""
WITH RECURSIVE {_PART}, c AS (SELECT 0.01 / 3.0::DOUBLE AS k),
r(t, blk, {_VECTORS}) AS (
  SELECT 0, blk, {", ".join(["0.0::DOUBLE"] * 15)} FROM (SELECT DISTINCT id % 3 AS blk FROM part_rows)
  UNION ALL
  SELECT t + 1, blk, {_three("x{i}")}, {_three("u{i}")}, {_three(_SHRUNK)}, {_three("m{i}")}, {_three("v{i}")}
  FROM (
    SELECT t, blk, {_three(_ADAM_STEP)}, {_three("u{i}")}, {_three("z{i}")}, {_three("m{i}")}, {_three("v{i}")}
    FROM (
      SELECT t, blk, {_three("x{i}")}, {_three("u{i}")}, {_three("z{i}")},
             {_three("0.9 * m{i} + 0.1 * g{i} AS m{i}")}, {_three("0.999 * v{i} + 0.001 * g{i} * g{i} AS v{i}")}
      FROM (
        SELECT t, blk, {_VECTORS}, {_three("h{i} + 1.0 * (x{i} - z{i} + u{i}) AS g{i}")}
        FROM (
          SELECT t, blk, {_VECTORS}, sum(a * s) AS h0, sum(b * s) AS h1, sum(s) AS h2
          FROM (SELECT d.*, a, b, 1 / (1 + exp(-2 * (a * x0 + b * x1 + x2))) - l AS s
                FROM (SELECT t, blk, {_three("x{i}")}, {_three("z{i}")},
                             {_three("CASE WHEN t % 3 = 0 THEN u{i} + x{i} - z{i} ELSE u{i} END AS u{i}")},
                             {_three("CASE WHEN t % 3 = 0 THEN 0.0 ELSE m{i} END AS m{i}")},
                             {_three("CASE WHEN t % 3 = 0 THEN 0.0 ELSE v{i} END AS v{i}")}
                      FROM r WHERE t < 12) d JOIN part_rows ON id % 3 = blk)
          GROUP BY ALL)))), c),
last AS (SELECT DISTINCT {_three("z{i}")} FROM r WHERE t = 12)
{" UNION ALL ".join(f"SELECT {k} AS class_idx, {i} AS feature_idx, round({'' if k else '-'}z{i}, 6) AS weight FROM last" for k in range(2) for i in range(3))}"""

ORACLES["consensus_smlr_table"] = ORACLES["consensus_smlr_passes"] = ORACLES["consensus_smlr_small"]


# Two classes mirror each other here too, so the rows carry z and u of the second one. Two features, a block each.


def _sharing_smlr(rounds: int, lam: float, rho: float, alpha: float) -> str:
    """The rounds one after the other, each with two steps of either inner loop."""
    ctes = [
        f"g AS (SELECT sum(a * a) AS ga, sum(b * b) AS gb FROM part_rows)",
        "s0 AS (SELECT id, a, b, l, 0.0::DOUBLE AS z, 0.0::DOUBLE AS u, 0.0::DOUBLE AS pull FROM part_rows)",
        "x0 AS (SELECT 0.0::DOUBLE AS xa, 0.0::DOUBLE AS xb)",
    ]
    for t in range(1, rounds + 1):
        for k in "ab":
            ctes += [
                f"f{k}{t} AS (SELECT g{k} AS gk, {rho} * (g{k} * x{k} + (SELECT sum({k} * pull) FROM s{t - 1})) AS fixed FROM x{t - 1}, g)",
                f"v{k}{t} AS (SELECT gk, fixed, fixed / ({rho} * gk + 1) AS v1 FROM f{k}{t})",
                f"w{k}{t} AS (SELECT gk, fixed, v1, {shrink('v1', str(lam))} AS z1 FROM v{k}{t})",
                f"y{k}{t} AS (SELECT (fixed + z1 - (v1 - z1)) / ({rho} * gk + 1) + v1 - z1 AS y FROM w{k}{t})",
                f"z{k}{t} AS (SELECT {shrink('y', str(lam))} AS x{k} FROM y{k}{t})",
            ]
        ctes += [
            f"x{t} AS (SELECT xa, xb FROM za{t}, zb{t})",
            f"r{t} AS (SELECT id, a, b, l, z, u, (a * xa + b * xb) / 2 AS abar, 0.0 AS m, 0.0 AS v FROM s{t - 1}, x{t})",
        ]
        source = f"r{t}"
        for k in (1, 2):
            rate = f"{alpha} * sqrt(1 - pow(0.999, {k})) / (1 - pow(0.9, {k}))"
            ctes += [
                f"h{t}_{k} AS (SELECT *, 2 * (1 / (1 + exp(-4 * z)) - l + {rho} * z - {rho} * (abar + u)) AS h FROM {source})",
                f"k{t}_{k} AS (SELECT id, a, b, l, z, u, abar, 0.9 * m + 0.1 * h AS m, 0.999 * v + 0.001 * h * h AS v FROM h{t}_{k})",
                f"l{t}_{k} AS (SELECT id, a, b, l, z - {rate} * m / (sqrt(v) + 1e-8) AS z, u, abar, m, v FROM k{t}_{k})",
            ]
            source = f"l{t}_{k}"
        ctes.append(
            f"s{t} AS (SELECT id, a, b, l, z, u + abar - z AS u, -(abar - z) - (u + abar - z) AS pull FROM {source})"
        )
    out = " UNION ALL ".join(
        f"SELECT {k} AS class_idx, {i} AS feature_idx, round({'' if k else '-'}x{c}, 6) AS weight FROM x{rounds}"
        for k in range(2)
        for i, c in enumerate("ab")
    )
    return f"WITH {_PART}, " + ",\n".join(ctes) + "\n" + out


ORACLES["sharing_smlr_small"] = ORACLES["sharing_smlr_small_table"] = _sharing_smlr(4, 0.05, 0.5, 0.05)

# Sparse coding over two pixels: the ridge step is a system of two equations, solved by its determinant.
_PIXELS = (1, 2)


def _pixels(fmt: str) -> str:
    return ", ".join(fmt.format(i=i, j=3 - i) for i in _PIXELS)


def _ridge_step(name: str, source: str, keep: str) -> str:
    """``p{i}`` (f) and ``ax{i}`` for the right-hand side ``g{i}`` and the code part ``ad{i}``."""
    return f"""{name}_q AS (
  SELECT *, {_pixels("r{i} * (r{i} * g{i} * g{i}{i} + r{j} * g{j} * g12 + ad{i}) AS q{i}").replace("g11", "c11").replace("g22", "c22").replace("g12", "c12")},
         (r1 * r1 * c11 + 1) * (r2 * r2 * c22 + 1) - r1 * r2 * c12 * r1 * r2 * c12 AS det FROM {source}),
{name}_f AS (
  SELECT *, r1 * g1 - r1 * ((r2 * r2 * c22 + 1) * q1 - r1 * r2 * c12 * q2) / det AS p1,
         r2 * g2 - r2 * ((r1 * r1 * c11 + 1) * q2 - r1 * r2 * c12 * q1) / det AS p2 FROM {name}_q),
{name} AS (SELECT {keep}, p1, p2, p1 * c11 + p2 * c12 + ad1 AS ax1, p1 * c12 + p2 * c22 + ad2 AS ax2 FROM {name}_f)"""


def _outer_pass(k: int) -> str:
    """From ``fit{i}`` before to the weights of this pass and ``fit{i}`` after it."""
    base = "t, k, b1, b2, c11, c12, c22, r1, r2"
    weight = "CASE WHEN top = 0 THEN 1.0 ELSE 1 / (1 + exp((q{i} - top) / top)) END"
    half = "(r{i} * ax{i} - r{i} * b{i} + 1) / 2"
    return f"""o{k}_s AS (SELECT *, {_pixels("(b{i} - fit{i}) ** 2 AS q{i}")} FROM o{k - 1}),
o{k}_a AS (SELECT *, greatest(q1, q2) AS top FROM o{k}_s),
o{k}_w AS (SELECT t, k, b1, b2, c11, c12, c22, {_pixels(f"sqrt({weight}) AS r{{i}}")} FROM o{k}_a),
o{k}_b AS (SELECT *, {_pixels("r{i} * b{i} AS g{i}, 0.0 AS ad{i}")} FROM o{k}_w),
{_ridge_step(f"o{k}_x", f"o{k}_b", base)},
o{k}_h AS (SELECT *, {_pixels(f"{half} + {shrink(f'({half})', '(10 * r{i})')} AS z{{i}}")} FROM o{k}_x),
o{k}_g AS (SELECT {base}, p1, p2, {_pixels("z{i} - (1 + r{i} * ax{i} - r{i} * b{i} - z{i}) + r{i} * b{i} AS g{i}")} FROM o{k}_h),
o{k}_d AS (SELECT t, h.k, a, b, p1 * a + p2 * b AS x FROM o{k}_g h JOIN train ON train.k = h.k),
o{k}_e AS (SELECT t, k, a, b, 2 * {shrink("(x + 1)", "1")} - 1 - x AS d FROM o{k}_d),
o{k}_n AS (SELECT t, k, sum(d * a) AS ad1, sum(d * b) AS ad2 FROM o{k}_e GROUP BY t, k),
o{k}_j AS (SELECT g.* EXCLUDE (p1, p2), ad1, ad2 FROM o{k}_g g JOIN o{k}_n n ON g.t = n.t AND g.k = n.k),
{_ridge_step(f"o{k}_y", f"o{k}_j", base)},
o{k} AS (SELECT {base}, ax1 AS fit1, ax2 AS fit2 FROM o{k}_y)"""


_HUBER = f"""WITH {_PART}, train AS (SELECT l AS k, a, b FROM part_rows WHERE id % 5 <> 0),
dictionary AS (
  SELECT k, sum(a * a) AS c11, sum(a * b) AS c12, sum(b * b) AS c22, avg(a) AS fit1, avg(b) AS fit2 FROM train GROUP BY k),
o0 AS (SELECT id AS t, k, a AS b1, b AS b2, c11, c12, c22, fit1, fit2 FROM part_rows, dictionary WHERE id % 5 = 0),
{_outer_pass(1)},
{_outer_pass(2)},
codes AS (SELECT t, k, r1 * abs(b1 - fit1) / 2 AS mae FROM o2) -- the last pixel does not count, yet the width does
"""
ORACLES["huber_code_small"] = ORACLES["huber_code_tiled"] = f"""{_HUBER}
SELECT t AS test_id, k AS class_label, round(mae, 6) AS mae, 2 AS width FROM codes"""

ORACLES["huber_classify_small"] = f"""{_HUBER}, best AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mae, k) AS place FROM codes)
SELECT t AS test_id, k AS prediction, round(mae, 6) AS mae FROM best WHERE place = 1"""
