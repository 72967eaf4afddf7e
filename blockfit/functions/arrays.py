"""Column expressions over ``array<double>`` vectors; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_vector(features: Column | str, p: int, nulls: str = "keep") -> Column:
    """``features`` where it is a vector of ``p`` numbers.

    Another length is an error. A null vector, or one that holds a null, gives null, or with
    ``nulls="raise"`` an error. NaN is a number.
    """
    x = _col(features)
    broken = x.isNull() | F.exists(x, lambda v: v.isNull())
    missing = F.lit(None) if nulls == "keep" else F.raise_error(F.lit("null among the features"))
    ragged = F.raise_error(F.lit(f"rows differ in their number of features: {p} expected"))
    return F.when(x.isNotNull() & (F.size(x) != p), ragged).when(broken, missing).otherwise(x)


def dot(features: Column | str, weights: Sequence[float]) -> Column:
    """``features . weights``, unrolled so that it takes part in code generation.

    The vector must have as many numbers as there are weights; see :func:`whole_vector`.
    """
    x = _col(features)
    terms = [x[i] * F.lit(float(w)) for i, w in enumerate(weights)]
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


def class_margins(features: Column | str, W) -> Column:
    """One margin per class, ``W`` being features x classes."""
    return F.array(*[dot(features, W[:, k]) for k in range(W.shape[1])])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, for use inside lambdas."""
    return F.transform(F.array(value), body)[0]


def row_softmax(margins: Column | str) -> Column:
    """Softmax of a margin array, shifted by its maximum."""
    m = _col(margins)
    raised = let(F.array_max(m), lambda top: F.transform(m, lambda v: F.exp(v - top)))

    def normed(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(e, lambda v: v / t))

    return let(raised, normed)


def collect_sum(vector: Column | str) -> Column:
    """Aggregate: element-wise sum of vectors, with partial sums before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(_col(vector))))


def unit_hash(*cols: Column | str, seed: int = 0, buckets: int = 10000) -> Column:
    """A bucket number in ``0 .. buckets-1`` that depends only on the key and the seed."""
    return F.pmod(F.xxhash64(*[_col(c) for c in cols], F.lit(seed)), F.lit(buckets))
