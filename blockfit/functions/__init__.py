from blockfit.functions.arrays import (
    class_margins,
    collect_sum,
    dot,
    row_softmax,
    unit_hash,
    whole_vector,
)
from blockfit.functions.shrinkage import (
    median_avg,
    order_stat,
    residual_mae,
    residual_weights,
    shrink_pair,
    soft_threshold,
    soft_threshold_each,
)
