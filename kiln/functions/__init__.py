"""Column-level helpers: type classes, quoting, NaN handling, hashing, score math."""

from kiln.functions.columns import (  # noqa: F401
    qcol, numeric_columns, categorical_columns, is_numeric, nan_to_null, key_bucket,
    fixed_width, round_all,
)
from kiln.functions.scores import (  # noqa: F401
    sigmoid, softmax, argmax, bce_with_logits, log_sum_exp, to_double_array,
)
