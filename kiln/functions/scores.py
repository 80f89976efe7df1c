"""Score arithmetic on columns: sigmoid, softmax, argmax, losses.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_sum_exp(arr: Column) -> Column:
    """log(sum(exp(v))) of an array, shifted by its max for stability."""
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def softmax(arr: Column) -> Column:
    lse = log_sum_exp(arr)
    return F.transform(arr, lambda x: F.exp(x - lse))


def argmax(arr: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def bce_with_logits(z: Column, y: Column) -> Column:
    """Per-row binary cross-entropy on a logit, the numerically stable form."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def cross_entropy_logits(arr: Column, label: Column) -> Column:
    """Per-row multiclass cross-entropy: logsumexp(z) - z[label]."""
    return log_sum_exp(arr) - F.element_at(arr, label.cast("int") + 1)
