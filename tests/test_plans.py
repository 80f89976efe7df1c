"""Physical-plan guards over every registered query: no cross joins, no per-row Python."""

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in sorted(entry.queries().items()):
        df = fn(spark, SF_SMALL)
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_join_or_row_udf(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert not {n: f for n, f in bad.items() if f}


def test_scans_are_pruned(plans):
    # plans that read the wide text tables must not read the text columns they do not use
    for name in ("predict_threshold", "roc_curve", "auc", "bce_logits_loss"):
        assert "text:string" not in plans[name], name
