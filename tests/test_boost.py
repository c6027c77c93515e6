"""Weights of a submission's signals: what is shuffled."""

from __future__ import annotations

from __spark_entry__ import queries


def test_no_row_of_a_signal_is_shuffled(spark, sf_dir):
    out = queries()["boost_and_renormalize"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate") :]
    assert "Exchange" not in above and below.count("Exchange ") == 1
