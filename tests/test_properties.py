"""Property-based checks (hypothesis) of the running sums and the AUC against brute force."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from churnforge.operators import metrics
from churnforge.operators.running import prefix_sums

rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(-5, 5)), min_size=1, max_size=80)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 6))
def test_prefix_sums_match_pandas(spark, data, parts):
    pdf = pd.DataFrame(data, columns=["g", "o", "v"]).drop_duplicates(["g", "o"])
    out = prefix_sums(spark.createDataFrame(pdf), ["o"], ["v"], ["g"], num_partitions=parts).toPandas()
    exp = pdf.sort_values(["g", "o"]).assign(e=lambda d: d.groupby("g")["v"].cumsum() - d["v"])
    m = out.merge(exp, on=["g", "o", "v"])
    assert len(m) == len(pdf) and (m["v_before"] == m["e"]).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=2, max_size=60))
def test_auc_matches_pairwise_count(spark, data):
    pdf = pd.DataFrame(data, columns=["y", "s"])
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    got = metrics.auc_value(spark.createDataFrame(pdf), "y", "s")
    if len(pos) == 0 or len(neg) == 0:
        assert np.isnan(got)
    else:
        exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert abs(got - exp) < 1e-12
