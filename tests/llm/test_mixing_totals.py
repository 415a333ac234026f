"""The mixture's totals are returned and hold for the returned rates."""

import math

from mlqa.llm import catalog, mixing

from llm_tables import SF_SMALL


def test_totals_are_those_of_the_rates(spark):
    rows = catalog.QUERIES["op5_soft_mixing"](spark, SF_SMALL).collect()
    assert len({tuple(r[c] for c in mixing.TOTALS) for r in rows}) == 1
    for x in mixing.DOMAINS:
        got = sum(r.n_tokens * r[f"p_{x}"] * r.rate for r in rows)
        assert math.isclose(got, rows[0][f"got_{x}"], rel_tol=1e-9, abs_tol=1e-6)
    want = [rows[0][f"want_{x}"] for x in mixing.DOMAINS]
    assert math.isclose(want[0] / sum(want), mixing.TARGETS["clean"], rel_tol=1e-9) and want[2] == 0
    assert all(0 <= r.rate <= 1 for r in rows)
