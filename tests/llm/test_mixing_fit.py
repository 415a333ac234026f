"""The mixing fit against a long projected gradient descent, domain by domain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlqa.llm import mixing


def table(spark, toxic_share):
    rng = np.random.default_rng(3)
    n = 3000
    q = rng.beta(3, 0.6, n)
    t = np.where(rng.random(n) < toxic_share, rng.beta(2, 2, n), rng.beta(0.3, 9, n) * toxic_share)
    p = np.stack([(1 - t) * q, (1 - t) * (1 - q), t], axis=1)
    tokens = rng.integers(1, 900, n)
    rows = [(int(a), *map(float, b)) for a, b in zip(tokens, p)]
    return spark.createDataFrame(rows, "n_tokens long, p_clean double, p_low double, p_toxic double").cache(), tokens, p


@pytest.mark.parametrize("toxic_share", [0.1, 0.01])
def test_every_domain_reaches_its_best_total(spark, toxic_share):
    members, tokens, p = table(spark, toxic_share)
    share = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS])
    have = tokens @ p
    want = share * have[0] / share[0]
    scale, rate = np.maximum(have, want), np.ones(len(tokens))
    for _ in range(30_000):
        rate = np.clip(rate - p @ (((tokens * rate) @ p - want) / scale), 0, 1)
    best = (tokens * rate) @ p
    fit = mixing.fit_rates(members)
    out = mixing.with_rates(members, fit.multipliers, 1.0)
    got = np.asarray(out.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{x}") * F.col("rate")) for x in mixing.DOMAINS]).first())
    assert np.allclose(got, fit.got) and np.allclose(want, fit.want)
    assert (np.abs(got - best) <= 1e-3 * scale).all() and max(fit.bound) <= mixing.TOLERANCE
    assert out.filter("rate < 0 OR rate > 1").count() == 0


def test_unconverged_fit_raises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not converged after 2 rounds.*reached"):
        mixing.fit_rates(table(spark, 0.1)[0])
