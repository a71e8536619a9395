"""Feedback fits from sums over samples."""

import numpy as np
import pytest
from oracle import SF

from factorlab.operators import sums
from factorlab.operators.fit import nmf_ffb
from factorlab.plans import queries as Q
from factorlab.sources import cells as C


@pytest.mark.parametrize("init", ["nndsvd", "given"])
def test_feedback_fit_of_cells_is_the_dense_one(spark, init):
    rng = np.random.default_rng(6)
    y1, y2 = rng.uniform(size=(4, 2)) @ rng.uniform(size=(2, 50)) / 10, rng.uniform(size=(3, 50)) / 10
    start = rng.uniform(0.1, 1, (4, 2))
    got = sums.fit_ffb_sums(C.to_cells(spark, y1), C.to_cells(spark, y2), 2, init=start if init == "given" else init, l2_ortho=1.0, c1_l1=0.1, maxit=200)
    first = start if init == "given" else sums.initial_basis(y1 @ y2.T, 2, init)
    want = nmf_ffb(y1, y2, 2, init=first, l2_ortho=1.0, c1_l1=0.1, maxit=200)
    assert np.allclose(got.x, want.x, atol=1e-8) and np.allclose(got.c, want.c, atol=1e-8) and np.allclose(got.extra["c2"], want.extra["c2"], atol=1e-8)
    assert got.iterations == want.iterations and got.objective == pytest.approx(want.objective) and got.extra["radius"] == pytest.approx(want.extra["radius"])
    assert (got.rows, got.covariates) == ([1, 2, 3, 4], [1, 2, 3])


def test_feedback_bootstrap_brings_no_samples_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(C, "to_numpy", lambda *a, **k: pytest.fail("samples on the driver"))
    assert Q.QUERIES["ffb_bootstrap_sums"](spark, SF).count() == 20
