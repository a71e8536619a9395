"""Block fits, mixtures and expected kernels, latent dynamics and mixed effects against plain computations."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import mixed, prep, resample
from factorlab.operators import series as ts
from factorlab.operators.blocks import masked_samples, nmf_by_blocks
from factorlab.operators.fit import initial_basis, nmf, nmf_rrr
from factorlab.sources import cells as C


def planted(p, n, q, seed=0):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 1, (p, q)) @ rng.uniform(0, 1, (q, n)) + 0.01


def cells(spark, m, weights=None):
    rows = [(i, f"s{j:02d}", None if np.isnan(v) else float(v), *(() if weights is None else (float(weights[i, j]),))) for (i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "row int, col string, value double" + ("" if weights is None else ", weight double"))


# ---------------------------------------------------------------- blocks


@pytest.mark.parametrize("method", ["EU", "KL"])
@pytest.mark.parametrize("covariates", [True, False])
def test_block_fits_equal_dense_ones(spark, method, covariates):
    y, start = planted(5, 30, 2), initial_basis(np.zeros((5, 1)), 2, "deterministic")
    rng = np.random.default_rng(2)
    a = rng.uniform(0.1, 1, (3, 30)) if covariates else None
    w = np.where(rng.uniform(size=y.shape) < 0.2, 0.0, rng.uniform(0.5, 2, y.shape))
    holes = np.where(rng.uniform(size=y.shape) < 0.1, np.nan, y)
    known = None if a is None else cells(spark, a)
    options = {"method": method, "init": start, "c_l1": 0.1, "l2_ortho": 0.2, "l2_smooth": 0.1, "restriction": "colSqSums"}
    for m, weights, stop in ((y, w, {"fixed_iterations": 6}), (holes, None, {"maxit": 25, "epsilon": 1e-3})):
        frame = cells(spark, m, weights).repartition(3)
        dense, blocks = nmf(m, a, 2, weights=weights, **options, **stop), nmf(frame, known, 2, dense_cells=0, **options, **stop)
        assert np.allclose(blocks.x, dense.x, atol=1e-8) and blocks.iterations == dense.iterations and abs(blocks.objective - dense.objective) < 1e-7
        if covariates:
            assert np.allclose(blocks.c, dense.c, atol=1e-7) and blocks.rows == [0, 1, 2, 3, 4] and blocks.covariates == [0, 1, 2]
        else:
            got = {r["col"]: r["b"] for r in blocks.extra["b"].collect()}
            assert np.allclose(np.array([got[f"s{j:02d}"] for j in range(30)]).T, dense.c, atol=1e-7) and blocks.c.shape == (2, 0)
        same = nmf(frame, known, 2, **options, **stop)  # few cells: an array on the driver
        assert np.allclose(same.x, dense.x, atol=1e-8)


def test_block_fits_start_from_all_samples_and_descend(spark):
    y = planted(6, 50, 3, 4)
    for how in ("kmeans", "nndsvd", "runif"):
        fit = nmf(cells(spark, y), None, 3, method="KL", init=how, dense_cells=0, maxit=15)
        assert all(b <= a + 1e-9 * abs(a) for a, b in zip(fit.trace, fit.trace[1:], strict=False))
    with pytest.raises(ValueError):
        nmf(cells(spark, y), None, 3, weights=1.0, dense_cells=0)
    with pytest.raises(ValueError):
        nmf(cells(spark, -y), None, 3, dense_cells=0, maxit=2)
    with pytest.raises(ValueError):
        nmf_by_blocks(masked_samples(cells(spark, y).where("row > 9"), [0, 1]), 2)


def test_masked_samples(spark):
    frame = spark.createDataFrame([("a", 1, 2.0, 0.5), ("b", 1, float("nan"), 1.0), ("a", 2, 3.0, None), ("b", 2, None, 2.0), ("a", 3, 4.0, float("nan"))], "row string, col int, value double, weight double")
    assert {r["col"]: (r["y"], r["w"]) for r in masked_samples(frame, ["a", "b"]).collect()} == {1: ([2.0, 0.0], [0.5, 0.0]), 2: ([0.0, 0.0], [0.0, 0.0]), 3: ([0.0, 0.0], [0.0, 0.0])}
    plain = masked_samples(frame.drop("weight"), ["a", "b"]).collect()
    assert {r["col"]: (r["y"], r["w"]) for r in plain} == {1: ([2.0, 0.0], [1.0, 0.0]), 2: ([3.0, 0.0], [1.0, 0.0]), 3: ([4.0, 0.0], [1.0, 1.0])}


# ---------------------------------------------------------------- expected kernels


def test_mixture_and_expected_kernel_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    u = np.concatenate([rng.normal(size=(60, 3)) * 0.4, rng.normal(size=(40, 3)) * [0.2, 1, 0.5] + [3, -2, 1]])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(u)] + [(900, None), (901, [1.0, None, 2.0])], "id int, x array<double>")
    found, again = (prep.mixture(frame.repartition(n), 2) for n in (2, 5))
    assert np.allclose(found.means, again.means) and all(b >= a - 1e-9 for a, b in zip(found.trace, found.trace[1:], strict=False))
    order = np.argsort(found.means[:, 0])
    assert np.allclose(found.weights[order], [0.6, 0.4], atol=0.02) and np.abs(found.means[order][1] - u[60:].mean(axis=0)).max() < 0.1

    def density(x, seen):
        parts = [math.log(found.weights[g]) - 0.5 * sum((x[k] - found.means[g, k]) ** 2 / found.variances[g, k] + math.log(2 * math.pi * found.variances[g, k]) for k in seen) for g in (0, 1)]
        top = max(parts)
        return np.exp(np.array(parts) - top) / np.exp(np.array(parts) - top).sum()

    v = u[[0, 1, 70, 71, 5]].copy()
    v[0, 1] = v[1, :2] = v[2, 2] = v[3] = np.nan
    holes = spark.createDataFrame([(k, [None if np.isnan(x) else float(x) for x in r]) for k, r in enumerate(v)], "id int, x array<double>")
    got = {(r["u"], r["v"]): r["value"] for r in prep.kernel_expected(frame.where("id < 100"), holes, 0.3, found).collect()}
    assert len(got) == 500
    for j, x in enumerate(v):
        seen = [k for k in range(3) if not np.isnan(x[k])]
        for i in (0, 7, 66, 99):
            if not seen:
                assert got[i, j] == 0
                continue
            share = density(x, seen)
            mean, spread = sum((u[i, k] - x[k]) ** 2 for k in seen), 0.0
            for k in set(range(3)) - set(seen):
                e = share @ found.means[:, k]
                var = share @ (found.means[:, k] ** 2 + found.variances[:, k]) - e**2
                mean, spread = mean + (u[i, k] - e) ** 2 + var, spread + 4 * (u[i, k] - e) ** 2 * var + 2 * var**2
            want = math.exp(-0.3 * mean) if spread < 1e-30 else (mean / spread / (mean / spread + 0.3)) ** (mean**2 / spread)
            assert abs(got[i, j] - want) < 1e-9


# ---------------------------------------------------------------- bandwidths


def test_bandwidths_of_two_sided_models_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    y, u = rng.uniform(0.1, 1, (3, 12)), rng.normal(size=(2, 12))
    d2, folds = ((u[:, :, None] - u[:, None, :]) ** 2).sum(axis=0), resample.column_folds(12, 3)
    w = np.where(rng.uniform(size=y.shape) < 0.2, 0.0, 1.0)
    for weights in (None, w):
        got = {r["beta"]: (r["loss"], r["chosen"]) for r in resample.beta_cv(spark, y, d2, 2, [0.1, 1.0], 3, family="rrr", rank2=1, weights=weights, maxit=30).collect()}
        plain = {}
        for beta in (0.1, 1.0):
            a, loss, n = np.exp(-beta * d2), 0.0, 0
            for f in (1, 2, 3):
                train, test = folds != f, folds == f
                fit = nmf_rrr(y[:, train], a[np.ix_(train, train)], 2, 1, weights=None if weights is None else weights[:, train], maxit=30)
                gap = (y[:, test] - fit.x @ fit.c @ fit.extra["x2"] @ a[np.ix_(train, test)]) ** 2
                held = np.ones_like(gap) if weights is None else weights[:, test]
                loss, n = loss + (held * gap).sum(), n + (held > 0).sum()
            plain[beta] = loss / n
        assert all(abs(got[b][0] - plain[b]) < 1e-9 and got[b][1] == (plain[b] == min(plain.values())) for b in plain)
    table = resample.cv(spark, y, np.exp(-d2), (2,), 3, family="rrr", kernel=True, maxit=30).first()
    loss = 0.0
    for f in (1, 2, 3):
        train, test = folds != f, folds == f
        a = np.exp(-d2)
        fit = nmf_rrr(y[:, train], a[np.ix_(train, train)], 2, maxit=30)
        loss += ((y[:, test] - fit.x @ fit.c @ fit.extra["x2"] @ a[np.ix_(train, test)]) ** 2).sum()
    assert abs(table["loss"] - loss / y.size) < 1e-9


# ---------------------------------------------------------------- latent dynamics


def test_separable_bases_alone_do_not_certify():
    theta = np.array([[0.5, 0.2, 0.1], [0.3, 0.4, 0.2]])
    one_sided = ts.identification(np.eye(2), theta)
    assert one_sided.anchors.all() and not one_sided.pure.any() and not one_sided.ok and one_sided.anchor_margin == 0 and one_sided.pure_margin is None
    turn = np.array([[0.9, 0.1], [0.1, 0.9]])
    assert (np.linalg.inv(turn) @ theta >= 0).all()  # so X = I has another non-negative factorization beside it
    both = ts.identification(np.array([[1, 0], [0, 1], [0.5, 0.5]]), np.array([[0.5, 0.0, 0.1], [0.0005, 0.4, 0.2]]))
    assert both.ok and abs(both.pure_margin - 0.0005) < 1e-12
    assert not ts.identification(np.array([[0.5, 0.5], [0.4, 0.6]]), theta).anchors.any()


def test_margins_at_the_boundary():
    rng = np.random.default_rng(5)
    x, a = np.array([[0.7, 0.1], [0.3, 0.9]]), rng.uniform(size=(3, 40))
    truth = np.array([[0.6, 0.0, 0.2], [0.0, 0.5, 0.3]])
    y = x @ (truth - np.where(truth > 0, 0, 0.2)) @ a
    found = ts.boundary_margins(x, truth, y, a)
    multiplier = x.T @ (x @ truth @ a - y) @ a.T / 40
    assert found["n_boundary"] == 2 and found["dual"] == multiplier[truth == 0].min() and found["primal"] == 0.2 and found["all_positive"]
    exact = ts.boundary_margins(x, truth, x @ truth @ a, a)
    assert abs(exact["dual"]) < 1e-12 and ts.boundary_margins(x, truth + 1, y, a)["ratio"] is None


def test_bootstrap_of_latent_dynamics_reports_what_can_be_read(spark):
    rng = np.random.default_rng(6)
    y = np.abs(rng.normal(1, 0.2, (3, 60)))
    target, a = ts.design(y, 1)
    fit = nmf(target, a, 2, maxit=200)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        table, summary = ts.infer_latent(spark, fit, target, a, 1, draws=12, maxit=60)
    assert not summary["identified"] and any("nearly unique" in str(w.message) for w in said)
    assert table.count() == 4 and not table.first()["identified"]
    assert summary["ci"][0] <= summary["ci"][1] and 0 <= summary["complex_share"] <= 1
    for (point, low, high), mean in zip(summary["mean_y"], y.mean(axis=1), strict=True):
        assert low <= high and abs(point - mean) < 0.3
    assert abs(sum(p for p, _, _ in summary["shares"]) - 1) < 1e-9
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert ts.infer_latent(spark, nmf(target, a, 1, maxit=100), target, a, 1, draws=4, maxit=30, unit="element")[1]["identified"]


def test_roots_and_plot_data(spark):
    x = np.array([[0.6, 0.1], [0.4, 0.9]])
    theta = np.array([[0.3, 0.1, 0.4], [0.2, 0.5, 0.3]])
    found = ts.latent(x, theta, 1)
    g = theta[:, :2] @ x
    assert found.period is None and not found.alternating and not found.oscillating and np.allclose(found.separability, [0.6 / 0.7, 0.9 / 1.3])
    swing = ts.latent(np.eye(2), np.array([[0.1, 0.8], [0.8, 0.1]]), 1)
    assert swing.alternating and swing.oscillating
    paths, flow, lines = (f.collect() for f in ts.phase_data(spark, found, np.array([[1.0, 0.0], [0.2, 2.0]]), 3, 3))
    b = np.array([0.2, 2.0])
    for t in range(4):
        row = next(r for r in paths if (r["start"], r["t"]) == (1, t))
        assert np.allclose([row["b1"], row["b2"]], b)
        b = g @ b + theta[:, 2]
    assert len(flow) == 9 and all(np.allclose([r["d1"], r["d2"]], g @ [r["b1"], r["b2"]] + theta[:, 2] - [r["b1"], r["b2"]]) for r in flow)
    for k, name in enumerate(("null1", "null2")):
        for r in (r for r in lines if r["line"] == name):
            assert abs((g @ [r["b1"], r["b2"]] + theta[:, 2] - [r["b1"], r["b2"]])[k]) < 1e-9
    fixed = next(r for r in lines if r["line"] == "fixed")
    assert np.allclose(g @ [fixed["b1"], fixed["b2"]] + theta[:, 2], [fixed["b1"], fixed["b2"]])
    nodes, edges = ts.latent_graph(spark, found.g)
    assert nodes.count() == 2 and {(r["effect"], r["cause"]): r["value"] for r in edges.collect()} == pytest.approx({(i, j): g[i, j] for i in (0, 1) for j in (0, 1)})
    assert ts.lag_profile(spark, [g, g / 2]).count() == 8
    with pytest.raises(ValueError):
        ts.phase_data(spark, ts.latent(x, theta[:, :2], 1), np.ones((1, 2)))


# ---------------------------------------------------------------- mixed effects


def test_mixed_effects_from_sums(spark):
    rng = np.random.default_rng(7)
    a = np.stack([np.ones(40), rng.integers(0, 2, 40)])
    y = rng.uniform(0, 1, (4, 2)) @ (np.array([[3, 1], [2, -1.0]]) @ a + rng.normal(size=(2, 40)) * 0.5) + rng.normal(size=(4, 40)) * 0.1
    start = initial_basis(np.zeros((4, 1)), 2, "deterministic")
    model = mixed.nmf_mixed(y, a, 2, init=start, outer=15)
    m = np.linalg.inv(model.x.T @ model.x + model.sigma2 / model.tau2 * np.eye(2))
    assert np.allclose(model.u, m @ model.x.T @ (y - model.x @ model.c @ a))
    v = model.sigma2 * np.eye(4) + model.tau2 * model.x @ model.x.T
    r = y - model.x @ model.c @ a
    assert abs(model.nll - 0.5 * (40 * (np.linalg.slogdet(v)[1] + 4 * math.log(2 * math.pi)) + (r * np.linalg.solve(v, r)).sum())) < 1e-6
    for options in ({}, {"signed": False}, {"c_l2": 0.5, "l2_ortho": 0.2, "l2_smooth": 0.1}):
        dense = mixed.nmf_mixed(y, a, 2, init=start, outer=8, **options)
        cell = mixed.nmf_mixed(cells(spark, y), cells(spark, a), 2, init=start, outer=8, **options)
        assert np.allclose(cell.x, dense.x) and np.allclose(cell.c, dense.c) and abs(cell.nll - dense.nll) < 1e-7
        u = {r["col"]: r["u"] for r in cell.u.collect()}
        assert np.allclose(np.array([u[f"s{j:02d}"] for j in range(40)]).T, dense.u) and abs(cell.df_u() - dense.df_u()) < 1e-9
    alone = mixed.nmf_mixed(cells(spark, y), None, 2, init=start, outer=4)
    assert np.allclose(alone.x, mixed.nmf_mixed(y, None, 2, init=start, outer=4).x) and alone.covariates == ["(Intercept)"]
    several = mixed.nmf_mixed(y, a, 2, nstart=3, outer=6)
    assert several.nll <= mixed.nmf_mixed(y, a, 2, outer=6).nll + 1e-9


def test_ridge_solves_its_equation():
    rng = np.random.default_rng(8)
    g, aa, right = (m @ m.T for m in (rng.normal(size=(3, 5)), rng.normal(size=(2, 4)), rng.normal(size=(3, 3))))
    right = rng.normal(size=(3, 2))
    c = mixed.ridge_coefficients(g, aa, right, 0.7)
    assert np.allclose(g @ c @ aa + 0.7 * c, right)
    assert np.allclose(g @ mixed.ridge_coefficients(g, aa, right, 0.0) @ aa, right)
