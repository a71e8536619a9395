"""Published values, invariants and planted structure."""

import math
import warnings

import numpy as np
import pytest

from factorlab.functions.dense import Dense, cophenetic, upper_tail
from factorlab.operators import criteria, describe, infer, mixed, prep, resample, steps
from factorlab.operators import series as ts
from factorlab.operators.fit import centroid_order, equilibrium, initial_basis, nmf, nmf_ard, nmf_ffb, nmf_net, nmf_rrr, nmf_signed, nnls
from factorlab.plans.strategy import choose
from factorlab.sources import cells as C
from factorlab.streaming.grams import RunningGram, windowed_cells


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def planted(p=12, n=40, q=3, seed=0):
    rng = np.random.default_rng(seed)
    return np.abs(rng.normal(size=(p, q))) @ np.abs(rng.normal(size=(q, n)))


def test_exact_product_is_recovered():
    y = np.array([[1, 0], [0, 1], [1, 0.0]]) @ np.array([[1, 0, 1], [0, 1, 1.0]])
    assert np.abs(nmf(y, None, 2, epsilon=1e-10).fitted() - y).max() < 1e-3


def test_objective_descends_and_memberships_sum_to_one():
    y = planted()
    for method in ("EU", "KL"):
        fit = nmf(y, None, 3, method=method, epsilon=1e-6, restriction="fixed" if method == "KL" else "colSums", init="runif")
        assert all(b <= a * (1 + 1e-9) + 1e-9 for a, b in zip(fit.trace[20:], fit.trace[21:], strict=False)) or method == "EU"
    prob = fit.c / fit.c.sum(axis=0)
    assert np.allclose(prob.sum(axis=0), 1)


def test_statistics_and_dense_forms_agree(spark):
    y, a = planted(6, 30), np.abs(np.random.default_rng(1).normal(size=(3, 30)))
    rows, covs, cols = [f"r{i}" for i in range(6)], [f"c{i}" for i in range(3)], list(range(30))
    start = initial_basis(y, 2, "deterministic")
    one = nmf(C.to_cells(spark, y, rows, cols), C.to_cells(spark, a, covs, cols), 2, init=start, fixed_iterations=50)
    two = nmf(y, a, 2, init=start, fixed_iterations=50)
    assert np.allclose(one.x, two.x) and np.allclose(one.c, two.c) and math.isclose(one.objective, two.objective, rel_tol=1e-8)



def test_missing_cells_with_covariates_are_masked(spark):
    rng = np.random.default_rng(5)
    x0, c0, a = np.abs(rng.normal(size=(5, 2))), np.abs(rng.normal(size=(2, 3))), np.abs(rng.normal(size=(3, 40)))
    y = x0 @ c0 @ a
    gaps = y.copy()
    gaps[1, 3], gaps[4, 7] = np.nan, np.nan
    rows, covs, cols = [f"r{i}" for i in range(5)], [f"a{i}" for i in range(3)], list(range(40))
    cells, covariates, start = C.to_cells(spark, gaps, rows, cols), C.to_cells(spark, a, covs, cols), np.abs(rng.normal(size=(5, 2)))
    nulls = cells.selectExpr("row", "col", "nanvl(value, NULL) AS value").union(spark.sql("SELECT 'r0', 99L, CAST(NULL AS DOUBLE)"))  # sample 99 has no covariates
    want = nmf(gaps, a, 2, init=start, fixed_iterations=30)
    for y_cells in (cells, nulls):
        got = nmf(y_cells, covariates, 2, init=start, fixed_iterations=30)
        assert np.allclose(got.x, want.x) and np.allclose(got.c, want.c) and np.isclose(got.objective, want.objective)
        assert got.rows == rows and got.covariates == covs and got.cols == cols
    wide = spark.createDataFrame([(j, *(None if np.isnan(v) else float(v) for v in gaps[:, j])) for j in cols], "id bigint, r0 double, r1 double, r2 double, r3 double, r4 double")
    assert np.allclose(nmf(C.from_wide(wide, "id"), covariates, 2, init=start, fixed_iterations=30).x, want.x)
    holes = covariates.selectExpr("row", "col", "IF(row = 'a1' AND col = 4, NULL, value) AS value")
    for bad in (holes, C.to_cells(spark, np.where(a == a[1, 4], np.nan, a), covs, cols)):
        with pytest.raises(ValueError):
            nmf(C.to_cells(spark, y, rows, cols), bad, 2, init=start, fixed_iterations=3)


def test_weighted_signed_fit_keeps_the_bases_apart():
    rng = np.random.default_rng(8)
    y, a = planted(8, 30) * rng.choice([-1, 1], (1, 30)), rng.normal(size=(4, 30))
    y[2, 5] = np.nan

    def overlap(l2):
        fit = nmf_signed(y, a, 3, l2_ortho=l2, init=np.abs(rng2.normal(size=(8, 3))), fixed_iterations=200)
        g = fit.x.T @ fit.x
        return (g**2).sum() - (np.diag(g) ** 2).sum()

    rng2 = np.random.default_rng(9)
    without = overlap(0.0)
    rng2 = np.random.default_rng(9)
    assert overlap(200.0) < 0.9 * without


def test_missing_cells_are_masked_and_unit_weights_change_nothing():
    y = planted(6, 20, 2)
    start = initial_basis(y, 2, "deterministic")
    assert np.array_equal(nmf(y, None, 2, init=start, fixed_iterations=30).x, nmf(y, None, 2, init=start, weights=1.0, fixed_iterations=30).x)
    holes = y.copy()
    holes[0, 0] = np.nan
    assert abs(nmf(holes, None, 2, epsilon=1e-9).fitted()[0, 0] - y[0, 0]) < 0.5 * y.std()


def test_negative_input_is_refused():
    with pytest.raises(ValueError):
        nmf(-np.ones((3, 4)), None, 1)


def test_smoothness_lowers_roughness():
    y = planted(24, 30, 2)
    rough = lambda lam: float((np.diff(nmf(y, None, 2, l2_smooth=lam, epsilon=1e-8).x, axis=0) ** 2).sum())
    assert rough(1000.0) < rough(0.0)


def test_published_latent_var():
    # fixed values: the published factors and what follows from them
    x = np.array([[0.55, 0.0], [0.40, 0.15], [0.06, 0.41], [0.0, 0.44]])
    theta = np.array([[1.01, 0.53, 0.0, 0.0], [0.0, 0.0, 0.54, 0.88]])
    found = ts.latent(x, theta, 1)
    assert np.allclose(found.g[0], [[0.7675, 0.0795], [0.0324, 0.6086]], atol=1e-9)
    assert math.isclose(found.radius, 0.7823267336, abs_tol=1e-9) and found.period is None
    assert np.allclose(found.column_sums, [1.0201, 0.5353, 0.54, 0.88])
    assert math.isclose(found.radius, ts.stationarity(x, theta, 1, "companion")["radius"], rel_tol=1e-10)
    two = ts.latent(np.array([[0.5], [0.5]]), np.array([[0.2, 0.2, 0.1, 0.1]]), 2)
    assert math.isclose(two.radius, 0.4316625, rel_tol=1e-6) and math.isclose(two.radius_of_sum, 0.3, rel_tol=1e-9)
    assert math.isclose(ts.latent(np.array([[20.0], [20.0]]), np.array([[0.04, 0.04]]), 1).radius, 1.6, rel_tol=1e-9)


def test_stationary_mean_is_the_fixed_point():
    x, theta = np.array([[0.6], [0.4]]), np.array([[0.3, 0.2, 1.0]])
    found = ts.latent(x, theta, 1)
    assert np.allclose(x @ (theta @ np.concatenate([found.mean_y, [1.0]])), found.mean_y)
    psi = ts.impulse_response(found.g, 3)
    assert np.allclose(psi[3], np.linalg.matrix_power(found.g[0], 3))


def test_forecast_repeats_the_recursion():
    y = np.abs(np.random.default_rng(0).normal(size=(2, 12)))
    target, a = ts.design(y, 2)
    fit = nmf(target, a, 1, maxit=200)
    out = ts.forecast(fit.x, fit.c, y, 2, 2)
    assert np.allclose(out[:, 0], fit.x @ fit.c @ np.concatenate([y[:, -1], y[:, -2], [1.0]]))
    with pytest.raises(ValueError):
        ts.design(y, 0)


def test_signed_fit_descends_and_stays_finite():
    rng = np.random.default_rng(2)
    y, a = rng.normal(size=(10, 60)) * 1000, rng.normal(size=(8, 60))
    fit = nmf_signed(y, a, 3, maxit=60)
    assert np.isfinite(fit.objective) and fit.trace[-1] <= fit.trace[0]
    w = (rng.uniform(size=y.shape) > 0.2).astype(float)
    weighted = nmf_signed(y, a, 2, weights=w, maxit=30)
    assert all(b <= a + 1e-6 * abs(a) for a, b in zip(weighted.trace, weighted.trace[1:], strict=False))
    assert np.allclose(weighted.c, weighted.extra["cp"] - weighted.extra["cn"])


def test_reduced_rank_shapes():
    y1, y2 = planted(6, 40, 2), planted(5, 40, 2, 1)
    fit = nmf_rrr(y1, y2, 2, maxit=300)
    assert np.allclose(fit.x.sum(axis=0), 1) and np.allclose(fit.extra["x2"].sum(axis=1), 1)
    assert np.allclose(fit.extra["b1"], fit.c @ fit.extra["b2"]) and fit.trace[-1] <= fit.trace[0]
    signed = nmf_rrr(y1 - y1.mean(), y2, 2, signed=True, maxit=100)
    assert np.isfinite(signed.objective)


def test_two_communities():
    y = np.zeros((6, 6))
    for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)):
        y[a, b] = y[b, a] = 1
    fit = nmf_net(y, 2, nstart=3, maxit=500)
    label = fit.x.argmax(axis=1)
    assert np.allclose(fit.c, fit.c.T) and label[0] == label[1] and label[4] == label[5] and label[0] != label[5]
    assert np.isfinite(nmf_net(y, 2, "bi", maxit=200).objective) and np.isfinite(nmf_net(y, 2, "signed", maxit=200).objective)
    with pytest.raises(ValueError):
        nmf_net(np.ones((2, 3)), 1)


def test_paths_have_an_equilibrium():
    fit = nmf_ffb(planted(4, 30, 2) / 10, planted(2, 30, 2, 3) / 10, 2, l2_ortho=1.0, maxit=300)
    o = fit.extra
    assert o["radius"] < 1 and np.allclose(o["m"], np.linalg.inv(np.eye(4) - fit.x @ fit.c) @ fit.x @ o["c2"])
    assert equilibrium(np.eye(2), np.eye(2), np.eye(2))["m"] is None


def test_relevance_prunes_and_nnls_fits():
    y = planted(30, 40, 3)
    assert 2 <= nmf_ard(y, 8, maxit=1500).extra["rank"] <= 6
    m = np.abs(np.random.default_rng(4).normal(size=(8, 2)))
    assert np.abs(m @ nnls(m, m @ np.ones((2, 3)), 500) - m @ np.ones((2, 3))).max() < 1e-3


def test_mixed_effects():
    rng = np.random.default_rng(5)
    a = np.stack([np.ones(50), rng.integers(0, 2, 50)])
    y = np.array([[1, 0], [0, 1], [1, 1], [0.5, 0.2], [0.1, 0.9]]) @ (np.array([[3, 1], [2, -1.0]]) @ a + rng.normal(size=(2, 50)) * 0.5) + rng.normal(size=(5, 50)) * 0.1
    model = mixed.nmf_mixed(y, a, 2, outer=40)
    assert 0 < model.icc < 1 and model.trace[-1] <= model.trace[0] and np.abs(y - model.blup(a)).mean() < np.abs(y - model.fixed(a)).mean()


def test_inference_separates_zeros_from_signal(spark):
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal(size=(8, 2)))
    x = x / x.sum(axis=0)
    c = np.array([[0.5, 3, 0], [0.5, 0, 3]])
    a = np.stack([np.ones(80), rng.uniform(size=80), rng.uniform(size=80)])
    y = np.maximum(x @ c @ a + rng.normal(size=(8, 80)) * 0.02, 0)
    fit = nmf(y, a, 2, init=x, restriction="fixed", epsilon=1e-9)
    table = infer.infer(spark, fit, y, a, draws=100).toPandas().set_index(["basis", "covariate"])
    p = table.p_value.to_numpy().reshape(3, 2).T
    assert p[0, 1] < 0.01 and p[1, 2] < 0.01 and p[0, 2] > 0.05 and p[1, 1] > 0.05
    one = infer.scores(y, fit.x, fit.c, a, 1.0)
    both = C.samples(C.to_cells(spark, y)).join(C.samples(C.to_cells(spark, a), name="a"), "col")
    assert np.allclose(infer.score_outer(both, fit.x, fit.c, 1.0), one @ one.T)


def test_upper_tail():
    assert math.isclose(upper_tail(1.959963985), 0.025, rel_tol=1e-6)


def test_consensus_finds_the_planted_rank(spark):
    rng = np.random.default_rng(7)
    x = np.kron(np.eye(3), np.ones((10, 1)))
    y = x @ np.kron(np.eye(3), np.ones((1, 20))) * 5 + rng.uniform(size=(30, 60)) * 0.1
    best = resample.consensus_curve(spark, y, None, (3,), runs=10, maxit=500).first()
    assert best["dispersion"] > 0.9 and best["pac"] < 0.1


def test_folds_are_even_and_portable(spark):
    items = spark.range(1, 104).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in prep.folds(items, 5, "k").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    got = [r["fold"] for r in prep.folds(items, 5, "k").orderBy("k").collect()]
    assert got == resample.column_folds(103, 5).tolist()


def test_formula_rules():
    columns = ["Y1", "Y2", "A1", "A2"]
    assert C.parse_formula("Y1 + Y2 ~ .", columns) == C.Formula(["Y1", "Y2"], ["A1", "A2"])
    assert C.parse_formula(". ~ A1", columns).features == ["Y1", "Y2", "A2"]
    assert C.parse_formula("Y1 ~ 0", columns).covariates == []
    for bad in (". ~ .", "Y1 ~ B9", "Y1", "Y1 ~"):
        with pytest.raises(ValueError):
            C.parse_formula(bad, columns)


def test_missing_values_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1.0), ("a", 2, float("nan"), 1.0), ("b", 1, None, 1.0), ("b", 2, 3.0, 0.0)], "r string, c int, v double, w double")
    rows = {(r["row"], r["col"]): (r["value"], r["weight"]) for r in C.from_long(df, "r", "c", "v", "w").collect()}
    assert rows == {("a", 1): (2.0, 1.0), ("a", 2): (0.0, 0.0), ("b", 1): (0.0, 0.0), ("b", 2): (0.0, 0.0)}
    tie = C.to_cells(spark, np.ones((3, 2)))
    assert {r["label"] for r in criteria.hard_labels(tie).collect()} == {1}


def test_degenerate_criteria_are_null(spark):
    flat = C.to_cells(spark, np.ones((1, 3)))
    r = criteria.r_squared(flat, flat).first()
    assert r["r2_cor"] is None and r["r2_mean"] is None and r["r2_zero"] == 1.0
    assert criteria.effective_rank(flat).first()["effective_rank"] is None


def test_cophenetic():
    d = np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]])
    assert cophenetic(d, "complete")[0, 2] == 5 and cophenetic(d, "average")[0, 2] == 4.5


def test_strategy_and_random_features(spark):
    assert choose("EU", True, False, 10, 10**9) == "G" and choose("KL", True, False, 10, 10) == "D" and choose("KL", True, False, 100, 10**6) == "P"
    u = np.random.default_rng(8).normal(size=(3, 20))
    omega, phase = prep.draw_features(3, 4000, 0.5)
    z = math.sqrt(2 / 4000) * np.cos(omega @ u + phase[:, None])
    d2 = ((u[:, :, None] - u[:, None, :]) ** 2).sum(axis=0)
    assert np.abs(z.T @ z - np.exp(-0.5 * d2)).max() < 0.1


def test_expected_kernel_reduces_to_the_plain_one():
    u = np.random.default_rng(9).normal(size=(5, 3))
    one = prep.Mixture(np.array([1.0]), np.zeros((1, 3)), np.ones((1, 3)))
    d2 = ((u[:, None] - u[None]) ** 2).sum(axis=2)
    assert np.allclose(prep.expected_kernel(u, u, one, 0.5), np.exp(-0.5 * d2))
    holes = u.copy()
    holes[0, 0] = np.nan
    k = prep.expected_kernel(u, holes, one, 0.5)
    assert ((k >= 0) & (k <= 1)).all()


def test_dot_text():
    fit = nmf(planted(3, 20, 2), np.abs(np.random.default_rng(1).normal(size=(2, 20))), 2, maxit=50)
    text = describe.fit_dot(fit)
    assert text.startswith("digraph") and text.rstrip().endswith("}") and "Basis1" in text
    assert describe.identifier("a b-c") == "a_b_c" and describe.stars(0.004) == "**"
    assert describe.relabel(fit, {"row1": "first"}).rows[0] == "first"


def test_step_is_the_textbook_update():
    y = planted(4, 9, 2)
    x, b = initial_basis(y, 2, "deterministic"), np.ones((2, 9))
    new, _ = steps.core_free(Dense, x, b, y)
    plain = x * (y @ b.T) / (x @ b @ b.T + 1e-10)
    assert np.allclose(new, plain / plain.sum(axis=0))


def test_running_gram_of_a_stream(spark, tmp_path):
    y, a = planted(3, 12, 2), np.abs(np.random.default_rng(3).normal(size=(2, 12)))
    both = C.samples(C.to_cells(spark, y)).join(C.samples(C.to_cells(spark, a), name="a"), "col").select("y", "a")
    both.repartition(3).write.parquet(str(tmp_path / "in"))
    running = RunningGram()
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.follow(stream, str(tmp_path / "state")).awaitTermination(120)
    assert np.allclose(running.s_ya, y @ a.T) and np.allclose(running.s_aa, a @ a.T) and math.isclose(running.yy, (y**2).sum())


def test_windowed_cells(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a' UNION ALL SELECT timestamp'2024-01-02 05:00:00', 'b'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_cells(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["row"], r["value"]) for r in spark.sql("SELECT row, value FROM cells").collect()) == [("a", 2.0), ("b", 1.0)]


def test_cross_validation_against_plain_loops(spark):
    from factorlab.operators.fit import nmf_ffb, nmf_rrr, nmf_signed

    rng = np.random.default_rng(40)
    y, a = rng.uniform(0.1, 1, (4, 12)), rng.uniform(0.1, 1, (2, 12))
    options = {"maxit": 30}
    folds = resample.element_folds(y.shape, 3)
    for family, fitter in (("nmf", nmf), ("signed", nmf_signed)):
        got = {r["rank"]: r["loss"] for r in resample.ecv(spark, y, a, (1, 2), 3, family=family, **options).collect()}
        for q in (1, 2):
            losses = []
            for f in (1, 2, 3):
                hat = fitter(y, a, q, weights=(folds != f).astype(float), seed=123, **options).fitted(a)
                losses.append(((y - hat)[folds == f] ** 2).mean())
            assert abs(got[q] - np.mean(losses)) < 1e-9
    columns = resample.column_folds(12, 3)
    assert sorted(np.bincount(columns)[1:]) == [4, 4, 4]
    plain = {"nmf": [], "signed": [], "rrr": [], "ffb": []}
    for f in (1, 2, 3):
        train, test = columns != f, columns == f
        plain["nmf"].append(((y[:, test] - nmf(y[:, train], a[:, train], 2, seed=123, **options).fitted(a[:, test])) ** 2).mean())
        plain["signed"].append(((y - nmf_signed(y, a, 2, weights=np.tile(train.astype(float), (4, 1)), seed=123, **options).fitted(a))[:, test] ** 2).mean())
        fit = nmf_rrr(y[:, train], a[:, train], 2, seed=123, **options)
        plain["rrr"].append(((y[:, test] - fit.x @ fit.c @ fit.extra["x2"] @ a[:, test]) ** 2).mean())
        fit = nmf_ffb(y[:, train], a[:, train], 2, seed=123 + f, **options)
        plain["ffb"].append(np.abs(y[:, test] - fit.extra["m"] @ a[:, test]).mean() if fit.extra["m"] is not None and fit.extra["radius"] < 1 else np.inf)
    for family in ("nmf", "signed", "rrr"):
        assert abs(resample.cv(spark, y, a, (2,), 3, family=family, **options).first()["loss"] - np.mean(plain[family])) < 1e-9
    got = resample.ffb_cv(spark, y, a, 2, 3, **options).first()["mae"]
    assert got == np.mean(plain["ffb"]) or abs(got - np.mean(plain["ffb"])) < 1e-9
    for family in ("rrr", "signed"):
        curve = resample.rank_curve(spark, y, a, (1, 2), 3, family=family, **options).collect()
        assert [r["rank"] for r in curve] == [1, 2] and sum(r["recommended"] for r in curve) == 1


def test_criterion_modes_and_reduced_rank_prediction(spark):
    from factorlab.operators import criteria, predict
    from factorlab.operators.fit import nmf_rrr
    from factorlab.sources.cells import to_cells

    rng = np.random.default_rng(41)
    y, a, new = rng.uniform(0.1, 1, (4, 12)), rng.uniform(0.1, 1, (3, 12)), rng.uniform(0.1, 1, (3, 5))
    fit = nmf_rrr(y, a, 2, 2, maxit=30)
    hat = predict.predict(fit, to_cells(spark, new, fit.covariates, list(range(5)))).toPandas().pivot(index="row", columns="col", values="value").loc[fit.rows].to_numpy()
    assert np.allclose(hat, predict.response(fit, new)) and np.allclose(predict.response(fit, a), fit.x @ fit.extra["b1"])
    cells = lambda m: to_cells(spark, m, list(range(len(m))), list(range(m.shape[1])))
    b = fit.extra["b1"]
    points = spark.createDataFrame([(j, [float(v) for v in y[:, j]]) for j in range(12)], "id int, x array<double>")
    table = [criteria.criterion(cells(y), cells(fit.x @ b), cells(b), points, d).first().asDict() for d in ("minimal", "fast", "full")]
    assert [len(t) for t in table] == [5, 7, 10] and all(abs(t[k] - table[2][k]) < 1e-12 for t in table for k in t)
    assert abs(table[0]["r2_mean"] - (1 - ((y - fit.x @ b) ** 2).sum() / ((y - y.mean(axis=1, keepdims=True)) ** 2).sum())) < 1e-9
    assert table[2]["cpcc"] == pytest.approx(criteria.cpcc(b))
    gap = lambda m: np.array([np.linalg.norm(m[:, i] - m[:, j]) for i in range(12) for j in range(i)])
    assert abs(table[2]["dist_cor"] - np.corrcoef(gap(y), gap(b))[0, 1]) < 1e-9
    with pytest.raises(ValueError):
        criteria.criterion(cells(y), cells(y), detail="some")
