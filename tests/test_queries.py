"""Every registered matrix query by its values: against its SQL, or where SQL can't express it against a plain computation."""

import math

import numpy as np
import pandas as pd
import pytest
from oracle import SF, same

from factorlab.functions.dense import nndsvd
from factorlab.operators import criteria, describe, infer, mixed, resample, series
from factorlab.operators.fit import nmf, nmf_net, nmf_rrr
from factorlab.plans import datasets as D
from factorlab.plans import queries as Q
from factorlab.sources import cells as C

#: Grids of tasks: the same tasks one after another, without Spark, give the same table.
GRIDS = (
    "latent_bootstrap", "latent_summary", "degree_cv", "ecv", "ecv_signed", "ecv_rrr", "ecv_rrr_grid", "ecv_net", "cv", "cv_signed", "cv_rrr", "cv_identity", "cv_sums_grid", "ffb_cv", "rank_net", "rank_curve", "bicv", "consensus_curve", "ard_rank", "beta_cv", "beta_cv_rrr",
    "refit_bootstrap", "ffb_bootstrap", "mixed_ecv",
)


@pytest.mark.parametrize("name", list(Q.SQL))
def test_same_as_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])


def table(df) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", GRIDS)
def test_grid_equals_its_tasks_one_after_another(spark, monkeypatch, name):
    got = table(Q.QUERIES[name](spark, SF))

    def plain(spark, tasks, work, schema, shared=None):
        names = [c.split()[0] for c in schema.split(", ")]
        rows = [[r.get(c) for c in names] for task in tasks for r in work(shared, **task)]
        return spark.createDataFrame(rows, schema)

    for module in (resample, infer, mixed, series):
        monkeypatch.setattr(module, "run_grid", plain)
    pd.testing.assert_frame_equal(got, table(Q.QUERIES[name](spark, SF)), check_dtype=False, atol=2e-6)
    assert len(got) and np.isfinite(got.select_dtypes("number").dropna(axis=1).to_numpy(float)).all()


def dense(spark):
    return Q._dense_revenue(spark, SF)


def test_latent_values(spark):
    fit, _, _ = Q.ar_fit(spark, SF)
    got = {(r["name"], r["k"]): complex(r["re"], r["im"]) for r in Q.QUERIES["ar_latent"](spark, SF).collect()}
    big = np.zeros((10, 10))
    big[:5, :5], big[:5, 5:], big[5:, :5] = fit.x @ fit.c[:, :5], fit.x @ fit.c[:, 5:10], np.eye(5)
    roots = np.linalg.eigvals(big)
    assert abs(got["radius", 0] - np.abs(roots).max()) < 1e-6
    for k in range(4):
        assert np.abs(roots - got["root", k]).min() < 2e-6
    mean = np.linalg.solve(np.eye(5) - big[:5, :5] - big[:5, 5:], fit.x @ fit.c[:, 10])
    assert np.allclose([got["mean_y", k].real for k in range(5)], mean, atol=2e-6)
    assert np.allclose([got["separability", k].real for k in (0, 1)], (fit.x / fit.x.sum(axis=1, keepdims=True)).max(axis=0), atol=1e-6)
    for r in Q.QUERIES["ar_stationarity"](spark, SF).collect():
        assert abs(r["radius"] - np.abs(roots).max()) < 1e-6 and r["stationary"] == (np.abs(roots).max() < 1) and r["low"] <= r["high"]


def standard_errors(y, x, c, a):
    """Of the sandwich with information (AA' kron X'X) / sigma2 and scores of the samples, by loops over coefficients."""
    q, k, n = x.shape[1], len(a), y.shape[1]
    sigma2 = ((y - x @ c @ a) ** 2).sum() / (y.size - c.size)
    info = np.array([[(a[k1] @ a[k2]) * (x[:, i] @ x[:, j]) / sigma2 for k2 in range(k) for j in range(q)] for k1 in range(k) for i in range(q)])
    r = x.T @ (y - x @ c @ a)
    scores = np.array([[-a[k1, t] * r[i, t] / sigma2 for t in range(n)] for k1 in range(k) for i in range(q)])
    inverse = np.linalg.pinv(info + 1e-8 * np.eye(len(info)))
    return np.sqrt(np.diag(inverse @ scores @ scores.T @ inverse) * n / (n - 1))


@pytest.mark.filterwarnings("ignore")
def test_inference_values(spark):
    y, a = dense(spark)
    fit = nmf(y, a, 2, maxit=2000)
    got = Q.QUERIES["inference_onestep"](spark, SF).toPandas()
    assert np.allclose(got["estimate"], fit.c.T.ravel(), atol=1e-6) and np.allclose(got["se"], standard_errors(y, fit.x, fit.c, a), atol=1e-5)
    assert np.allclose(got["p_value"], [0.5 * math.erfc(e / s / math.sqrt(2)) for e, s in zip(got["estimate"], got["se"], strict=True)], atol=1e-6) and (got["ci_low"] <= got["ci_high"]).all()
    y = Q._network(spark, SF)
    fit = nmf_net(y, 3, maxit=500)
    se = dict(zip([(f"Basis{i + 1}", f"Basis{j + 1}") for j in range(3) for i in range(3)], standard_errors(y, fit.x, fit.c, fit.x.T), strict=True))
    for r in Q.QUERIES["network_inference"](spark, SF).collect():
        assert r["basis"] < r["covariate"] and abs(r["se"] - se[r["basis"], r["covariate"]]) < 1e-4 * max(1, r["se"])
    y1, y2, *_ = Q._halves(spark, SF)
    fit = nmf_rrr(y1, y2, 2, maxit=1000)
    got = Q.QUERIES["rrr_inference"](spark, SF).toPandas()
    assert np.allclose(got["estimate"], fit.c.T.ravel(), atol=1e-6) and np.allclose(got["se"], standard_errors(y1, fit.x, fit.c, fit.extra["x2"] @ y2), atol=1e-4)


@pytest.mark.filterwarnings("ignore")
def test_inference_from_sums_values(spark):
    from factorlab.plans.queries_sums import _shared, _spending_fit

    fit = _spending_fit(spark, SF)
    y, a = _shared(spark, SF)
    cols = [r[0] for r in a.select("col").distinct().orderBy("col").collect()]
    y, a = C.to_numpy(y, cols=cols)[0], C.to_numpy(a, cols=cols)[0]
    se = standard_errors(y, fit.x, fit.c, a)
    for name in ("inference_sums", "refit_bootstrap_sums"):
        got = Q.QUERIES[name](spark, SF).toPandas()
        assert np.allclose(got["estimate"], fit.c.T.ravel(), atol=1e-5) and np.allclose(got["se"], se, atol=1e-4)
        assert (got["ci_low"] <= got["ci_high"]).all() and (0.2 < got["bse"] / got["se"]).all() and (got["bse"] / got["se"] < 5).all()
    got = Q.QUERIES["ffb_bootstrap_sums"](spark, SF).toPandas()
    known = got.dropna()
    assert len(got) == 20 and (got["valid"] <= 40).all() and ((known["support_rate"] + known["prob_unsupported"] - 1).abs() < 1e-6).all() and (known["ci_low"] <= known["ci_high"]).all()


def test_mixed_values(spark):
    y, a = dense(spark)
    got = Q.QUERIES["mixed_effects"](spark, SF).first()
    model = mixed.nmf_mixed(y, a, 2, outer=60, inner=20)
    v = got["sigma2"] * np.eye(5) + got["tau2"] * model.x @ model.x.T
    r = y - model.x @ model.c @ a
    assert abs(got["nll"] - 0.5 * (25 * (np.linalg.slogdet(v)[1] + 5 * math.log(2 * math.pi)) + (r * np.linalg.solve(v, r)).sum())) < 1e-3
    assert abs(got["icc"] - got["tau2"] / (got["tau2"] + got["sigma2"])) < 1e-6
    p = model.x.T @ model.x
    assert abs(got["df_u"] - 25 * np.trace(p @ np.linalg.inv(p + got["sigma2"] / got["tau2"] * np.eye(2)))) < 1e-3
    info = np.kron(a @ a.T, model.x.T @ np.linalg.solve(v, model.x))
    table = Q.QUERIES["mixed_inference"](spark, SF).toPandas()
    assert np.allclose(table["se"], np.sqrt(np.diag(np.linalg.pinv(info, hermitian=True))), rtol=1e-3) and np.allclose(table["estimate"], model.c.T.ravel(), atol=1e-5)
    y, a = C.to_numpy(D.spending(spark, SF)), C.to_numpy(D.markets(spark, SF))
    at = [a[2].index(c) for c in y[2]]
    plain = mixed.nmf_mixed(y[0], a[0][:, at], 2, init=Q._start(5, 2), outer=20, inner=10)
    got = {(r["col"], r["basis"]): r["value"] for r in Q.QUERIES["mixed_sums"](spark, SF).collect()}
    assert len(got) == 2 * len(y[2]) and all(abs(got[c, q] - plain.u[q, j]) < 1e-5 for j, c in enumerate(y[2]) for q in (0, 1))


def test_roles_by_regressions(spark):
    y, rows, _ = C.to_numpy(D.quantity(spark, SF))
    got = Q.QUERIES["split_roles"](spark, SF).orderBy("k").collect()
    assert sorted(r["name"] for r in got) == sorted(rows) and any(r["exogenous"] for r in got)
    flipped = set(mixed.split_roles(y, rows)["flipped"])
    z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, ddof=1, keepdims=True) * np.array([[-1.0 if n in flipped else 1.0] for n in rows])
    place = [rows.index(r["name"]) for r in got]
    for k in (1, 2, 5):
        beta = np.linalg.lstsq(z[place[:k]].T, z[place[k]], rcond=None)[0]
        assert abs(got[k]["influence"] - beta.max()) < 1e-5


def test_clustering_and_descriptions(spark):
    y = dense(spark)[0]
    for r, q in zip(Q.QUERIES["hclust_cpcc"](spark, SF).collect(), (2, 3), strict=True):
        b = nmf(y, None, q, maxit=500).c
        d = np.sqrt(((y[:, :, None] - y[:, None, :]) ** 2).sum(axis=0))
        assert r["rank"] == q and abs(r["silhouette"] - criteria.dense_silhouette(d, b.argmax(axis=0))) < 1e-6 and abs(r["hard"] - (b / b.sum(axis=0)).max(axis=0).mean()) < 1e-6 and -1 <= r["cpcc"] <= 1
    fit = Q.revenue_fit(spark, SF, "cov")
    row = Q.QUERIES["fit_summary"](spark, SF).first()
    assert (row["features"], row["rank"], row["iterations"]) == (5, 2, Q.ITERATIONS) and abs(row["objective"] - fit.objective) < 1e-3 and abs(row["x_sparsity"] - (fit.x < 1e-4).mean()) < 1e-4
    trace = Q.QUERIES["objective_trace"](spark, SF).orderBy("iteration").toPandas()["objective"]
    assert np.allclose(trace, fit.trace, atol=1e-6)
    texts = {r["model"]: r["dot"] for name in ("dot_text", "dot_paths") for r in Q.QUERIES[name](spark, SF).collect()}
    assert set(texts) == {"YXA", "net", "rrr", "ar", "ffb"} and texts["YXA"] == describe.fit_dot(fit)
    for text in texts.values():
        assert text.startswith("digraph") and text.count("{") == text.count("}") and " -> " in text
    assert "trade -> " in texts["ffb"] and "Basis1" not in texts["ffb"]


def test_starts_and_kernels(spark):
    x = np.array([r["x"] for r in D.vectors(spark, SF).orderBy("id").collect()])
    y = np.abs(x).T
    at = lambda name: {(r["i"], r["j"]): r["value"] for r in Q.QUERIES[name](spark, SF).collect()}
    found, plain = at("start_nndsvd"), nndsvd(y @ y.T, y.T, 4, float(y.mean()), np.random.default_rng(123))
    assert all(abs(found[i, j] - plain[i, j]) < 1e-5 for i in range(64) for j in range(4))
    found = at("start_kmeans")
    centres = np.array([[found[i, j] for j in range(4)] for i in range(64)])
    label = ((y[:, :, None] - centres[:, None, :]) ** 2).sum(axis=0).argmin(axis=1)
    assert all(np.allclose(centres[:, k], y[:, label == k].mean(axis=1), atol=1e-4) for k in range(4))
    got = {(r["u"], r["v"]): r["value"] for r in Q.QUERIES["kernel_expected"](spark, SF).collect()}
    whole = [i for i in range(len(x)) if i % 5 and i % 7]
    assert {u for u, _ in got} == set(whole) and {v for _, v in got} == {i for i in range(len(x)) if i % 5}
    for u in whole[:6]:
        for v in whole[-6:]:
            assert abs(got[u, v] - math.exp(-0.05 * ((x[u] - x[v]) ** 2).sum())) < 2e-6
    assert all(0 <= v <= 1 for v in got.values())


def test_every_query_has_a_test_of_values():
    here = open(__file__).read()
    assert all(name in Q.SQL or f'"{name}"' in here for name in Q.QUERIES)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
