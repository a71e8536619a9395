"""Masks, sums over samples, starts and consensus against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.functions.dense import nndsvd
from factorlab.operators import criteria, infer, resample, starts, steps, sums
from factorlab.operators.fit import equilibrium, nmf, nmf_net, nmf_rrr, nmf_signed
from factorlab.sources import cells as C


def planted(p, n, q, seed=0):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 1, (p, q)) @ rng.uniform(0, 1, (q, n)) + 0.01


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(5)
    return rng.uniform(0.1, 1, (4, 14)), rng.uniform(0.1, 1, (3, 14))


def cells(spark, m, prefix=""):
    return C.to_cells(spark, m, list(range(len(m))), [f"{prefix}{j:03d}" for j in range(m.shape[1])] if prefix else None)


# ---------------------------------------------------------------- weights and masks


def test_unit_weights_change_nothing_and_masked_values_are_never_seen(pair):
    y, a = pair
    ones = np.ones_like(y)
    start = np.ones((4, 2)) + np.eye(4, 2), np.ones((2, 2)) + np.eye(2), np.ones((2, 3)) + np.eye(2, 3)
    plain = steps.reduced_rank
    x1, c, x2 = start
    for _ in range(5):
        x1, c, x2 = plain(sums.Dense, x1, c, x2, y @ a.T, a @ a.T)
    by_cells = start
    for _ in range(5):
        by_cells = steps.reduced_rank_cells(sums.Dense, *by_cells, y, a, ones)
    for m, n in zip((x1, c, x2), by_cells, strict=True):
        assert np.allclose(m, n, atol=1e-8)
    w = np.where(np.random.default_rng(1).uniform(size=y.shape) < 0.3, 0.0, 1.0)
    odd = np.where(w > 0, y, 1e6)
    for options in ({}, {"method": "KL"}, {"signed": True}):
        one, two = (nmf_rrr(m, a, 2, 2, weights=w, maxit=20, **options) for m in (y, odd))
        assert np.allclose(one.x @ one.extra["b1"], two.x @ two.extra["b1"])
    three = nmf_rrr(np.where(w > 0, y, np.nan), a, 2, 2, maxit=20)
    assert np.allclose(three.x, nmf_rrr(y, a, 2, 2, weights=w, maxit=20).x)


def test_reduced_rank_divergence_never_rises(pair):
    y, a = pair
    w = np.random.default_rng(2).uniform(0, 2, y.shape)
    for weights in (None, w):
        trace = nmf_rrr(y, a, 2, 2, method="KL", weights=weights, maxit=60, epsilon=0).trace
        assert all(b <= a + 1e-9 * abs(a) for a, b in zip(trace, trace[1:], strict=False))
        trace = nmf_rrr(y, a, 2, 2, weights=w, maxit=60, epsilon=0).trace
        assert all(b <= a + 1e-9 * abs(a) for a, b in zip(trace, trace[1:], strict=False))
    with pytest.raises(ValueError):
        nmf_rrr(y, a, 2, signed=True, method="KL")


def test_network_weights(pair):
    rng = np.random.default_rng(3)
    m = rng.uniform(0, 1, (9, 2))
    y = m @ np.array([[2, 0.3], [0.3, 1]]) @ m.T
    w = np.where(rng.uniform(size=y.shape) < 0.15, 0.0, 1.0)
    w = w * w.T
    for kind in ("tri", "bi", "signed"):
        fit = nmf_net(y, 2, kind, weights=w, maxit=3000, epsilon=1e-12)
        odd = nmf_net(np.where(w > 0, y, 77.0), 2, kind, weights=w, maxit=3000, epsilon=1e-12)
        assert np.allclose(fit.x, odd.x)
        gaps = nmf_net(np.where(w > 0, y, np.nan), 2, kind, maxit=3000, epsilon=1e-12)
        assert np.allclose(fit.x @ fit.c @ fit.x.T, gaps.x @ gaps.c @ gaps.x.T)
        if kind == "tri":
            hat = fit.x @ fit.c @ fit.x.T
            assert np.abs((y - hat)[w == 0]).max() < 0.1 * y.max()  # what was left out is found again
    one = y.copy()
    one[2, 5] = np.nan  # weights given: the mirrored cell is known
    assert np.allclose(nmf_net(one, 2, weights=np.ones_like(y), maxit=20).x, nmf_net(y, 2, maxit=20).x)


def test_masked_cross_validation_against_plain_loops(spark, pair):
    y, a = pair
    y = y.copy()
    y[1, 3] = np.nan
    folds = resample.element_folds(y.shape, 3, valid=~np.isnan(y))
    known = np.nan_to_num(y)
    for family in ("rrr", "rrr_signed"):
        got = {(r["rank"], r["rank2"]): r["loss"] for r in resample.ecv(spark, y, a, (1, 2), 3, family=family, ranks2=(1, 2), maxit=15).collect()}
        for (q, r), loss in got.items():
            plain = []
            for f in (1, 2, 3):
                fit = nmf_rrr(known, a, q, r, weights=((folds != f) & (folds > 0)).astype(float), signed=family == "rrr_signed", maxit=15)
                plain.append(((y - fit.x @ fit.c @ fit.extra["x2"] @ a)[folds == f] ** 2).mean())
            assert abs(loss - np.mean(plain)) < 1e-9
        assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    paired = resample.ecv(spark, y, a, (1, 2), 3, family="rrr", maxit=15)
    assert paired.columns == ["rank", "loss", "sigma"] and paired.count() == 2
    net = planted(8, 8, 2)
    net = net + net.T
    folds = resample.triangle_folds(8, 3)
    for kind in ("tri", "signed"):
        got = resample.ecv(spark, net, None, (2,), 3, family="net", kind=kind, maxit=15).first()["loss"]
        plain = []
        for f in (1, 2, 3):
            fit = nmf_net(net, 2, kind, weights=(folds != f).astype(float), maxit=15)
            plain.append(((net - fit.x @ fit.c @ fit.x.T)[np.triu(folds == f)] ** 2).mean())
        assert abs(got - np.mean(plain)) < 1e-9
    with pytest.raises(ValueError):
        resample.ecv(spark, y, a, (1,), 3, ranks2=(1,))


# ---------------------------------------------------------------- sums


def test_cross_validation_from_fold_sums_equals_the_plain_loop(spark, pair):
    y, a = pair
    folds = resample.column_folds(14, 3)
    x0 = np.ones((4, 2)) + np.eye(4, 2)
    known = cells(spark, y, "s"), cells(spark, a, "s").repartition(5)
    plain = {"nmf": [], "signed": [], "rrr": []}
    c0, n0, x2 = np.full((2, 3), 0.5), np.full((2, 3), 0.1), np.ones((2, 3)) / 3 + np.eye(2, 3)
    for f in (1, 2, 3):
        train, test = folds != f, folds == f
        gap = lambda fit: ((y[:, test] - fit.fitted(a[:, test])) ** 2).sum()
        plain["nmf"].append(gap(nmf(y[:, train], a[:, train], 2, init=x0, fixed_iterations=40)))
        plain["signed"].append(gap(nmf_signed(y[:, train], a[:, train], 2, init=x0, cp_init=c0, cn_init=n0, fixed_iterations=40)))
        fit = nmf_rrr(y[:, train], a[:, train], 2, 2, init=(x0, c0[:, :2], x2), fixed_iterations=40)
        plain["rrr"].append(((y[:, test] - fit.x @ fit.c @ fit.extra["x2"] @ a[:, test]) ** 2).sum())
    given = {"nmf": {}, "signed": {"c_init": c0, "cn_init": n0}, "rrr": {"c_init": c0[:, :2], "x2_init": x2}}
    for family, options in given.items():
        row = resample.cv(spark, *known, (2,), 3, family=family, init=x0, fixed_iterations=40, **options).first()
        assert abs(row["loss"] - sum(plain[family]) / y.size) < 1e-9 and abs(row["sigma"] - np.sqrt(row["loss"])) < 1e-12
    curve = resample.cv(spark, *known, (1, 2, 3), 5, family="rrr_signed", ranks2=(1, 2)).collect()
    assert len(curve) == 6 and all(np.isfinite(r["loss"]) for r in curve)


def test_fold_sums_read_the_samples_once_and_refuse_gaps(spark, pair, capsys):
    y, a = pair
    placed = sums.placed_samples(sums.paired_samples(cells(spark, y), cells(spark, a))[0])
    parts = sums.fold_sums(placed, 4, 3, 4, shuffle=False)
    folds = resample.column_folds(14, 4, shuffle=False)
    for f, s in enumerate(parts):
        here = folds == f + 1
        assert np.allclose(s.ya, y[:, here] @ a[:, here].T) and np.allclose(s.aa, a[:, here] @ a[:, here].T) and abs(s.yy - (y[:, here] ** 2).sum()) < 1e-9 and s.n == here.sum()
    missing = cells(spark, y).withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 2), None).otherwise(F.col("value")))
    with pytest.raises(ValueError):
        sums.paired_samples(missing, cells(spark, a))
    with pytest.raises(ValueError):
        sums.paired_samples(cells(spark, y - 1), cells(spark, a))
    with pytest.raises(ValueError):
        resample.cv(spark, cells(spark, y), cells(spark, a), (2,), 15)
    with pytest.raises(ValueError):
        resample.cv(spark, cells(spark, y), None, (2,), 3)


def test_replicate_sums_and_inference_against_plain_loops(spark, pair):
    y, a = pair
    placed = sums.placed_samples(sums.paired_samples(cells(spark, y), cells(spark, a))[0]).repartition(3)
    w = sums.replicate_weights(np.arange(1, 15), np.arange(1, 7), "pairs", 9)
    got = {r["replicate"]: r["values"] for r in sums.replicate_sums(placed, lambda y, a: y, lambda y, a: a, 6, "pairs", 9).collect()}
    for b in range(6):
        assert np.allclose(np.reshape(got[b + 1], (4, 3)), (y * w[:, b]) @ a.T)
    m = np.full((4, 3), 0.4)
    w = sums.replicate_weights(np.arange(1, 15), np.arange(1, 4), "mammen", 9)
    got = {r["replicate"]: r["values"] for r in sums.wild_sums(placed, m, 3, "mammen", 9).collect()}
    for b in range(3):
        assert np.allclose(np.reshape(got[b + 1], (4, 3)), np.maximum(m @ a + (y - m @ a) * w[:, b], 0) @ a.T)

    fit = nmf(cells(spark, y), cells(spark, a), 2, init=np.ones((4, 2)) + np.eye(4, 2), maxit=200)
    dense = infer.infer(spark, fit, y, a, bootstrap=False).toPandas()
    table = infer.infer(spark, fit, cells(spark, y), cells(spark, a), draws=30, kind="exp").toPandas()
    for c in ("estimate", "se", "z_value", "p_value"):
        assert np.allclose(dense[c], table[c])
    _, inverse, _, s = infer.covariance(y, fit.x, fit.c, a)
    w = sums.replicate_weights(np.arange(1, 15), np.arange(1, 31), "exp")
    draws = np.array([np.maximum(fit.c.T.ravel() - inverse @ (s @ w[:, b]), 0) for b in range(30)])
    assert np.allclose(table["bse"], draws.std(axis=0, ddof=1)) and np.allclose(table["ci_low"], np.quantile(draws, 0.025, axis=0))
    table = infer.infer(spark, fit, cells(spark, y), cells(spark, a), draws=5, method="refit", refit_maxit=50).toPandas()
    w, hat = sums.replicate_weights(np.arange(1, 15), np.arange(1, 6), "rademacher"), fit.fitted(a)
    draws = np.array([nmf(np.maximum(hat + (y - hat) * w[:, b], 0), a, 2, init=fit.x, c_init=np.maximum(fit.c, 1e-8), restriction="fixed", epsilon=1e-8, maxit=50).c.T.ravel() for b in range(5)])
    assert np.allclose(table["bse"], draws.std(axis=0, ddof=1), rtol=1e-5)
    by_element = infer.infer(spark, fit, y, a, draws=200, unit="element").toPandas()
    assert np.allclose(by_element["se"], table["se"]) and (by_element["bse"] > 0).all()
    with pytest.raises(ValueError):
        infer.infer(spark, fit, cells(spark, y), cells(spark, a), unit="element")


def test_multipliers_have_mean_zero_and_variance_one():
    for kind in ("rademacher", "exp", "mammen"):
        w = sums.replicate_weights(np.arange(1, 3001), np.arange(1, 21), kind)
        assert abs(w.mean()) < 0.02 and abs(w.var() - 1) < 0.03
        assert np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.09 and np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.9
    counts = sums.replicate_weights(np.arange(1, 5001), np.arange(1, 11), "pairs")
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.03


def test_path_bootstrap_from_sums_against_a_plain_loop(spark):
    from factorlab.operators.fit import nmf_ffb

    rng = np.random.default_rng(8)
    y2 = rng.uniform(0.1, 1, (2, 40))
    y1 = rng.uniform(0, 1, (3, 2)) @ y2 + 0.05 * rng.uniform(size=(3, 40))
    fit = nmf_ffb(y1, y2, 2, maxit=200)
    fit = type(fit)(**(fit.__dict__ | {"rows": [0, 1, 2], "covariates": [0, 1]}))
    got = infer.infer_ffb_cells(fit, cells(spark, y1), cells(spark, y2), draws=12, maxit=60).toPandas()
    w = sums.replicate_weights(np.arange(1, 41), np.arange(1, 13), "pairs")
    draws = []
    for b in range(12):
        rng = np.random.default_rng([123, 1001 + b])
        c1, c2, n = rng.uniform(0, 0.1, (2, 3)), rng.uniform(0, 1, (2, 2)), w[:, b]
        s = np.concatenate([y1, y2]) * n @ np.concatenate([y1, y2]).T
        trace = []
        for i in range(60):
            c1, c2 = steps.feedback_paths(sums.Dense, fit.x, c1, c2, s[:3, :3], s[:3, 3:], s[3:, 3:], 1.0, 0.1)[1:]
            trace.append(float((n * (y1 - fit.x @ (c1 @ y1 + c2 @ y2)) ** 2).sum()))
            if i >= 9 and abs(trace[-1] - trace[-2]) / max(abs(trace[-1]), 1.0) <= 1e-6:
                break
        o = equilibrium(fit.x, c1, c2)
        if o["radius"] < 1 and (not np.isfinite(o["bound"]) or o["amplification"] <= 1.01 * o["bound"]):
            draws.append(np.concatenate([c1, c2], axis=1))
    draws = np.array(draws)
    assert (got["valid"] == len(draws)).all()
    for _, r in got.iterrows():
        q, k = int(r["basis"][5:]) - 1, int(r["covariate"]) + (0 if r["type"] == "C1" else 3)
        assert abs(r["bse"] - draws[:, q, k].std(ddof=1)) < 1e-7 and abs(r["support_rate"] - (draws[:, q, k] > 0.01).mean()) < 1e-9


# ---------------------------------------------------------------- starts, consensus


def test_starts_of_samples(spark):
    y = planted(6, 60, 3, 4)
    frame = spark.createDataFrame([(f"s{j}", [float(v) for v in y[:, j]]) for j in range(60)] + [("null", None), ("gap", [1.0, None, 1.0, 1.0, 1.0, 1.0])], "col string, y array<double>")
    dense = nndsvd(y @ y.T, y.T, 3, float(y.mean()), np.random.default_rng(123))
    assert np.allclose(starts.nndsvd_samples(frame, 3), dense, atol=1e-7)
    one, two = (starts.kmeans_samples(frame.repartition(n), 3) for n in (1, 7))
    assert np.allclose(one, two)
    spread = lambda c: ((y[:, :, None] - c[:, None, :]) ** 2).sum(axis=0).min(axis=1).sum()
    least = min(spread(y[:, np.random.default_rng(s).choice(60, 3, replace=False)]) for s in range(50))
    assert spread(one) < least
    same = spark.createDataFrame([(j, [1.0, 2.0]) for j in range(5)], "col int, y array<double>")
    assert starts.kmeans_samples(same, 3).shape == (2, 3) and (starts.kmeans_samples(same, 3) > 0).all()
    with pytest.raises(ValueError):
        starts.kmeans_samples(same.where("col > 9"), 2)


def test_consensus_from_classes(spark):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, (5, 40))
    labels[:, 10:20] = labels[:, :1]  # a class of eleven
    rows = [(r, f"i{i:02d}", int(labels[r, i])) for r in range(5) for i in range(40) if (r, i) != (2, 33)]
    frame = spark.createDataFrame(rows, "run int, id string, label int")
    matrix = criteria.consensus(frame).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
    seen = np.array([[(r, i) != (2, 33) for i in range(40)] for r in range(5)])
    plain = np.array([[np.mean([labels[r, i] == labels[r, j] and seen[r, i] and seen[r, j] for r in range(5)]) for j in range(40)] for i in range(40)])
    assert np.allclose(matrix, plain)
    below = plain[np.tril_indices(40, -1)]
    got = criteria.consensus_measures(frame).first()
    # the sample without a label of one run is a class of its own, whose pair with itself agrees in the other runs only
    assert abs(got["dispersion"] - (4 * (plain - 0.5) ** 2).mean()) < 1e-9 and abs(got["pac"] - ((below > 0.1) & (below < 0.9)).mean()) < 1e-9
    assert criteria.consensus_classes(frame).count() <= 40 - 10


def test_flow_against_a_plain_layout(spark):
    rng = np.random.default_rng(7)
    labels = rng.integers(0, 3, (2, 25))
    frame = spark.createDataFrame([(i, f, int(labels[f, i])) for f in range(2) for i in range(25)], "id int, fit int, label int")
    key = {i: k + 1 for k, i in enumerate(sorted(range(25), key=lambda i: (labels[1, i], i)))}
    want = {}
    for f in range(2):
        kinds = sorted(set(labels[f]), key=lambda c: (np.mean([key[i] for i in range(25) if labels[f, i] == c]), c))
        place = 0
        for block, c in enumerate(kinds):
            for i in sorted((i for i in range(25) if labels[f, i] == c), key=key.get):
                place += 1
                want[f, i] = place + block * 25 / len(kinds)
    got = {(r["fit"], r["id"]): r["position"] for r in criteria.flow_layout(frame, 1).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ---------------------------------------------------------------- vectors with gaps


def test_vectors_that_are_not_whole_take_no_part(spark):
    from factorlab.operators import algebra, prep

    rng = np.random.default_rng(9)
    x = rng.normal(size=(7, 3))
    rows = [(i, [float(v) for v in x[i]]) for i in range(7)]
    odd = [(7, None), (8, [1.0, None, 2.0]), (9, [1.0, float("nan"), 2.0]), (None, [1.0, 1.0, 1.0]), (10, [])]
    known, frame = (spark.createDataFrame(r, "id int, x array<double>") for r in (rows, rows + odd))
    table = lambda df, *keys: {tuple(r[k] for k in keys): r["value"] for r in df.collect()}
    for kind in prep.KERNELS:
        beta = (1.0, 1.0) if kind == "periodic" else 0.5
        assert table(prep.kernel(frame, frame, kind, beta), "u", "v") == pytest.approx(table(prep.kernel(known, known, kind, beta), "u", "v"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.where(np.eye(7) > 0, np.inf, 0)
    assert table(prep.nearest(frame), "u") == pytest.approx({(i,): d[i].min() for i in range(7)})
    assert prep.bandwidth(frame, grid=[0]).first()["beta"] == pytest.approx(1 / (2 * np.median(d.min(axis=1)) ** 2))
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "id int, label int")
    assert criteria.silhouette(frame, labels).first()[0] == pytest.approx(criteria.dense_silhouette(np.where(np.isinf(d), 0, d), np.arange(7) % 2))
    assert criteria.distance_correlation(frame, known.select("id", F.slice("x", 1, 2).alias("x"))).first()[0] == pytest.approx(criteria.distance_correlation(known, known.select("id", F.slice("x", 1, 2).alias("x"))).first()[0])
    named = frame.where("id IS NOT NULL")  # sums need no ids
    assert np.allclose(algebra.gram_numpy(named, "x", "x"), x.T @ x)
    both = named.select(F.col("x").alias("y"), F.col("x").alias("a"))
    ya, aa, yy, low = algebra.statistics(both, 3, 3)
    assert np.allclose(ya, x.T @ x) and np.allclose(aa, x.T @ x) and abs(yy - (x**2).sum()) < 1e-9 and low == x.min()
    partial = prep.kernel_partial(known, frame, 0.5)
    assert {r["v"] for r in partial.collect()} == {*range(10)}
    with pytest.raises(Exception, match="differ in length"):
        prep.kernel(known, known.union(spark.createDataFrame([(70, [1.0])], "id int, x array<double>"))).collect()


def test_partial_kernel_does_not_cancel(spark):
    from factorlab.operators import prep

    u = spark.createDataFrame([(1, [1e8, 1.0, 2.0])], "id int, x array<double>")
    v = spark.createDataFrame([(1, [1e8, 1.5, None]), (2, [None, None, None])], "id int, x array<double>")
    got = {r["v"]: r["value"] for r in prep.kernel_partial(u, v, 0.5).collect()}
    assert got[1] == pytest.approx(np.exp(-0.5 * 1.5 * 0.25)) and got[2] == 0.0


def test_contiguous_folds_of_crowded_ids(spark):
    from factorlab.operators import prep

    ids = [*range(50), 10**12]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["fold"] for r in prep.folds(frame, 4, "id", shuffle=False).collect()}
    assert [got[i] for i in ids] == [1] * 13 + [2] * 13 + [3] * 13 + [4] * 12
