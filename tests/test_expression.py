"""Negative-binomial tests on simulated counts: a plain search gives the same fits, and planted effects come back."""

import math

import numpy as np
import pytest

from weft.operators import expression

GENES, SAMPLES = 160, 12


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(5)
    one = np.arange(SAMPLES) % 2 == 1
    size = rng.uniform(0.6, 1.6, SAMPLES)
    mean, fold = rng.uniform(30, 800, GENES), np.where(np.arange(GENES) % 8 == 0, 1.5, 0.0)
    alpha = (0.05 + 2 / mean) * np.exp(rng.normal(0, 0.3, GENES))
    mu = mean[:, None] * size * np.where(one, 2.0 ** fold[:, None], 1.0)
    y = rng.negative_binomial(1 / alpha[:, None], 1 / (1 + alpha[:, None] * mu))
    rows = [(f"s{j:02d}", i, int(y[i, j])) for i in range(GENES) for j in range(SAMPLES) if y[i, j]]
    df = spark.createDataFrame(rows, "s string, g long, n long").repartition(3)
    samples = spark.createDataFrame([(f"s{j:02d}", int(one[j])) for j in range(SAMPLES)], "s string, c int")
    got = {r.g: r for r in expression.wald_tests(df, samples, "s", "g", "n", "c").collect()}
    return y, one, alpha, fold, got


def factors(y):
    full = (y > 0).all(1)
    logs = np.log(y[full])
    return np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))


def test_gamma_functions():
    for x in (1e-3, 0.5, 1, 3.7, 40, 1e6):
        assert float(expression.log_gamma(np.array([x]))[0]) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
    assert expression.trigamma(1) == pytest.approx(math.pi**2 / 6) and expression.trigamma(5) == pytest.approx(math.pi**2 / 6 - sum(1 / k**2 for k in range(1, 5)))


def test_dispersions_maximise_the_profile(simulated):
    y, one, *_ = simulated
    size = factors(y)

    def plain(counts, mu, a):
        r = 1 / a
        ll = sum(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)) for k, m in zip(counts, mu))
        w = mu / (1 + a * mu)
        information = np.array([[w.sum(), w[one].sum()], [w[one].sum(), w[one].sum()]])
        return ll - 0.5 * math.log(np.linalg.det(information))

    for i in range(0, GENES, 13):
        q = y[i] / size
        mu = np.maximum(np.where(one, q[one].mean(), q[~one].mean()) * size, 0.5)
        best = math.exp(expression._best_dispersion(y[i : i + 1].astype(float), mu[None], one)[0])
        near = max(plain(y[i], mu, math.exp(t)) for t in np.linspace(math.log(1e-8), math.log(SAMPLES), 4000))
        assert plain(y[i], mu, best) >= near - 1e-4


def test_planted_effects_come_back(simulated):
    y, one, alpha, fold, got = simulated
    assert set(got) == set(range(GENES))
    found = np.array([got[i].log2_fold for i in range(GENES)])
    p = np.array([got[i].p for i in range(GENES)])
    shift = np.median(found[fold == 0])
    assert np.abs(found[fold > 0] - shift - 1.5).mean() < 0.35 and abs(shift) < 0.4
    assert (p[fold > 0] < 1e-3).mean() > 0.8 and 0.01 < (p[fold == 0] < 0.1).mean() < 0.3
    d = np.array([got[i].dispersion for i in range(GENES)])
    assert np.corrcoef(np.log(d), np.log(alpha))[0, 1] > 0.5 and abs(np.log(d / alpha).mean()) < 0.3
    size = factors(y)
    for i in range(0, GENES, 17):
        a = got[i].dispersion
        # the means solve the likelihood equations of either condition, and Wald's error follows
        w = []
        for own in (one, ~one):
            low, high = 1e-3, 1e7
            for _ in range(200):
                q = math.sqrt(low * high)
                low, high = (q, high) if ((y[i, own] - q * size[own]) / (1 + a * q * size[own])).sum() > 0 else (low, q)
            w.append((q, (q * size[own] / (1 + a * q * size[own])).sum()))
        assert got[i].log2_fold == pytest.approx(math.log2(w[0][0] / w[1][0]), abs=1e-6)
        assert got[i].se == pytest.approx(math.sqrt(1 / w[0][1] + 1 / w[1][1]) / math.log(2), rel=1e-6)
        assert got[i].p == pytest.approx(math.erfc(abs(got[i].log2_fold / got[i].se) / math.sqrt(2)), rel=1e-6)


def test_designs_that_cannot_be_fitted(spark):
    df = spark.createDataFrame([(f"s{j}", g, 5 + j + g) for j in range(4) for g in range(3)], "s string, g int, n long")
    with pytest.raises(ValueError, match="two samples"):
        expression.wald_tests(df, spark.createDataFrame([(f"s{j}", int(j == 0)) for j in range(4)], "s string, c int"), "s", "g", "n", "c")
    flat = expression.wald_tests(df, spark.createDataFrame([(f"s{j}", j % 2) for j in range(4)], "s string, c int"), "s", "g", "n", "c").collect()
    assert len(flat) == 3 and all(r.p > 0.3 for r in flat)
