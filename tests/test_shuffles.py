"""Shuffled labels with a refitted null model, against plain logistic fits."""

import hashlib
import random

import numpy as np
import pytest

from weft.operators import shuffles

R = 50


def fitted(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p)
        beta = beta + np.linalg.solve((x.T * w) @ x, x.T @ (y - p))
    return 1 / (1 + np.exp(-x @ beta))


@pytest.mark.parametrize("packed", [20, 1 << 17])
def test_scores_of_every_shuffle(spark, monkeypatch, packed):
    monkeypatch.setattr(shuffles, "PACKED", packed)
    monkeypatch.setattr(shuffles, "HASHES", 700)
    monkeypatch.setattr(shuffles, "BUCKET", 16)
    rng = random.Random(6)
    rows = [(i, int(rng.random() < 0.4), rng.gauss(0, 1)) for i in range(70)]
    features = [(i, f, float(rng.randint(1, 3))) for i in range(70) for f in ("everywhere", "half", "rare") if f == "everywhere" or rng.random() < {"half": 0.5, "rare": 0.08}[f]]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, 1, None)], "id long, y int, x double").repartition(3)
    fs = spark.createDataFrame([*features, (900, "half", 5.0)], "id long, feature string, value double")
    got = {r.feature: np.frombuffer(r.z) for r in shuffles.shuffled_scores(df, fs, "id", "y", ["x"], R, "s").collect()}
    x, y = np.array([[1, r[2]] for r in rows]), np.array([r[1] for r in rows])
    want = {f: [] for f in got}
    for r in range(1, R + 1):
        order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"s|{r}|{i}".encode()).hexdigest())
        drawn = np.empty(len(rows))
        drawn[order] = y
        mu = fitted(x, drawn)
        w = mu * (1 - mu)
        inverse = np.linalg.inv((x.T * w) @ x)
        for f in got:
            v = np.zeros(len(rows))
            for i, name, value in features:
                if name == f:
                    v[i] = value
            c = x.T @ (w * v)
            want[f].append(v @ (drawn - mu) / np.sqrt(v @ (w * v) - c @ inverse @ c))
    assert set(got) == {"everywhere", "half", "rare"}
    for f, z in want.items():
        assert got[f].tolist() == pytest.approx(z, abs=1e-6)
    scores = spark.createDataFrame([(f, z.tobytes()) for f, z in got.items()], "feature string, z binary")
    table = np.abs(np.stack(list(got.values())))
    ends = {r.replicate: (r.max_abs_z, r.n_beyond) for r in shuffles.null_extremes(scores, R, 1.5).collect()}
    assert ends == {r + 1: (table[:, r].max(), (table[:, r] >= 1.5).sum()) for r in range(R)}
