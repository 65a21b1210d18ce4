"""Plain single-machine versions for tests."""

import math

import numpy as np


def plain_tmm(counts):
    n = counts.sum(0).astype(float)
    u = np.quantile(counts / n, 0.75, axis=0)
    ref = int(np.argmin(np.abs(u - u.mean())))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    f = np.zeros(counts.shape[1])
    for k in range(counts.shape[1]):
        both = (counts[:, k] > 0) & (counts[:, ref] > 0)
        y, r = counts[both, k].astype(float), counts[both, ref].astype(float)
        if k != ref:
            p, q = y / n[k], r / n[ref]
            m, a, v = np.log2(p / q), np.log2(p * q) / 2, (n[k] - y) / n[k] / y + (n[ref] - r) / n[ref] / r
            c, fine = len(y), np.ones(len(y), bool)
            for x, trim in ((rank(m), 0.3), (rank(a), 0.05)):
                low = math.floor(c * trim) + 1
                fine &= (x >= low) & (x <= c + 1 - low)
            f[k] = (m[fine] / v[fine]).sum() / (1 / v[fine]).sum()
    return 2 ** (f - f.mean())


def ranks(v):
    v = np.asarray(v)
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2
