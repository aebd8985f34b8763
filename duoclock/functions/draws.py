"""The numbers of `random` for many draws of one row at a time: the same keys and the same inverted distributions, on NumPy arrays."""

from __future__ import annotations

import hashlib

import numpy as np

from .random import CANDIDATES, CENTRE, CENTRE_BELOW, EDGE, EXACT, TAIL, TAIL_BELOW


def uniforms(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms in (0, 1) of each key: the first 52 bits of its MD5 and the next."""
    high, low = np.frombuffer(b"".join(hashlib.md5(k.encode()).digest() for k in keys), ">u8").astype(np.uint64).reshape(-1, 2).T
    second = ((high & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))
    return tuple((x.astype(float) + 0.5) / float(1 << 52) for x in (high >> np.uint64(12), second))


def normal_quantile(u: np.ndarray) -> np.ndarray:
    q, t = u - 0.5, np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    tail = np.polyval(TAIL, t) / np.polyval(TAIL_BELOW, t)
    return np.where(u < EDGE, tail, np.where(u > 1 - EDGE, -tail, np.polyval(CENTRE, q * q) * q / np.polyval(CENTRE_BELOW, q * q)))


def _by_steps(u: np.ndarray, mean: np.ndarray, first: np.ndarray, a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
    out, p, total = np.zeros(len(u)), first, first.copy()
    for j in range(1, int((mean + 8 * np.sqrt(mean) + 8).max(initial=0)) + 1):
        below = total < u
        if not below.any():
            break
        out += below
        p = p * (a + b / j)
        total = total + p
    return out


def _by_moments(u: np.ndarray, mean: np.ndarray, sd: np.ndarray, skew: np.ndarray, excess: np.ndarray) -> np.ndarray:
    z = normal_quantile(u)
    w = z + skew * (z * z - 1) / 6 + excess * (z * z * z - 3 * z) / 24 - skew * skew * (2 * z * z * z - 5 * z) / 36
    return np.maximum(0, np.floor(mean + sd * w + 0.5))


def poisson_quantile(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    out, small, large = np.zeros(len(u)), (mean > 0) & (mean <= EXACT), mean > EXACT
    out[small] = _by_steps(u[small], mean[small], np.exp(-mean[small]), 0.0, mean[small])
    m = mean[large]
    out[large] = _by_moments(u[large], m, np.sqrt(m), 1 / np.sqrt(m), 1 / m)
    return out


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Of n trials each, all with one chance."""
    if p <= 0:
        return np.zeros(len(u))
    if p >= 1:
        return np.maximum(n, 0.0)
    few = p <= 0.5
    if not few:
        u, p = 1 - u, 1 - p
    found, small, large = np.zeros(len(u)), (n > 0) & (n * p <= EXACT), n * p > EXACT
    odds, m = p / (1 - p), n[small]
    found[small] = np.minimum(m, _by_steps(u[small], m * p, np.exp(m * np.log(1 - p)), -odds, (m + 1) * odds))
    m = n[large]
    sd = np.sqrt(m * p * (1 - p))
    found[large] = np.minimum(m, _by_moments(u[large], m * p, sd, (1 - 2 * p) / sd, (1 - 6 * p * (1 - p)) / (sd * sd)))
    return np.where(n <= 0, 0.0, found if few else n - found)


def gamma_draw(shape: float, keys: list[str]) -> np.ndarray:
    d = (shape + 1 if shape < 1 else shape) - 1 / 3
    out, open_ = np.full(len(keys), d), np.arange(len(keys))
    for i in range(CANDIDATES):
        u1, u2 = uniforms([f"{keys[k]}|g|{i}" for k in open_])
        x = normal_quantile(u1)
        v = (1 + x / np.sqrt(9 * d)) ** 3
        good = (v > 0) & (np.log(u2) < 0.5 * x * x + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[open_[good]] = d * v[good]
        open_ = open_[~good]
        if not len(open_):
            break
    return out * uniforms([f"{k}|b" for k in keys])[0] ** (1 / shape) if shape < 1 else out


def negative_binomial_draw(mean: np.ndarray, phi: float, keys: list[str]) -> np.ndarray:
    out, on = np.zeros(len(mean)), np.flatnonzero(mean > 1e-12)
    if len(on):
        mine = [keys[k] for k in on]
        out[on] = poisson_quantile(uniforms([f"{k}|p" for k in mine])[0], mean[on] * gamma_draw(phi, mine) / phi)
    return out
