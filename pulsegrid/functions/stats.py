"""Small statistical kernels on arrays: the normal distribution, the Shapiro-Wilk test, variance components."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(x).tolist()]).reshape(np.shape(x))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(v) for v in np.ravel(p).tolist()]).reshape(np.shape(p))


#: Fixed values of Royston's approximation (1995), lowest power first: corrections of the two outermost weights in
#: 1 / sqrt(n), then location and log scale of the transformed statistic for up to 11 values in n and beyond in ln n.
OUTER, NEXT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
MANY = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
FEW_LIMIT = (-2.273, 0.459)


def _poly(c: tuple, x: float) -> float:
    return sum(a * x**k for k, a in enumerate(c))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the ordered values, antisymmetric and of unit length."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    total, x = float(m @ m), 1 / math.sqrt(n)
    outer = [_poly(c, x) + m[-1 - k] / math.sqrt(total) for k, c in enumerate((OUTER, NEXT) if n > 5 else (OUTER,))]
    fixed = len(outer)
    rest = total - 2 * float(m[-fixed:] @ m[-fixed:])
    a = m / math.sqrt(rest / (1 - 2 * sum(w * w for w in outer)))
    for k, w in enumerate(outer):
        a[-1 - k], a[k] = w, -w
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p; nans for fewer than three values or equal ones."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    spread = float(((x - x.mean()) ** 2).sum()) if n else 0.0
    if n < 3 or spread <= 0 or x[0] == x[-1]:
        return math.nan, math.nan
    w = min(1.0, float(shapiro_weights(n) @ x) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        limit = _poly(FEW_LIMIT, n)
        if y >= limit:
            return w, 0.0
        y, (location, scale), at = -math.log(limit - y), FEW, float(n)
    else:
        (location, scale), at = MANY, math.log(n)
    z = (y - _poly(location, at)) / math.exp(_poly(scale, at))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def skewness(values: np.ndarray) -> float:
    d = np.asarray(values, float) - np.mean(values)
    spread = float((d**2).mean())
    return float((d**3).mean()) / spread**1.5 if spread > 0 else math.nan


def random_intercept(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sy: np.ndarray, sxy: np.ndarray, syy: np.ndarray) -> dict | None:
    """Restricted maximum likelihood of y = X b + u(group) + e from each group's sums.

    n (g), sx (g, p), sxx (g, p, p), sy (g), sxy (g, p), syy (g); X has its intercept column. The ratio of the variances is
    profiled out on a grid of its logarithm, refined by golden section. None where X is not of full rank.
    """
    total, p = float(n.sum()), sx.shape[1]
    if np.linalg.matrix_rank(sxx.sum(0)) < p or total <= p:
        return None

    def at(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        shrink = ratio / (1 + n * ratio)
        a = sxx.sum(0) - np.einsum("g,gi,gj->ij", shrink, sx, sx)
        b = sxy.sum(0) - (shrink * sy) @ sx
        beta = np.linalg.solve(a, b)
        rest = max(float(syy.sum() - shrink @ sy**2 - beta @ b), 1e-300)
        fit = (total - p) * math.log(rest / (total - p)) + float(np.log1p(n * ratio).sum()) + np.linalg.slogdet(a)[1]
        return fit, beta, a, rest / (total - p)

    grid = np.append(-np.inf, np.linspace(-18, 18, 73))
    scores = [at(float(np.exp(g)))[0] for g in grid]
    k = int(np.argmin(scores))
    ratio = float(np.exp(grid[k]))
    if k:
        lo, hi = (grid[max(1, k - 1)], grid[min(len(grid) - 1, k + 1)])
        gold = (math.sqrt(5) - 1) / 2
        for _ in range(60):
            u, v = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, v) if at(math.exp(u))[0] < at(math.exp(v))[0] else (u, hi)
        ratio = math.exp((lo + hi) / 2)
    _, beta, a, residual = at(ratio)
    return {
        "beta": beta, "se": np.sqrt(np.diag(np.linalg.inv(a)) * residual), "group_variance": ratio * residual,
        "residual_variance": residual, "converged": 0 < k < len(grid) - 1 or k == 0,
    }
