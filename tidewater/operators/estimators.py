"""Estimators that need linear algebra, search or nested loops: numpy on one series, pair or panel at a time.

Each takes arrays and returns numbers or rows; grouped() runs one over the
groups of a DataFrame, so series, pairs and windows spread over the cluster.
A panel estimator's input is T x N for the names of one panel, never the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.scalar import f_tail


def grouped(df: DataFrame, keys: list[str], order: str, columns: list[str], f: Callable[..., dict | list[dict]], schema: str) -> DataFrame:
    """keys and the row or rows that f gives for the group's columns, in order."""
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        out = f(*(frame[c].to_numpy(float) for c in columns))
        rows = out if isinstance(out, list) else [out]
        made = pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])
        for k, v in zip(keys, key, strict=True):
            made[k] = v
        return made[[*keys, *(c for c in made.columns if c not in keys)]]

    return df.select(*keys, order, *(c for c in columns if c != order)).groupBy(*keys).applyInPandas(run, f"{key_types}, {schema}")


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients with the intercept first, residual sum of squares, standard errors)."""
    a = np.column_stack([np.ones(len(y)), x])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ b
    sse = float(e @ e)
    cov = np.linalg.pinv(a.T @ a) * sse / max(1, len(y) - a.shape[1])
    return b, sse, np.sqrt(np.maximum(np.diag(cov), 0))


def lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-lags] for t from lags on."""
    return np.column_stack([x[lags - k : len(x) - k] for k in range(1, lags + 1)])


def granger(x: np.ndarray, y: np.ndarray, lags: int = 2) -> dict:
    """Whether x helps to predict y: F of the added lags and its p."""
    n = len(y) - lags
    if n <= 3 * lags + 1:
        return {"f": 0.0, "p": 1.0}
    own, both = lagged(y, lags), np.column_stack([lagged(y, lags), lagged(x, lags)])
    _, s0, _ = ols(own, y[lags:])
    _, s1, _ = ols(both, y[lags:])
    free = n - both.shape[1] - 1
    f = max(0.0, (s0 - s1) / lags / (s1 / free)) if s1 > 0 else 0.0
    return {"f": f, "p": f_tail(f, lags, free)}


def adf(x: np.ndarray, lags: int = 1) -> dict:
    """Augmented Dickey-Fuller t of the level, with intercept."""
    d = np.diff(x)
    if len(d) <= 2 * lags + 4:
        return {"t": 0.0}
    cols = [x[lags:-1]] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
    b, _, se = ols(np.column_stack(cols), d[lags:])
    return {"t": float(b[1] / se[1]) if se[1] > 0 else 0.0}


def distance_correlation(x: np.ndarray, y: np.ndarray) -> dict:
    """From double-centred distances; 0 below four values."""
    if len(x) < 4:
        return {"dcor": 0.0}

    def centred(v: np.ndarray) -> np.ndarray:
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    va, vb = (a * a).mean(), (b * b).mean()
    return {"dcor": math.sqrt(max(0.0, (a * b).mean()) / math.sqrt(va * vb)) if va * vb > 0 else 0.0}


def hurst(x: np.ndarray) -> dict:
    """Rescaled range: slope of ln R/S on ln size over chunk sizes 8, 12, 18, ...; null below 32 values or 4 sizes."""
    if len(x) < 32:
        return {"hurst": None}
    size, points = 8, []
    while size <= len(x) // 2:
        chunks = x[: len(x) // size * size].reshape(-1, size)
        dev = np.cumsum(chunks - chunks.mean(1, keepdims=True), axis=1)
        sd = chunks.std(1)
        ok = sd > 0
        if ok.any():
            rs = ((dev.max(1) - dev.min(1))[ok] / sd[ok]).mean()
            if rs > 0:
                points.append((math.log(size), math.log(rs)))
        size = math.ceil(size * 1.5)
    if len(points) < 4:
        return {"hurst": None}
    slope = np.polyfit(*np.array(points).T, 1)[0]
    return {"hurst": float(np.clip(slope, 0, 1))}


def ccm(x: np.ndarray, y: np.ndarray, embed: int = 3, tau: int = 1, library: int | None = None, seed: int = 42) -> dict:
    """Cross-map skill of x from the shadow manifold of y; a library without held-out rows scores 0."""
    n = len(y) - (embed - 1) * tau
    if n < embed + 4:
        return {"rho": 0.0}
    m = np.column_stack([y[k * tau : k * tau + n] for k in range(embed)])
    target = x[(embed - 1) * tau :]
    size = min(library or n * 2 // 3, n)
    rng = np.random.default_rng(seed)
    lib = np.sort(rng.choice(n, size, replace=False))
    test = np.setdiff1d(np.arange(n), lib)
    if not len(test):
        return {"rho": 0.0}
    d = np.linalg.norm(m[test][:, None] - m[lib][None], axis=2)
    near = np.argsort(d, axis=1, kind="stable")[:, : embed + 1]
    dist = np.take_along_axis(d, near, 1)
    w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
    guess = (w * target[lib][near]).sum(1) / w.sum(1)
    return {"rho": _corr(guess, target[test])}


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    s = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / s if s > 0 else 0.0


def garch_fit(r: np.ndarray) -> dict:
    """omega, alpha, beta by a grid with the variance pinned to the sample's; null below 50 returns."""
    if len(r) < 50:
        return {"omega": None, "alpha": None, "beta": None}
    v, best = float(r.var()), (math.inf, 0.0, 0.0, 0.0)
    for alpha in (0.02, 0.05, 0.08, 0.1, 0.15, 0.2):
        for beta in (0.7, 0.75, 0.8, 0.85, 0.88, 0.9, 0.94):
            if alpha + beta >= 0.999:
                continue
            omega = v * (1 - alpha - beta)
            s, loss, before = v, 0.0, r[0]
            for x in r.tolist():
                s = omega + alpha * before * before + beta * s
                loss += math.log(max(s, 1e-300)) + x * x / max(s, 1e-300)
                before = x
            best = min(best, (loss, omega, alpha, beta))
    return {"omega": best[1], "alpha": best[2], "beta": best[3]}


def hmm_fit(r: np.ndarray, states: int = 2, rounds: int = 25, tol: float = 1e-4) -> list[dict]:
    """Gaussian Baum-Welch from quantile starts; states in order of variance."""
    n = len(r)
    if n < 30:
        return []
    q = np.array_split(np.sort(r), states)
    mu, var = np.array([c.mean() for c in q]), np.full(states, max(r.var(), 1e-12)) * np.linspace(0.5, 1.5, states)
    a = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(a, 0.9)
    pi, last = np.full(states, 1 / states), -math.inf
    for _ in range(rounds):
        dens = np.exp(-((r[:, None] - mu) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
        f, scale = np.zeros((n, states)), np.zeros(n)
        for t in range(n):
            f[t] = (pi if t == 0 else f[t - 1] @ a) * dens[t]
            scale[t] = max(f[t].sum(), 1e-300)
            f[t] /= scale[t]
        b = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            b[t] = a @ (dens[t + 1] * b[t + 1]) / scale[t + 1]
        g = f * b
        g /= g.sum(1, keepdims=True)
        xi = np.einsum("ti,ij,tj->ij", f[:-1], a, dens[1:] * b[1:] / scale[1:, None])
        a = xi * 1.0
        a /= np.maximum(a.sum(1, keepdims=True), 1e-300)
        pi, w = g[0], np.maximum(g.sum(0), 1e-12)
        mu = (g * r[:, None]).sum(0) / w
        var = np.maximum((g * (r[:, None] - mu) ** 2).sum(0) / w, 1e-12)
        ll = float(np.log(scale).sum())
        if ll - last < tol:
            break
        last = ll
    order = np.argsort(var, kind="stable")
    return [{"state": k, "mean": float(mu[i]), "variance": float(var[i]), "stay": float(a[i, i]), "share": float(g[:, i].mean())} for k, i in enumerate(order.tolist())]


def regime_names(states: list[dict]) -> list[dict]:
    """Bear: the largest variance; of the rest the larger mean is Bull, the other Sideways."""
    if len(states) != 3:
        return states
    bear = max(range(3), key=lambda k: states[k]["variance"])
    bull, side = sorted((k for k in range(3) if k != bear), key=lambda k: -states[k]["mean"])
    return [s | {"regime": {bear: "Bear", bull: "Bull", side: "Sideways"}[k]} for k, s in enumerate(states)]


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, rounds: int = 300, step: float = 0.5, tol: float = 1e-8) -> np.ndarray:
    pts = [x0] + [x0 + step * e for e in np.eye(len(x0))]
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(vals, kind="stable")
        pts, vals = [pts[i] for i in o], [vals[i] for i in o]
        if abs(vals[-1] - vals[0]) < tol:
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            k = c + 0.5 * (pts[-1] - c)
            fk = f(k)
            if fk < vals[-1]:
                pts[-1], vals[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def affine_scan(a: np.ndarray, b: np.ndarray, wide: int = 64) -> np.ndarray:
    """x[i] = a[i] x[i - 1] + b[i] from 0, in runs of `wide` side by side, whose ends are a scan again."""
    n = len(a)
    if n <= wide:
        x, out = 0.0, []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            x = p * x + q
            out.append(x)
        return np.array(out, float)
    runs = -(-n // wide)
    p, q = (np.pad(v, (0, runs * wide - n)).reshape(runs, wide).T.copy() for v in (a, b))
    for i in range(1, wide):
        q[i] += p[i] * q[i - 1]
        p[i] *= p[i - 1]
    before = np.concatenate([[0.0], affine_scan(p[-1], q[-1], wide)[:-1]])
    p *= before
    q += p
    return q.T.ravel()[:n]


def hawkes_loglik(t: np.ndarray, mu: float, alpha: float, beta: float) -> float:
    if not len(t):
        return 0.0
    decay = np.exp(-beta * np.diff(t, prepend=0.0))
    came = decay.copy()
    came[0] = 0.0  # nothing before the first
    r = affine_scan(decay, came)
    area = mu * t[-1] + alpha / beta * float(((1 - decay[1:]) * (1 + r[:-1])).sum())
    return float(np.log(np.maximum(mu + alpha * r, 1e-300)).sum()) - area


def hawkes_fit(t: np.ndarray) -> dict:
    """mu, alpha, beta on a log scale, no branching of 1 or more; null below 10 events."""
    if len(t) < 10 or t[-1] <= 0:
        return {"mu": None, "alpha": None, "beta": None, "branching": None, "half_life": None}

    def loss(p: np.ndarray) -> float:
        mu, alpha, beta = np.exp(np.clip(p, -20, 20))
        return 1e12 if alpha / beta >= 1 else -hawkes_loglik(t, mu, alpha, beta)

    rate = len(t) / t[-1]
    mu, alpha, beta = np.exp(nelder_mead(loss, np.log([rate / 2, rate / 2, rate])))
    return {"mu": float(mu), "alpha": float(alpha), "beta": float(beta), "branching": float(alpha / beta), "half_life": float(math.log(2) / beta)}


def multivariate_hawkes(streams: list[np.ndarray], decay: float = 1.0, rounds: int = 40) -> dict:
    """Base rates, branching matrix (from j to i) and its spectral radius, by expectation-maximisation at one decay."""
    k = len(streams)
    end = max((s[-1] for s in streams if len(s)), default=0.0)
    times = np.concatenate(streams) if k else np.zeros(0)
    kind = np.repeat(np.arange(k), [len(s) for s in streams])
    o = np.argsort(times, kind="stable")
    times, kind = times[o], kind[o]
    mu, a = np.array([max(len(s), 1) / max(end, 1e-9) / 2 for s in streams]), np.full((k, k), 0.3 / max(k, 1))
    counts = np.bincount(kind, minlength=k)
    kernel = np.zeros((len(times), k))
    state, last = np.zeros(k), 0.0
    for n, (t, c) in enumerate(zip(times.tolist(), kind.tolist(), strict=True)):
        state *= math.exp(-decay * (t - last))
        kernel[n], last = decay * state, t
        state[c] += 1
    mass = np.array([(1 - np.exp(-decay * (end - s))).sum() for s in streams])
    for _ in range(rounds):
        parts = kernel * a[kind]
        rate = mu[kind] + parts.sum(1)
        mu = np.array([(mu[i] / rate[kind == i]).sum() for i in range(k)]) / max(end, 1e-9)
        a = np.array([(parts[kind == i] / rate[kind == i][:, None]).sum(0) for i in range(k)]) / np.maximum(mass, 1e-9)
    return {"mu": mu, "branching": a, "radius": float(np.abs(np.linalg.eigvals(a)).max()) if k else 0.0, "counts": counts}


def eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues descending, vectors as columns, explained shares) of a covariance or correlation matrix."""
    v, e = np.linalg.eigh(c)
    v, e = v[::-1], e[:, ::-1]
    pos = np.clip(v, 0, None)
    return v, e, pos / pos.sum() if pos.sum() > 0 else pos


def correlation_of(cov: np.ndarray) -> np.ndarray:
    """The correlation matrix; a flat series has none, also with itself."""
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd > 0, sd, 1)
    return cov / np.outer(sd, sd)


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """eigen() of the sample covariance."""
    return eigen(np.cov(x, rowvar=False, ddof=1).reshape(x.shape[1], x.shape[1]))


def standardise(x: np.ndarray) -> np.ndarray:
    sd = x.std(0, ddof=1)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1)


def rie(values: np.ndarray, vectors: np.ndarray, q: float) -> np.ndarray:
    """Covariance with its bulk eigenvalues shrunk to their median level."""
    s2 = float(np.median(values))
    low, high = s2 * (1 - math.sqrt(q)) ** 2, s2 * (1 + math.sqrt(q)) ** 2
    alpha = float(np.clip(q, 0.05, 0.95))
    clean = np.where((values >= low) & (values <= high), (1 - alpha) * values + alpha * s2, values)
    return (vectors * clean) @ vectors.T


def rmt_of(corr: np.ndarray, t: int) -> dict:
    """Eigenvalues above the Marchenko-Pastur edge of a correlation matrix of t rows, the largest one, the share it explains."""
    n = len(corr)
    values, _, share = eigen(corr)
    edge = (1 + math.sqrt(n / t)) ** 2
    return {"n_above": int((values > edge).sum()), "top": float(values[0]), "edge": edge, "top_share": float(share[0]), "p": tracy_widom_p(float(values[0]), t, n)}


def rmt(x: np.ndarray) -> dict:
    """rmt_of() of a panel's correlations."""
    return rmt_of(correlation_of(np.cov(x, rowvar=False).reshape(x.shape[1], -1)), len(x))


# Tail of the Tracy-Widom law of order one
TW_POINTS = ((-3.9, 0.99), (-3.18, 0.95), (-2.78, 0.90), (-1.91, 0.70), (-1.27, 0.50), (-0.59, 0.30), (0.45, 0.10), (0.98, 0.05), (2.02, 0.01), (3.27, 0.001))


def tracy_widom_p(top: float, t: int, n: int) -> float:
    """P of a larger top eigenvalue of a white panel, Johnstone's scaling, linear between table points (decreasing in s)."""
    mu = (math.sqrt(t - 1) + math.sqrt(n)) ** 2
    sigma = (math.sqrt(t - 1) + math.sqrt(n)) * (1 / math.sqrt(t - 1) + 1 / math.sqrt(n)) ** (1 / 3)
    s = (top * t - mu) / sigma
    return float(np.interp(s, [a for a, _ in TW_POINTS], [b for _, b in TW_POINTS]))


def mfdfa(x: np.ndarray, qs: tuple[float, ...] = (-5, -3, -2, -1, 0, 1, 2, 3, 5), order: int = 1) -> dict:
    """Generalised Hurst exponents by q and the width of the singularity spectrum."""
    profile = np.cumsum(x - x.mean())
    scales = np.unique(np.geomspace(10, max(11, len(x) // 4), 10).astype(int))
    logs = []
    for s in scales.tolist():
        windows = np.concatenate([profile[: len(x) // s * s].reshape(-1, s), profile[len(x) - len(x) // s * s :].reshape(-1, s)])
        basis = np.vander(np.arange(s) / s, order + 1)
        fit = basis @ np.linalg.lstsq(basis, windows.T, rcond=None)[0]
        var = np.maximum(((windows.T - fit) ** 2).mean(0), 1e-300)
        logs.append([0.5 * np.log(var).mean() if q == 0 else np.log(np.mean(var ** (q / 2))) / q for q in qs])
    h = np.array([np.polyfit(np.log(scales), col, 1)[0] for col in np.array(logs).T])
    tau = np.array(qs) * h - 1
    alpha = np.gradient(tau, qs)
    return {"h2": float(h[list(qs).index(2)]), "width": float(alpha.max() - alpha.min())}


def alpha_stable(x: np.ndarray) -> dict:
    """alpha, beta, gamma, delta by regression on the characteristic function."""
    med = float(np.median(x))
    scale = float(np.median(np.abs(x - med))) or 1.0
    z = (x - med) / scale
    u = np.linspace(0.1, 1.0, 12)
    phi = np.exp(1j * np.outer(u, z)).mean(1)
    y = np.log(np.maximum(-np.log(np.maximum(np.abs(phi) ** 2, 1e-300)), 1e-300))
    slope, cut = np.polyfit(np.log(u), y, 1)
    alpha = float(np.clip(slope, 0.1, 2.0))
    gamma = float((math.exp(cut) / 2) ** (1 / alpha))
    angle = np.arctan2(phi.imag, phi.real)
    w = math.tan(math.pi * alpha / 2) if abs(alpha - 1) > 1e-6 else 0.0
    a = np.column_stack([u, (gamma * u) ** alpha * w])
    (delta, beta), *_ = np.linalg.lstsq(a, angle, rcond=None)
    return {"alpha": alpha, "beta": float(np.clip(beta, -1, 1)), "gamma": gamma * scale, "delta": med + float(delta) * scale}


def morlet(x: np.ndarray, scales: np.ndarray, w0: float = 6.0) -> np.ndarray:
    """Continuous wavelet transform, scales by time, FFT padded to a power of two."""
    n = 1 << (len(x) - 1).bit_length()
    f = np.fft.fft(x - x.mean(), n)
    w = 2 * np.pi * np.fft.fftfreq(n)
    return np.array([np.fft.ifft(f * np.pi**-0.25 * np.sqrt(2 * np.pi * s) * np.exp(-((s * w - w0) ** 2) / 2) * (w > 0))[: len(x)] for s in scales])


def coherence(x: np.ndarray, y: np.ndarray, scales: tuple[float, ...] = (4, 8, 16, 32)) -> list[dict]:
    a, b = morlet(x, np.array(scales)), morlet(y, np.array(scales))
    out = []
    for k, s in enumerate(scales):
        box = np.ones(max(round(s), 5)) / max(round(s), 5)
        smooth = lambda v: np.convolve(v, box, "same")
        cross = np.abs(smooth((a[k] * b[k].conj()).real) + 1j * smooth((a[k] * b[k].conj()).imag)) ** 2
        power = smooth(np.abs(a[k]) ** 2) * smooth(np.abs(b[k]) ** 2)
        out.append({"scale": float(s), "coherence": float(np.mean(cross / np.maximum(power, 1e-300)))})
    return out


def diffusion_map(x: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, coordinates) of the Gaussian kernel at the median squared distance."""
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    w = np.exp(-d / max(float(np.median(d[d > 0])) if (d > 0).any() else 1.0, 1e-12))
    s = 1 / np.sqrt(w.sum(1))
    v, e = np.linalg.eigh(s[:, None] * w * s)
    order = np.argsort(-v)[1 : k + 1]
    return v[order], e[:, order] * s[:, None] * v[order]


def spanning_tree(names: list[str], corr: np.ndarray) -> list[dict]:
    """Kruskal on sqrt(2 (1 - rho)), edges in order of (weight, i, j)."""
    n, root = len(names), list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    edges = sorted((math.sqrt(max(0.0, 2 * (1 - corr[i, j]))), i, j) for i in range(n) for j in range(i + 1, n))
    out = []
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append({"a": names[i], "b": names[j], "weight": w})
    return out


def clusters(tree: list[dict], cutoff: float) -> list[set[str]]:
    """Components of two or more after dropping edges of cutoff or longer."""
    sets: list[set[str]] = []
    for e in tree:
        if e["weight"] < cutoff:
            hit = [s for s in sets if e["a"] in s or e["b"] in s]
            sets = [s for s in sets if s not in hit] + [set().union({e["a"], e["b"]}, *hit)]
    return sets


def pc_skeleton(corr: np.ndarray, n: int, alpha: float = 0.05, depth: int = 2) -> tuple[np.ndarray, dict]:
    """(adjacency, separating sets) by Fisher z tests of partial correlations."""
    from itertools import combinations

    k = len(corr)
    adj, sep = ~np.eye(k, dtype=bool), {}
    for size in range(depth + 1):
        for i, j in combinations(range(k), 2):
            if not adj[i, j]:
                continue
            near = [v for v in range(k) if v not in (i, j) and (adj[i, v] or adj[j, v])]
            for s in combinations(near, size):
                p = np.linalg.pinv(corr[np.ix_([i, j, *s], [i, j, *s])])
                r = float(np.clip(-p[0, 1] / math.sqrt(max(p[0, 0] * p[1, 1], 1e-300)), -0.999999, 0.999999))
                z = math.sqrt(max(n - size - 3, 1)) * 0.5 * math.log((1 + r) / (1 - r))
                if math.erfc(abs(z) / math.sqrt(2)) > alpha:
                    adj[i, j] = adj[j, i] = False
                    sep[i, j] = set(s)
                    break
    return adj, sep


def orient(adj: np.ndarray, sep: dict) -> np.ndarray:
    """directed[i, j]: i -> j; colliders first, then chains and cycles ruled out until nothing changes."""
    k = len(adj)
    d = np.zeros((k, k), bool)
    und = adj.copy()

    def point(i: int, j: int) -> None:
        d[i, j], und[i, j], und[j, i] = True, False, False

    for m in range(k):
        for i in range(k):
            for j in range(i + 1, k):
                if adj[i, m] and adj[j, m] and not adj[i, j] and m not in sep.get((i, j), set()):
                    for s in (i, j):
                        if und[s, m]:
                            point(s, m)
    changed = True
    while changed:
        changed = False
        for i in range(k):
            for j in range(k):
                if not und[i, j]:
                    continue
                chain = any(d[h, i] and not adj[h, j] for h in range(k))
                cycle = any(d[i, h] and d[h, j] for h in range(k))
                fork = any(und[i, a] and und[i, b] and d[a, j] and d[b, j] and not adj[a, b] for a in range(k) for b in range(a))
                if chain or cycle or fork:
                    point(i, j)
                    changed = True
    return d


def persistence(x: np.ndarray) -> dict:
    """Deaths of components of a point cloud (its spanning tree's lengths) and their L1 and L2 norms."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, best, deaths = np.zeros(len(x), bool), np.full(len(x), np.inf), []
    at = 0
    for _ in range(len(x) - 1):
        inside[at] = True
        best = np.minimum(best, d[at])
        best[inside] = np.inf
        at = int(best.argmin())
        deaths.append(float(best[at]))
    deaths = np.array(deaths)
    return {"n": len(deaths), "l1": float(deaths.sum()), "l2": float(np.sqrt((deaths**2).sum())), "longest": float(deaths.max()) if len(deaths) else 0.0}


def echo_state(u: np.ndarray, y: np.ndarray, size: int = 50, radius: float = 0.9, leak: float = 0.3, ridge: float = 1e-4, burn: int = 20, seed: int = 7) -> dict:
    """Next-step fit of y by a fixed random reservoir driven by u, ridge readout: in-sample correlation and error."""
    rng = np.random.default_rng(seed)
    w_in, w = rng.uniform(-0.5, 0.5, size), rng.uniform(-0.5, 0.5, (size, size))
    w *= radius / max(np.abs(np.linalg.eigvals(w)).max(), 1e-12)
    s, states = np.zeros(size), []
    for v in u.tolist():
        s = (1 - leak) * s + leak * np.tanh(w_in * v + w @ s)
        states.append(s)
    x = np.column_stack([np.ones(len(u)), np.array(states)])[burn:-1]
    target = y[burn + 1 :]
    b = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ target)
    guess = x @ b
    return {"corr": _corr(guess, target), "mse": float(((guess - target) ** 2).mean())}


def sinkhorn(a: np.ndarray, b: np.ndarray, cost: np.ndarray, eps: float = 0.05, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(plan, cost) of entropic transport, in logs."""
    la, lb = np.log(np.maximum(a, 1e-12)), np.log(np.maximum(b, 1e-12))
    f, g, k = np.zeros(len(a)), np.zeros(len(b)), -cost / eps

    def soft(m: np.ndarray, axis: int) -> np.ndarray:
        top = m.max(axis, keepdims=True)
        return (top + np.log(np.exp(m - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        f = la - soft(k + g[None, :], 1)
        g = lb - soft(k + f[:, None], 0)
    plan = np.exp(k + f[:, None] + g[None, :])
    return plan, float((plan * cost).sum())


def monte_carlo(start: np.ndarray, moves: np.ndarray, means: np.ndarray, sds: np.ndarray, steps: int, paths: int, seed: int) -> np.ndarray:
    """Terminal values of paths that draw a state, then its return."""
    rng = np.random.default_rng(seed)
    state = rng.choice(len(start), paths, p=start)
    total = np.zeros(paths)
    edges = np.cumsum(moves, axis=1)
    for _ in range(steps):
        state = (rng.random(paths)[:, None] > edges[state]).sum(1).clip(0, len(start) - 1)
        total += rng.normal(means[state], sds[state])
    return np.exp(total)
