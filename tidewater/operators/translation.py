"""From statistics to signals: portfolio lift, tail flags, horizon screens, symbolic regression, transport of weights."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import safe, safe_divide, safe_log, safe_tanh
from tidewater.functions.special import normal_two_sided
from tidewater.operators import estimators as est
from tidewater.operators.dependence import PAIR, cell_entropy, quantile_bins


def rie_lift(c: np.ndarray, t: int) -> dict:
    """Volatility of minimum-variance weights from a sample covariance of t rows and from the shrunk one; fires above 0.5 % less."""
    sd = np.maximum(np.sqrt(np.diag(c)), 1e-12)
    v, e, _ = est.eigen(est.correlation_of(c))
    shrunk = est.rie(v, e, len(c) / t) * np.outer(sd, sd)

    def vol(m: np.ndarray) -> float:
        w = np.linalg.pinv(m) @ np.ones(len(m))
        w = w / max(np.abs(w).sum(), 1e-12)
        return math.sqrt(max(float(w @ c @ w), 0.0))

    plain, clean = vol(c), vol(shrunk)
    lift = 1 - clean / plain if plain > 0 else 0.0
    return {"sample_vol": plain, "rie_vol": clean, "lift": lift, "fires": lift > 0.005}


def var_gap(x: np.ndarray, name: str, level: float = 0.01, draws: int = 20_000) -> dict:
    """Gaussian and stable value at risk; the draws are seeded by the name's crc32, so they repeat."""
    fit = est.alpha_stable(x)
    rng = np.random.default_rng(zlib.crc32(name.encode()))
    a, b = fit["alpha"], fit["beta"]
    u, w = rng.uniform(-math.pi / 2, math.pi / 2, draws), rng.exponential(1.0, draws)
    if abs(a - 1) < 1e-6:
        z = 2 / math.pi * ((math.pi / 2 + b * u) * np.tan(u) - b * np.log(math.pi / 2 * w * np.cos(u) / (math.pi / 2 + b * u)))
    else:
        k = math.atan(b * math.tan(math.pi * a / 2)) / a
        z = (1 + (b * math.tan(math.pi * a / 2)) ** 2) ** (1 / (2 * a)) * np.sin(a * (u + k)) / np.cos(u) ** (1 / a) * (np.cos(u - a * (u + k)) / w) ** ((1 - a) / a)
    stable = -float(np.quantile(fit["delta"] + fit["gamma"] * z, level))
    gauss = -(float(x.mean()) - 2.3263478740408408 * float(x.std(ddof=1)))
    return {"gaussian": gauss, "stable": stable, "under": stable / gauss - 1 if gauss > 0 else 0.0}


def panic_pairs(tails: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pairs whose upper or lower tail dependence reaches the limit, strongest first."""
    return tails.filter((F.col("upper") >= limit) | (F.col("lower") >= limit)).orderBy(F.desc(F.greatest("upper", "lower")), *PAIR)


def cascade_risk(width: Column) -> Column:
    return F.coalesce(width > 0.5, F.lit(False))


def criticality(branching: Column) -> Column:
    """Position multiplier by the largest branching ratio."""
    return F.when(branching >= 0.95, 0.25).when(branching >= 0.9, 0.5).when(branching >= 0.85, 0.75).otherwise(1.0)


def horizon_entropy(pairs: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), bins: int = 3) -> DataFrame:
    """a, b, h, te: transfer entropy from x to y h rows ahead, one history row, for each horizon (more: dependence.history_entropy)."""
    o = Window.partitionBy(*PAIR).orderBy("ts_nanos")
    p = quantile_bins(pairs, bins).withColumns({f"n{h}": F.lead("qy", h).over(o) for h in horizons})
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"n{h}").alias("next")) for h in horizons)))
    tall = p.select(*PAIR, F.col("qx").alias("x"), F.col("qy").alias("y"), each.alias("z")).select(*PAIR, "x", "y", "z.h", "z.next").filter("next IS NOT NULL")
    return cell_entropy(tall, [*PAIR, "h"])


def edge_screen(pairs: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), least: int = 30) -> DataFrame:
    """a, b, best_h, score, decays: hit rate of x's sign for y h rows ahead; score = hit - 0.05 log10 p."""
    o = Window.partitionBy(*PAIR).orderBy("ts_nanos")
    p = pairs.withColumns({f"y{h}": F.lead("y", h).over(o) for h in horizons})
    tall = p.select(*PAIR, "x", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"y{h}").alias("y")) for h in horizons))).alias("z")).select(*PAIR, "x", "z.h", "z.y").filter("x <> 0 AND y <> 0")
    n = F.count(F.lit(1))
    same = F.count_if(F.signum("x") == F.signum("y"))
    g = tall.groupBy(*PAIR, "h").agg(F.when(n >= least, same / n).otherwise(0.5).alias("hit"), F.when(n >= least, (same / n - 0.5) / F.sqrt(0.25 / n)).otherwise(F.lit(0.0)).alias("z"))
    g = g.withColumn("p", normal_two_sided(F.col("z"))).withColumn("score", F.col("hit") - 0.05 * F.log10(F.greatest("p", F.lit(1e-300))))
    falls = F.coalesce(F.col("hit") <= F.lag("hit").over(Window.partitionBy(*PAIR).orderBy("h")), F.lit(True))
    return g.withColumn("falls", falls).groupBy(*PAIR).agg(F.max_by("h", F.struct("score", -F.col("h"))).alias("best_h"), F.max("score").alias("score"), F.min("falls").alias("decays"))


def cross_map_convergence(x: np.ndarray, y: np.ndarray, dims: tuple[int, ...] = (2, 3, 4)) -> list[dict]:
    """Skill by embedding dimension and its correlation with the library's size."""
    out = []
    for e in dims:
        sizes = np.unique(np.linspace(20, max(21, len(y) * 2 // 3), 5).astype(int))
        rho = [est.ccm(x, y, e, library=int(s))["rho"] for s in sizes]
        out.append({"dim": e, "rho": float(rho[-1]), "convergence": est._corr(sizes.astype(float), np.array(rho)) if len(sizes) > 1 else 0.0})
    return out


@dataclass(frozen=True)
class Node:
    """Expression tree: an operator with children, a variable, or a constant."""

    kind: str
    value: str | float = 0.0
    children: tuple[Node, ...] = ()

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)

    def __str__(self) -> str:
        if self.kind == "op":
            return f"{self.value}({', '.join(map(str, self.children))})"
        return str(self.value) if self.kind == "var" else f"{self.value:.4g}"

    def column(self) -> Column:
        """The expression on a DataFrame's columns, with the same safe arithmetic."""
        if self.kind == "var":
            return F.col(self.value)
        if self.kind == "const":
            return F.lit(float(self.value))
        a = [c.column() for c in self.children]
        return {
            "add": lambda: safe(a[0] + a[1]), "sub": lambda: safe(a[0] - a[1]), "mul": lambda: safe(a[0] * a[1]), "div": lambda: safe_divide(a[0], a[1]), "min": lambda: F.least(a[0], a[1]), "max": lambda: F.greatest(a[0], a[1]),
            "neg": lambda: -a[0], "abs": lambda: F.abs(a[0]), "log": lambda: safe_log(a[0]), "tanh": lambda: safe_tanh(a[0]),
        }[self.value]()

    def evaluate(self, data: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(data.values())))
        if self.kind == "var":
            return data[self.value]
        if self.kind == "const":
            return np.full(n, float(self.value))
        a = [c.evaluate(data) for c in self.children]
        clip = lambda v: np.clip(np.nan_to_num(v), -1e6, 1e6)
        with np.errstate(all="ignore"):
            return {
                "add": lambda: clip(a[0] + a[1]), "sub": lambda: clip(a[0] - a[1]), "mul": lambda: clip(a[0] * a[1]), "div": lambda: clip(np.where(np.abs(a[1]) < 1e-12, 0.0, a[0] / np.where(np.abs(a[1]) < 1e-12, 1.0, a[1]))), "min": lambda: np.minimum(*a), "max": lambda: np.maximum(*a),
                "neg": lambda: -a[0], "abs": lambda: np.abs(a[0]), "log": lambda: clip(np.where(np.abs(a[0]) > 1e-12, np.log(np.maximum(np.abs(a[0]), 1e-300)), 0.0)), "tanh": lambda: np.tanh(np.clip(a[0], -50, 50)),
            }[self.value]()


BINARY, UNARY = ("add", "sub", "mul", "div", "min", "max"), ("neg", "abs", "log", "tanh")


def symbolic_regression(data: dict[str, np.ndarray], target: np.ndarray, population: int = 60, generations: int = 12, depth: int = 4, penalty: float = 0.005, seed: int = 42) -> tuple[Node, float]:
    """The expression whose ranks follow the target's most, less a depth penalty; tournaments of three, the best survives."""
    rng, names = np.random.default_rng(seed), sorted(data)
    ranks = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable").astype(float)
    want = ranks(target)

    def grow(left: int) -> Node:
        if left <= 1 or rng.random() < 0.25:
            return Node("var", names[rng.integers(len(names))]) if rng.random() < 0.7 else Node("const", float(rng.uniform(-2, 2)))
        if rng.random() < 0.75:
            return Node("op", BINARY[rng.integers(len(BINARY))], (grow(left - 1), grow(left - 1)))
        return Node("op", UNARY[rng.integers(len(UNARY))], (grow(left - 1),))

    def fitness(t: Node) -> float:
        return abs(est._corr(ranks(t.evaluate(data)), want)) - penalty * t.depth()

    def swap(t: Node, new: Node, left: int) -> Node:
        if not t.children or left <= 1 or rng.random() < 0.3:
            return new
        k = int(rng.integers(len(t.children)))
        return Node(t.kind, t.value, tuple(swap(c, new, left - 1) if i == k else c for i, c in enumerate(t.children)))

    def pick(t: Node) -> Node:
        while t.children and rng.random() < 0.6:
            t = t.children[int(rng.integers(len(t.children)))]
        return t

    pool = [grow(depth) for _ in range(population)]
    scores = [fitness(t) for t in pool]
    for _ in range(generations):
        best = int(np.argmax(scores))
        new = [pool[best]]
        while len(new) < population:
            a, b = (pool[max(rng.integers(0, population, 3).tolist(), key=lambda i: scores[i])] for _ in range(2))
            child = swap(a, pick(b) if rng.random() < 0.7 else grow(2), depth)
            new.append(child if child.depth() <= depth + 2 else a)
        pool, scores = new, [fitness(t) for t in new]
    best = int(np.argmax(scores))
    return pool[best], float(scores[best])


def barycentre(members: np.ndarray, weights: np.ndarray, cost: np.ndarray, eps: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Entropic barycentre of histograms (rows of members)."""
    k = np.exp(-cost / eps)
    u = np.ones_like(members, dtype=float)
    out = np.full(members.shape[1], 1 / members.shape[1])
    for _ in range(rounds):
        v = [np.maximum(m, 1e-12) / np.maximum(k @ x, 1e-300) for m, x in zip(members, u, strict=True)]
        back = np.array([k.T @ x for x in v])
        out = np.exp((weights[:, None] * np.log(np.maximum(back, 1e-300))).sum(0))
        u = out / np.maximum(back, 1e-300)
    return out / out.sum()


def rebalance(now: np.ndarray, then: np.ndarray, cost: np.ndarray) -> list[dict]:
    """Moves of weight from i to j of the cheapest entropic plan, without what stays."""
    plan, _ = est.sinkhorn(now / now.sum(), then / then.sum(), cost)
    return [{"from": i, "to": j, "weight": float(plan[i, j])} for i in range(len(now)) for j in range(len(then)) if i != j and plan[i, j] > 1e-6]


def regime_blend(books: np.ndarray, probabilities: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights between the books of the regimes, by their probabilities: the barycentre of long-only books."""
    p = np.maximum(probabilities, 0)
    return barycentre(np.maximum(books, 0) / np.maximum(books, 0).sum(1, keepdims=True), p / p.sum(), cost)
