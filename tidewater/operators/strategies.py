"""Event strategies: stateful objects that turn bars into target positions.

A strategy sees bars one at a time (the same object drives a batch run and a
stream) and answers with target quantities; the simulator trades the
difference.  validate() rejects a bad configuration, reset() starts anew.
Counters count bar events of all symbols, as the strategies are specified.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np

from tidewater.operators import estimators as est


@dataclass
class Bar:
    ts_nanos: int
    symbol: str
    open: float
    high: float
    low: float
    close: float
    volume: float = 0.0
    span_secs: int = 60


@dataclass
class View:
    """What a strategy may know: net asset value, positions, last prices."""

    nav: float
    positions: dict[str, float]
    prices: dict[str, float]


class Strategy:
    def validate(self) -> None:
        """Raise ValueError for a configuration out of range."""

    def reset(self) -> None:
        self.__init__(**{k: getattr(self, k) for k in getattr(self, "settings", ())})

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        """Target quantity by symbol; symbols left out keep theirs."""
        return {}

    def on_session_close(self, view: View) -> dict[str, float]:
        return {}


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class Noop(Strategy):
    """Emits nothing; also stands for the three planned strategies that never trade."""


@dataclass
class CrossSectionalMomentum(Strategy):
    window: int = 20
    legs: int = 2
    leg_weight: float = 0.02
    max_hold: int = 60
    least: int = 4

    def __post_init__(self) -> None:
        self.closes: dict[str, deque] = defaultdict(lambda: deque(maxlen=self.window + 1))
        self.held: dict[str, int] = {}
        self.events = 0

    def reset(self) -> None:
        self.__post_init__()

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        self.events += 1
        self.closes[bar.symbol].append(bar.close)
        scores = {}
        for s, c in self.closes.items():
            if len(c) == self.window + 1 and min(c) > 0:
                r = np.diff(np.log(c))
                sd = r.std(ddof=1)
                if sd > 0:
                    scores[s] = float(r.sum() / sd)
        if len(scores) < self.least:
            return {}
        order = sorted(scores, key=lambda s: (-scores[s], s))
        want = {s: 0.0 for s, q in view.positions.items() if q}
        for side, group in ((1, order[: self.legs]), (-1, order[-self.legs :])):
            for s in group:
                price = view.prices.get(s, 0.0)
                if price > 0:
                    want[s] = side * max(1.0, math.floor(self.leg_weight * view.nav / price))
        for s in list(want):
            if want[s] and view.positions.get(s):
                self.held.setdefault(s, self.events)
                if self.events - self.held[s] >= self.max_hold:
                    want[s] = 0.0
            if not want[s]:
                self.held.pop(s, None)
        return want


def _pair_targets(side: int, beta: float, gross: float, view: View, y: str, x: str) -> dict[str, float]:
    py, px = view.prices.get(y, 0.0), view.prices.get(x, 0.0)
    if not side or py <= 0 or px <= 0:
        return {y: 0.0, x: 0.0}
    units = gross * view.nav / 2
    return {y: side * math.ceil(units / py), x: -side * math.ceil(units * abs(beta) / px)}


@dataclass
class PairsMeanReversion(Strategy):
    y: str = "LEFT"
    x: str = "RIGHT"
    history: int = 100
    alpha: float = 0.05
    entry: float = 2.0
    exit: float = 0.5
    gross: float = 0.2

    def __post_init__(self) -> None:
        self.seen: dict[str, list[float]] = {self.y: [], self.x: []}
        self.side, self.age, self.limit, self.beta = 0, 0, 0.0, 1.0

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(self.history >= 50 and 0 < self.alpha < 1 and self.entry > self.exit and 0 < self.gross < 1, "pairs_mean_reversion")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        if bar.symbol not in self.seen:
            return {}
        self.seen[bar.symbol].append(bar.close)
        a, b = self.seen[self.y], self.seen[self.x]
        if len(a) != len(b) or len(a) < self.history:
            return {}
        y, x = np.array(a[-self.history :]), np.array(b[-self.history :])
        coef, _, _ = est.ols(x[:, None], y)
        e = y - coef[0] - coef[1] * x
        sd = e.std(ddof=1)
        z = float(e[-1] / sd) if sd > 0 else 0.0
        if self.side:
            self.age += 1
            if abs(z) < self.exit or self.age > self.limit:
                self.side = 0
                return {self.y: 0.0, self.x: 0.0}
            return {}
        t = est.adf(e, 0)["t"]
        slope = np.polyfit(e[:-1], e[1:], 1)[0]
        half = math.log(2) / -math.log(slope) if 0 < slope < 1 else math.inf
        if t < -2.86 and 5 <= half <= 200 and abs(z) > self.entry:
            self.side, self.age, self.limit, self.beta = (-1 if z > 0 else 1), 0, 2 * half, float(coef[1])
            return _pair_targets(self.side, self.beta, self.gross, view, self.y, self.x)
        return {}


@dataclass
class KalmanPairs(Strategy):
    y: str = "LEFT"
    x: str = "RIGHT"
    q: float = 1e-5
    r: float = 1e-3
    entry: float = 1.5
    exit: float = 0.3
    warmup: int = 30
    gross: float = 0.2
    half_life: float = 30.0

    def __post_init__(self) -> None:
        self.last: dict[str, tuple[int, float]] = {}
        self.beta, self.p, self.n, self.side = None, 1.0, 0, 0
        self.mean, self.var = 0.0, 0.0

    def reset(self) -> None:
        mean, var = self.mean, self.var  # the innovation averages stay, as specified
        self.__post_init__()
        self.mean, self.var = mean, var

    def validate(self) -> None:
        _need(self.q > 0 and self.r > 0 and self.entry > self.exit and self.warmup >= 20, "kalman_pairs")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        if bar.symbol not in (self.x, self.y) or bar.close <= 0:
            return {}
        self.last[bar.symbol] = (bar.ts_nanos, math.log(bar.close))
        if self.x not in self.last or self.y not in self.last or self.last[self.x][0] != self.last[self.y][0]:
            return {}
        x, y = self.last[self.x][1], self.last[self.y][1]
        if self.beta is None:
            self.beta = y / x if x else 1.0
            return {}
        self.p += self.q
        e, s = y - self.beta * x, x * x * self.p + self.r
        k = self.p * x / s
        self.beta, self.p = self.beta + k * e, (1 - k * x) * self.p
        a = 1 - 2 ** (-1 / self.half_life)
        d = e - self.mean
        self.mean += a * d
        self.var = (1 - a) * (self.var + a * d * d)
        self.n += 1
        if self.n < self.warmup or self.var <= 0:
            return {}
        z = (e - self.mean) / math.sqrt(self.var)
        if self.side and abs(z) < self.exit:
            self.side = 0
            return {self.y: 0.0, self.x: 0.0}
        if not self.side and abs(z) > self.entry:
            self.side = -1 if z > 0 else 1
            return _pair_targets(self.side, self.beta, self.gross, view, self.y, self.x)
        return {}


@dataclass
class GarchVolTarget(Strategy):
    vol_target: float = 0.1
    bars_per_year: float = 98280.0
    half_life: float = 20.0
    max_position: float = 0.05
    omega: float = 1e-8
    alpha: float = 0.05
    beta: float = 0.9

    def __post_init__(self) -> None:
        self.state: dict[str, list[float]] = {}

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(0 < self.vol_target <= 0.5 and self.bars_per_year > 0 and self.half_life > 0 and 0 < self.max_position <= 1, "garch_vol_target")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        s = self.state.setdefault(bar.symbol, [bar.close, self.omega / (1 - self.alpha - self.beta), 0.0, 0.0])
        if s[0] <= 0 or bar.close <= 0:
            return {}
        r = math.log(bar.close / s[0])
        a = 1 - 2 ** (-1 / self.half_life)
        s[1] = self.omega + self.alpha * (s[3] or r) ** 2 + self.beta * s[1]
        s[2] += a * (r - s[2])
        s[0], s[3] = bar.close, r
        annual = math.sqrt(max(s[1], 0) * self.bars_per_year)
        if annual <= 0 or s[2] == 0:
            return {}
        weight = min(self.vol_target / annual, self.max_position) * (1 if s[2] > 0 else -1)
        return {bar.symbol: float(round(weight * view.nav / bar.close))}


@dataclass
class RegimeHmm(Strategy):
    proxy: str = ""
    calm_probability: float = 0.70
    legs: int = 2
    leg_weight: float = 0.02
    window: int = 20

    def __post_init__(self) -> None:
        self.book = CrossSectionalMomentum(self.window, self.legs, self.leg_weight)
        self.last, self.p = None, np.array([0.5, 0.5])

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(0.5 <= self.calm_probability <= 1 and self.legs >= 1, "regime_hmm")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        proxy = self.proxy or min(view.prices)
        if bar.symbol == proxy:
            if self.last and self.last > 0 and bar.close > 0:
                r = math.log(bar.close / self.last)
                prior = self.p @ np.array([[0.97, 0.03], [0.05, 0.95]])
                like = np.array([math.exp(-r * r / (2 * v)) / math.sqrt(2 * math.pi * v) for v in (1e-6, 1e-5)])
                self.p = prior * like / max(float((prior * like).sum()), 1e-300)
            self.last = bar.close
            return {}
        want = self.book.on_bar(bar, view)
        if self.p[0] < self.calm_probability:
            return {s: 0.0 for s, q in view.positions.items() if q}
        return want


@dataclass
class MarkovRouter(Strategy):
    proxy: str = ""
    confidence: float = 0.55
    legs: int = 2
    bull_gross: float = 0.08

    def __post_init__(self) -> None:
        self.book = CrossSectionalMomentum(20, self.legs, self.bull_gross / (2 * self.legs))
        self.last, self.p = None, np.full(3, 1 / 3)

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(0.5 <= self.confidence <= 1 and self.legs >= 1 and 0 < self.bull_gross < 0.5, "markov_router")

    def regime(self) -> str:
        return ("Bull", "Sideways", "Bear")[int(self.p.argmax())]

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        proxy = self.proxy or min(view.prices)
        if bar.symbol == proxy:
            if self.last and self.last > 0 and bar.close > 0:
                r = math.log(bar.close / self.last)
                moves = np.array([[0.96, 0.03, 0.01], [0.03, 0.94, 0.03], [0.01, 0.04, 0.95]])
                prior = self.p @ moves
                like = np.array([math.exp(-((r - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for m, v in ((5e-5, 2e-6), (0.0, 1e-6), (-1e-4, 1e-5))])
                self.p = prior * like / max(float((prior * like).sum()), 1e-300)
            self.last = bar.close
            return {}
        want = self.book.on_bar(bar, view)
        if self.p.max() < self.confidence:
            return {}
        if self.regime() == "Bear":
            return {s: 0.0 for s, q in view.positions.items() if q}
        return want if self.regime() == "Bull" else {s: -q for s, q in want.items()}


@dataclass
class HurstRegime(Strategy):
    window: int = 64
    trend: float = 0.55
    revert: float = 0.45
    weight: float = 0.02

    def __post_init__(self) -> None:
        self.closes: dict[str, deque] = defaultdict(lambda: deque(maxlen=self.window + 1))

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(self.window >= 32 and self.revert < self.trend and 0 < self.trend < 1, "hurst_regime")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        c = self.closes[bar.symbol]
        c.append(bar.close)
        if len(c) <= self.window or min(c) <= 0:
            return {}
        r = np.diff(np.log(c))
        h = est.hurst(r)["hurst"]
        if h is None or self.revert <= h <= self.trend:
            return {bar.symbol: 0.0}
        side = np.sign(r.sum()) * (1 if h > self.trend else -1)
        return {bar.symbol: float(side * round(self.weight * view.nav / bar.close))}


@dataclass
class LeadLagPairs(Strategy):
    leader: str = "LEFT"
    follower: str = "RIGHT"
    window: int = 100
    most: int = 5
    min_corr: float = 0.3
    hold: int = 10
    weight: float = 0.02

    def __post_init__(self) -> None:
        self.closes = {self.leader: deque(maxlen=self.window + 1), self.follower: deque(maxlen=self.window + 1)}
        self.age = 0

    def reset(self) -> None:
        self.__post_init__()

    def validate(self) -> None:
        _need(self.window >= 60 and self.leader != self.follower and 0 < self.min_corr <= 1, "leadlag_pairs")

    def on_bar(self, bar: Bar, view: View) -> dict[str, float]:
        if bar.symbol not in self.closes or bar.close <= 0:
            return {}
        self.closes[bar.symbol].append(math.log(bar.close))
        if bar.symbol != self.follower:
            return {}
        if view.positions.get(self.follower):
            self.age += 1
            if self.age >= self.hold:
                self.age = 0
                return {self.follower: 0.0}
            return {}
        x, y = (np.diff(self.closes[s]) for s in (self.leader, self.follower))
        n = min(len(x), len(y))
        if n < self.window - 1:
            return {}
        x, y = x[-n:] - x[-n:].mean(), y[-n:] - y[-n:].mean()
        scale = math.sqrt(float(x @ x) * float(y @ y))
        rho = [float(x[: n - k] @ y[k:]) / scale if scale > 0 else 0.0 for k in range(self.most + 1)]
        k = int(np.argmax(np.abs(rho)))
        if k > 0 and abs(rho[k]) >= self.min_corr:
            side = np.sign(rho[k] * x[-k:].sum())
            return {self.follower: float(side * round(self.weight * view.nav / bar.close))}
        return {}


@dataclass
class Simulator:
    """One run: bars in, equity out; costs, checks and the loss ladder applied to every order."""

    strategy: Strategy
    cash: float = 100_000.0
    half_spread: float = 0.01
    adv: float = 1_000_000.0
    order_cap: float = 25_000.0
    name_cap: float = 0.05
    adv_cap: float = 0.01
    cushion: float = 0.95
    positions: dict[str, float] = field(default_factory=dict)
    prices: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.start, self.level, self.fills, self.rejected, self.crashes = self.cash, 0, 0, 0, 0

    def nav(self) -> float:
        return self.cash + sum(q * self.prices.get(s, 0.0) for s, q in self.positions.items())

    def _fill(self, symbol: str, qty: float) -> None:
        mid, side = self.prices[symbol], 1 if qty > 0 else -1
        price = max(mid + side * (self.half_spread + 0.1 * math.sqrt(abs(qty) / self.adv) * mid), 0.0)
        fee = 0.0 if side > 0 else abs(qty) * (price * 0.0000278 + 0.000166)
        self.cash -= qty * price + fee
        self.positions[symbol] = self.positions.get(symbol, 0.0) + qty
        self.fills += 1

    def _allowed(self, symbol: str, qty: float, nav: float) -> bool:
        price = self.prices.get(symbol, 0.0)
        notional = abs(qty) * price
        power = max(self.cash, 0.0)
        return price > 0 and math.isfinite(price) and notional <= self.order_cap and not (nav > 0 and notional > self.name_cap * nav) and not (power > 0 and notional > power * self.cushion) and abs(qty) <= self.adv_cap * self.adv

    def on_bar(self, bar: Bar) -> float:
        self.prices[bar.symbol] = bar.close
        nav = self.nav()
        view = View(nav, dict(self.positions), dict(self.prices))
        try:
            want = self.strategy.on_bar(bar, view)
        except Exception:  # a strategy's fault ends its bar, not the run
            self.crashes += 1
            want = {}
        loss = (self.start - nav) / self.start
        if self.level != 7:
            for level, limit in ((7, 0.12), (6, 0.08), (5, 0.05), (4, 0.035), (3, 0.02), (2, 0.01)):
                if loss >= limit:
                    self.level = max(self.level, level)
                    break
        if self.level in (4, 7):
            for s, q in list(self.positions.items()):
                if q and self.prices.get(s, 0) > 0:
                    self._fill(s, -q)
            return self.nav()
        for s, target in want.items():
            held = self.positions.get(s, 0.0)
            delta = target - held
            if abs(delta) < 1:
                continue
            reducing = held * delta < 0 and abs(delta) <= abs(held)
            if (self.level >= 3 and not reducing) or not self._allowed(s, delta, nav):
                self.rejected += 1
                continue
            self._fill(s, delta)
        return self.nav()


STRATEGIES = {
    "noop": Noop,
    "xs_momentum": CrossSectionalMomentum,
    "pairs_mean_reversion": PairsMeanReversion,
    "kalman_pairs": KalmanPairs,
    "garch_vol_target": GarchVolTarget,
    "regime_hmm": RegimeHmm,
    "markov_router": MarkovRouter,
    "hurst_regime": HurstRegime,
    "leadlag_pairs": LeadLagPairs,
    "overnight_drift": Noop,
    "last30min_momentum": Noop,
    "pead": Noop,
}
