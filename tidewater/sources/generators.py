"""Synthetic universes, reproducible to the bit by a 64-bit xorshift generator.

One generator feeds a whole universe in order, so a universe is made by one
task; many universes (seeds) are made in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewater.schemas import BAR

MASK = (1 << 64) - 1


class XorShift:
    """xorshift64* with a Box-Muller cosine branch for normals."""

    def __init__(self, seed: int):
        self.state = seed & MASK or 0xDEADBEEF

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        self.state = x
        return x * 0x2545F4914F6CDD1D & MASK

    def uniform(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def normal(self) -> float:
        u, v = max(self.uniform(), 1e-300), self.uniform()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


@dataclass(frozen=True)
class Universe:
    symbols: int = 16
    bars: int = 1000
    span_secs: int = 60
    start_price: float = 100.0
    drift: float = 0.05
    volatility: float = 0.2
    seed: int = 42
    kind: str = "gbm"  # gbm, momentum or pair


def _rows(u: Universe, start: int) -> Iterator[tuple]:
    rng = XorShift(u.seed)
    dt = u.span_secs / (252 * 6.5 * 3600)
    root = math.sqrt(dt)
    names = ["LEFT", "RIGHT"] if u.kind == "pair" else [f"SYM{k:03d}" for k in range(u.symbols)]
    price = np.full(len(names), u.start_price)
    factor = common = spread = 0.0
    for b in range(u.bars):
        if u.kind == "momentum":
            factor = 0.999 * factor + 0.01 * rng.normal() * root
        if u.kind == "pair":
            common += u.volatility * root * rng.normal()
            spread += -5.0 * spread * dt + 0.02 * math.sqrt(2 * 5.0 * dt) * rng.normal()
        for k, name in enumerate(names):
            before = price[k]
            if u.kind == "pair":
                price[k] = u.start_price * math.exp(common + (spread if k == 0 else 0.0))
            else:
                if u.kind == "gbm":
                    mu = u.drift * (2 * k / max(1, len(names) - 1) - 1) if len(names) > 1 else u.drift
                    step = (mu - u.volatility**2 / 2) * dt
                else:
                    step = factor if k < len(names) / 2 else -factor
                price[k] = before * math.exp(step + u.volatility * root * rng.normal())
            pad = 0.25 * u.volatility * root
            yield start + (b + 1) * u.span_secs * 1_000_000_000, name, before, max(before, price[k]) * (1 + pad), min(before, price[k]) * (1 - pad), price[k], 1000.0, u.span_secs


def universes(spark: SparkSession, specs: list[Universe], start: int = 1_704_067_200_000_000_000) -> DataFrame:
    """Bars of each universe, with its number; one task a universe."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BAR.split(", ")]
        for frame in frames:
            for k in frame["universe"]:
                yield pd.DataFrame(list(_rows(specs[k], start)), columns=names).assign(universe=k)

    seeds = spark.range(len(specs)).withColumnRenamed("id", "universe").repartition(max(1, len(specs)), "universe")
    return seeds.mapInPandas(run, BAR + ", universe LONG")
