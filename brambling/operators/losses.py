"""Expected own losses by seeded simulation.

The random numbers come from a hash of (seed, exposure, scenario, draw, year): the result depends on neither partitioning
nor order. The frequency is a Bernoulli draw; a loss is lognormal, Pareto or uniform; what exceeds the limit and the
deductible stay with the policy holder. ``uniform`` and ``draw`` are the same as columns, for single draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a scenario library may have.
SCENARIOS = 1_000


def uniform(seed: int, *keys: Column) -> Column:
    """Between 0 and 1, both excluded."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def draw(kind: Column, mu: Column, sigma: Column, alpha: Column, low: Column, high: Column, u: Column, v: Column) -> Column:
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return F.when(kind == "lognormal", F.exp(mu + sigma * normal)).when(kind == "pareto", low / F.pow(u, 1 / alpha)).otherwise(low + (high - low) * u)


def expected_mean(kind: Column, mu: Column, sigma: Column, alpha: Column, low: Column, high: Column) -> Column:
    """The closed form that simulations must approach."""
    from brambling.functions.numbers import lognormal_mean, pareto_mean

    return F.when(kind == "lognormal", lognormal_mean(mu, sigma)).when(kind == "pareto", pareto_mean(low, alpha)).otherwise((low + high) / 2)


def simulate(exposures: DataFrame, scenarios: DataFrame, key: str, sims: int = 10_000, seed: int = 42) -> DataFrame:
    """Per exposure mean own loss, its standard error and percentiles over the simulated years.

    exposures: key, limit, deductible (one row per key). scenarios (at most SCENARIOS rows, a library of parameters): code,
    frequency, kind, mu, sigma, alpha, low, high. All years of an exposure are drawn in its own task, in numpy, as arrays
    of ``sims`` numbers; nothing is shuffled.
    """
    library = scenarios.orderBy("code").limit(SCENARIOS + 1).collect()
    if len(library) > SCENARIOS:
        raise ValueError(f"more than {SCENARIOS} scenarios")
    names = ("mean", "error", "p50", "p95", "p99")
    rows = exposures.select(F.col(key), F.col("limit").cast("double"), F.col("deductible").cast("double"), *[F.xxhash64(F.lit(seed), F.col(key), F.lit(s.code)).alias(f"_s{i}") for i, s in enumerate(library)])
    years = np.arange(sims, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def drawn(start: np.uint64, draw: int, at: np.ndarray) -> np.ndarray:
        """52 bits: a hash of exposure, scenario, draw and year."""
        x = (start + np.uint64(draw * 0xD1B54A32D192ED03 & (1 << 64) - 1)) ^ at
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        x >>= np.uint64(12)
        return x

    def share(start: np.uint64, draw: int, at: np.ndarray) -> np.ndarray:
        """Between 0 and 1, both excluded."""
        return drawn(start, draw, at).astype(np.float64) / (1 << 52) + 0.5 / (1 << 52)

    # Years with a draw below it have the scenario: the whole numbers whose share is less than its frequency.
    below = [np.uint64(min(1 << 52, max(0, math.ceil(Fraction(min(1.0, s.frequency) if s.frequency > 0 else 0.0) * (1 << 52) - Fraction(1, 2))))) for s in library]

    def losses_of(s, start: np.uint64, at: np.ndarray) -> np.ndarray:
        u = share(start, 1, at)
        if s.kind == "lognormal":
            return np.exp(s.mu + s.sigma * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * share(start, 2, at)))
        return s.low / u ** (1 / s.alpha) if s.kind == "pareto" else s.low + (s.high - s.low) * u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = np.array([np.inf if x is None else x for x in batch.column(1).to_pylist()])
            deductible = np.array([0.0 if x is None else x for x in batch.column(2).to_pylist()])
            starts = [batch.column(3 + i).to_numpy().view(np.uint64) for i in range(len(library))]
            out = np.zeros((batch.num_rows, len(names)))
            for r in range(batch.num_rows):
                own = np.zeros(sims)
                for s, start, least in zip(library, starts, below):
                    hit = np.nonzero(drawn(start[r], 0, years) < least)[0]
                    loss = losses_of(s, start[r], years[hit])
                    own[hit] += loss - np.minimum(np.maximum(loss - deductible[r], 0), limit[r])
                out[r] = own.mean(), own.std(ddof=1) / np.sqrt(sims) if sims > 1 else 0.0, *np.percentile(own, (50, 95, 99))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in out.T]], names=[key, *names])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def quality_factor(parts: Column, network: Column, valuation: Column) -> Column:
    """Product of factors for parts, repair network and valuation terms."""
    a = F.when(parts == "original", 1.0).when(parts == "equivalent", 0.9).otherwise(0.8)
    b = F.when(network == "any", 1.0).when(network == "contracted", 0.9).otherwise(0.85)
    return a * b * F.when(valuation == "concrete", 1.0).otherwise(0.9)
