"""Random numbers as column functions of a key and a seed: the same row always draws the same, on any executor and at any retry."""

from __future__ import annotations

from math import ceil, exp, log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Below `high`, from `low` on."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return F.lit(low) + bits / float(1 << 53) * (high - low)


def _positive(key: Column, seed: int) -> Column:
    return 1 - uniform(key, seed)


def integer(key: Column, seed: int, low: int, high: int) -> Column:
    """From `low` to below `high`."""
    return F.floor(uniform(key, seed, low, high)).cast("long")


def normal(key: Column, seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.lit(mean) + deviation * F.sqrt(-2 * F.log(_positive(key, seed))) * F.cos(2 * pi * uniform(key, seed + 1))


def log_normal(key: Column, seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.exp(normal(key, seed, mean, deviation))


def irwin_hall(key: Column, seed: int, n: int) -> Column:
    """Sum of n uniform numbers."""
    out = F.lit(0.0)
    for k in range(n):
        out = out + uniform(key, seed + k)
    return out


def bates(key: Column, seed: int, n: int) -> Column:
    """Mean of n uniform numbers."""
    return irwin_hall(key, seed, n) / n


def exponential(key: Column, seed: int, rate: float) -> Column:
    return -F.log(_positive(key, seed)) / rate


def pareto(key: Column, seed: int, alpha: float) -> Column:
    return F.pow(_positive(key, seed), F.lit(-1 / alpha))


def bernoulli(key: Column, seed: int, p: float) -> Column:
    return (uniform(key, seed) < p).cast("int")


def geometric(key: Column, seed: int, p: float) -> Column:
    """Trials up to the first success."""
    return F.greatest(F.lit(1), F.ceil(F.log(_positive(key, seed)) / F.log1p(F.lit(-p)))).cast("long")


def binomial(key: Column, seed: int, n: int, p: float) -> Column:
    """Successes of n trials, each drawn."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, k: a + F.when(F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), k), 11) < p * (1 << 53), 1).otherwise(0))


def weibull(key: Column, seed: int, shape: float) -> Column:
    return F.pow(exponential(key, seed, 1.0), F.lit(1 / shape))


def cauchy(key: Column, seed: int, middle: float = 0.0, scale: float = 1.0) -> Column:
    return F.lit(middle) + scale * F.tan(pi * (uniform(key, seed) - 0.5))


def logistic(key: Column, seed: int, middle: float = 0.0, scale: float = 1.0) -> Column:
    u = F.greatest(uniform(key, seed), F.lit(2.0**-54))
    return F.lit(middle) + scale * F.log(u / (1 - u))


def poisson(key: Column, seed: int, mean: float) -> Column:
    """Number of events of a Poisson process, by inversion: how many cumulative probabilities lie at or below one uniform number; for large means by rejection."""
    if mean > LARGE:
        return _poisson_large(key, seed, mean)
    u = uniform(key, seed)
    bound = ceil(mean + 12 * sqrt(mean) + 30)
    odds = exp(-mean)
    steps, below = [], 0.0
    for k in range(bound):
        below += odds
        steps.append(below)
        odds *= mean / (k + 1)
    # The last steps are 1 as doubles, or no draw passes them.
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, p: n + F.when(u >= p, 1).otherwise(0))


#: Means from which the least probabilities are too small for inversion.
LARGE = 500


def _poisson_large(key: Column, seed: int, mean: float) -> Column:
    """By transformed rejection with a hat over the ratio of two uniform numbers (Hoermann, 1993); log factorials by Stirling's series."""
    b = 0.931 + 2.53 * sqrt(mean)
    a, most, scale = -0.059 + 0.02483 * b, 0.9277 - 3.6224 / (b - 2), 1.1239 + 1.1328 / (b - 3.4)
    own = lambda k, n: (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), k, F.lit(n)), 11) + 0.5) / float(1 << 53)

    def tried(was: Column, k: Column) -> Column:
        u, v = own(k, 0) - 0.5, own(k, 1)
        side = 0.5 - F.abs(u)
        n = F.floor((2 * a / side + b) * u + mean + 0.43).cast("double")
        x = n + 1
        factorial = (x - 0.5) * F.log(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
        inside = F.log(v) + log(scale) - F.log(a / (side * side) + b) <= n * log(mean) - mean - factorial
        taken = (side >= 0.07) & (v <= most) | (n >= 0) & ~((side < 0.013) & (v > side)) & inside
        return F.when(was.isNotNull(), was).when(taken, n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), tried).cast("long")


#: Tries of a gamma draw. One fails in less than one of 20 cases, so all of them in less than one of 1e41.
TRIES = 32


def gamma(key: Column, seed: int, shape: float, scale: float = 1.0) -> Column:
    """By acceptance of a cubed normal number (Marsaglia and Tsang, 2000); below a shape of 1 that of shape + 1 times a power."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    own = lambda k, n: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), k, F.lit(n)), 11) / float(1 << 53)

    def tried(was: Column, k: Column) -> Column:
        z = F.sqrt(-2 * F.log(1 - own(k, 0))) * F.cos(2 * pi * own(k, 1))
        v = F.pow(1 + z / sqrt(9 * d), F.lit(3.0))
        taken = (v > 0) & (F.log(1 - own(k, 2)) < z * z / 2 + d - d * v + d * F.log(v))
        return F.when(was.isNotNull(), was).when(taken, d * v)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), tried) * scale
    return out if shape >= 1 else out * F.pow(_positive(key, seed + 1), F.lit(1 / shape))


def beta(key: Column, seed: int, a: float, b: float) -> Column:
    """Share of one gamma number in the sum of two."""
    x, y = gamma(key, seed, a), gamma(key, seed + 2, b)
    return x / (x + y)
