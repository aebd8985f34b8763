"""Counter-based random numbers: a draw is a function of its key, so any engine and any retry gives the same.

A key's MD5 gives two uniforms of 52 bits. Distributions are inverted at a uniform, by columns alone: the normal one by a
rational approximation (relative error about 1e-9), counts with a mean of up to `EXACT` by adding up probabilities,
p(j) = (a + b / j) p(j - 1), and other counts by the Cornish-Fisher series of their first four moments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts up to this mean are inverted exactly. Steps go up to mean + 8 sqrt(mean) + 8; more has a chance of under 1e-12.
EXACT = 10.0
#: Candidates of a gamma draw; one is refused in 5 % of draws at most, and where all are, the density's peak is taken.
CANDIDATES = 4

# Acklam's rational approximation of the normal quantile, centre (numerator, denominator) and tail.
CENTRE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
EDGE = 0.02425


def uniforms(*key: Column | str | int) -> tuple[Column, Column]:
    """Two uniforms in (0, 1) of a key; texts and numbers in the key are literals."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]).cast("binary"))
    part = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    return part(1), part(14)


def uniform(*key: Column | str | int) -> Column:
    return uniforms(*key)[0]


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _let_all(then, *values: Column) -> Column:
    """then(values...), with each worked out once."""
    return let(F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)]), lambda s: then(*[s[f"_{i}"] for i in range(len(values))]))


def normal_quantile(u: Column) -> Column:
    def at(p: Column) -> Column:
        q = p - 0.5
        tail = lambda r: _polynomial(r, TAIL) / _polynomial(r, TAIL_BELOW)
        centre = _polynomial(q * q, CENTRE) * q / _polynomial(q * q, CENTRE_BELOW)
        return F.when(p < EDGE, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - EDGE, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(centre)

    return let(u, at)


def _by_steps(u: Column, mean: Column, first: Column, a: Column, b: Column) -> Column:
    """The least j whose summed probability is u or more, for p(0) = first and p(j) = (a + b / j) p(j - 1); u, a and b are plain columns."""

    def step(s: Column, j: Column) -> Column:
        return F.struct((s["p"] * (a + b / j)).alias("p"), (s["total"] + s["p"]).alias("total"), (s["j"] + F.when(s["total"] + s["p"] < u, 1).otherwise(0)).alias("j"))

    # before step j, p is p(j - 1) and total sums those before it
    steps = F.sequence(F.lit(1), (mean + 8 * F.sqrt(mean) + 8).cast("int"))
    return F.aggregate(steps, F.struct(first.alias("p"), F.lit(0.0).alias("total"), F.lit(0).alias("j")), step, lambda s: s["j"].cast("double"))


def _by_moments(u: Column, mean: Column, sd: Column, skew: Column, excess: Column) -> Column:
    """The whole number nearest to the Cornish-Fisher quantile, 0 at least."""

    def at(z: Column) -> Column:
        w = z + skew * (z * z - 1) / 6 + excess * (z * z * z - 3 * z) / 24 - skew * skew * (2 * z * z * z - 5 * z) / 36
        return F.greatest(F.lit(0.0), F.floor(mean + sd * w + 0.5).cast("double"))

    return let(normal_quantile(u), at)


def poisson_quantile(u: Column, mean: Column) -> Column:
    def at(u: Column, mean: Column) -> Column:
        small = let(F.exp(-mean), lambda first: _by_steps(u, mean, first, F.lit(0.0), mean))
        large = _by_moments(u, mean, F.sqrt(mean), 1 / F.sqrt(mean), 1 / mean)
        return F.when(mean <= 0, 0.0).when(mean <= EXACT, small).otherwise(large)

    return _let_all(at, u, mean)


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """For p over a half the trials that fail are counted."""

    def side(u: Column, n: Column, p: Column) -> Column:
        small = lambda odds: F.least(n, _by_steps(u, n * p, F.exp(n * F.ln(1 - p)), -odds, (n + 1) * odds))
        large = lambda sd: F.least(n, _by_moments(u, n * p, sd, (1 - 2 * p) / sd, (1 - 6 * p * (1 - p)) / (sd * sd)))
        return F.when(n * p <= EXACT, let(p / (1 - p), small)).otherwise(let(F.sqrt(n * p * (1 - p)), large))

    def at(u: Column, n: Column, p: Column) -> Column:
        few = p <= 0.5
        found = _let_all(side, F.when(few, u).otherwise(1 - u), n, F.when(few, p).otherwise(1 - p))
        return F.when((n <= 0) | (p <= 0), 0.0).when(p >= 1, n).when(few, found).otherwise(n - found)

    return _let_all(at, u, n, p)


def gamma_draw(shape: Column, *key: Column | str | int) -> Column:
    """A gamma variable of this shape and scale 1, by the first of a few of Marsaglia and Tsang's candidates."""
    raised = F.when(shape < 1, shape + 1).otherwise(shape)

    def draw(d: Column) -> Column:
        def candidate(i: int) -> Column:
            u1, u2 = uniforms(*key, "g", i)

            def judged(x: Column) -> Column:
                v = F.pow(1 + x / F.sqrt(9 * d), 3)
                return F.when((v > 0) & (F.ln(u2) < 0.5 * x * x + d - d * v + d * F.ln(F.greatest(v, F.lit(1e-300)))), d * v)

            return let(normal_quantile(u1), judged)

        return F.coalesce(*[candidate(i) for i in range(CANDIDATES)], d)

    return let(raised - 1 / 3, draw) * F.when(shape < 1, F.pow(uniform(*key, "b"), 1 / shape)).otherwise(1.0)


def negative_binomial_draw(mean: Column, phi: Column, *key: Column | str | int) -> Column:
    """A count with this mean and variance mean + mean^2 / phi: Poisson with a gamma's mean; 0 where the mean is."""
    return let(mean, lambda m: F.when(m <= 1e-12, 0.0).otherwise(poisson_quantile(uniform(*key, "p"), m * gamma_draw(phi, *key) / phi)))
