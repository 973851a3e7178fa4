"""Seeded, partition-independent randomness as column expressions.

``U(seed, k...)`` hashes the seed and the row's key columns with md5 and maps
the first 32 bits into (0, 1).  The value depends only on the seed and the key,
never on partitioning, task retries or executor loss, so every random operator
in the package is repeatable and has an exact SQL twin (``u_sql``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(seed, *keys) -> Column:
    """First 32 bits of md5('seed|k1|k2...') as a non-negative long."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def U(seed, *keys) -> Column:
    """Uniform in the open interval (0, 1) from the seed and key columns."""
    return (hash32(seed, *keys) + F.lit(0.5)) / F.lit(TWO32)


def u_sql(seed, *exprs: str) -> str:
    """DuckDB twin of :func:`U` over SQL expressions."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return (f"((('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT + 0.5)"
            f" / {TWO32})")


def hash32_sql(seed, *exprs: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT)"


def hash52(seed, *keys) -> Column:
    """First 52 bits of md5('seed|k1|k2...') as a non-negative long."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def draw_index(n, seed, *keys) -> Column:
    """A uniform integer in [0, n), n up to 2**52 (a column or a number)."""
    return F.floor(hash52(seed, *keys) / F.lit(2.0 ** 52) * n).cast("long")


def hash52_sql(seed, *exprs: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT)"


def draw_index_sql(n: str, seed, *exprs: str) -> str:
    return f"CAST(floor({hash52_sql(seed, *exprs)} / {2.0 ** 52!r} * {n}) AS BIGINT)"


def normal(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller on two independent uniforms)."""
    u1 = U(seed, F.lit("n1"), *keys)
    u2 = U(seed, F.lit("n2"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal_sql(seed, *exprs: str) -> str:
    u1 = u_sql(seed, "'n1'", *exprs)
    u2 = u_sql(seed, "'n2'", *exprs)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def bernoulli(seed, theta: float, *keys) -> Column:
    """1 when U >= theta, so P(1) = 1 - theta (the reference's semantics)."""
    if not 0.0 <= theta <= 1.0:
        raise ValueError("theta must be in [0, 1]")
    return (U(seed, *keys) >= F.lit(theta)).cast("int")


# Fixed coefficients of Acklam's rational approximation of the inverse normal
# CDF (relative error < 1.15e-9), published values.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_norm_cdf(p: Column) -> Column:
    """Inverse standard normal CDF for p in (0, 1), column arithmetic only."""
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lo = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    hi = -_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + F.lit(1.0))
    return (F.when(p < F.lit(_P_LOW), lo)
            .when(p > F.lit(1.0 - _P_LOW), hi)
            .otherwise(mid))


# Fixed coefficients of Abramowitz & Stegun 7.1.26 (erf, |error| < 1.5e-7).
_AS = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
_AS_P = 0.3275911


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF via the A&S 7.1.26 erf approximation."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_AS_P) * x)
    poly = F.lit(0.0)
    for c in reversed(_AS):
        poly = (poly + F.lit(c)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))


def _poly_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def inv_norm_cdf_sql(p: str) -> str:
    """DuckDB twin of :func:`inv_norm_cdf` (same operations, same order)."""
    q_lo = f"sqrt(-2.0 * ln({p}))"
    q_hi = f"sqrt(-2.0 * ln(1.0 - {p}))"
    lo = f"({_poly_sql(_C, q_lo)} / ({_poly_sql(_D, q_lo)} * {q_lo} + 1.0))"
    hi = f"(-{_poly_sql(_C, q_hi)} / ({_poly_sql(_D, q_hi)} * {q_hi} + 1.0))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_poly_sql(_A, r)} * {q} / ({_poly_sql(_B, r)} * {r} + 1.0))"
    return f"(CASE WHEN {p} < {_P_LOW!r} THEN {lo} WHEN {p} > {1.0 - _P_LOW!r} THEN {hi} ELSE {mid} END)"


def norm_cdf_sql(z: str) -> str:
    """DuckDB twin of :func:`norm_cdf`."""
    x = f"(abs({z}) / {math.sqrt(2.0)!r})"
    t = f"(1.0 / (1.0 + {_AS_P!r} * {x}))"
    poly = "0.0"
    for c in reversed(_AS):
        poly = f"(({poly} + {c!r}) * {t})"
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1.0 + {erf}) ELSE 0.5 * (1.0 - {erf}) END)"
