"""Column expressions shared by the operators.

All of these are built-in Spark expressions (codegen'd, JVM side); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**32, the range of the 8-hex-digit md5 prefix hash.
HASH_RANGE = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(text) -> Column:
    """First 8 hex digits of md5(text) as a non-negative BIGINT.

    Equal to DuckDB ``('0x'||substr(md5(x),1,8))::BIGINT`` so that the
    Spark operators and the SQL oracle draw identical pseudo-random numbers.
    """
    return F.conv(F.substring(F.md5(_col(text).cast("string")), 1, 8), 16, 10).cast("bigint")


def unit_hash(text) -> Column:
    """Deterministic uniform number in [0, 1) derived from ``hash32``."""
    return hash32(text) / F.lit(HASH_RANGE)


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def sigmoid(x) -> Column:
    """Numerically stable logistic function."""
    x = _col(x)
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def softplus(x) -> Column:
    """log(1 + exp(x)) without overflow."""
    x = _col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def two_class_posterior(log_a, log_b) -> Column:
    """exp(a)/(exp(a)+exp(b)) with the max shift used by the reference E-steps."""
    a, b = _col(log_a), _col(log_b)
    m = F.greatest(a, b)
    ea, eb = F.exp(a - m), F.exp(b - m)
    return ea / (ea + eb)


def gamma_bin(g, bins: int) -> Column:
    """The bin of γ among ``bins`` equal ones over [0, 1]; 1 is in the last.
    Nine decimals count, so that a value on an edge falls alike whatever the
    order in which its sums were added."""
    return F.least(F.floor(F.round(_col(g), 9) * bins), F.lit(bins - 1)).cast("int")
