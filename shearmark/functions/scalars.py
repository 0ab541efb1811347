"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MODE_NAMES


def to_double(col: Column) -> Column:
    """Numeric coercion: text that is not a number, and NaN, become null."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def percent(col: Column) -> Column:
    """``98.88%`` as a double."""
    return to_double(F.rtrim(F.regexp_replace(col, "%", "")))


def sample_id(name: Column, path: Column | None = None) -> Column:
    """Run accession from a report name, else from its path; null when neither has one."""
    stem = F.regexp_replace(F.regexp_replace(name, "_fastqc$", ""), "_[12]$", "")
    found = F.nullif(F.regexp_extract(stem, r"(SRR\d+)", 1), F.lit(""))
    if path is None:
        return found
    return F.coalesce(found, F.nullif(F.regexp_extract(path, r"(SRR\d+)", 1), F.lit("")))


def mode_name(method: Column) -> Column:
    """Trimming mode label of a method code (A becomes adapter_only, U untrimmed)."""
    out = F.lit(None).cast("string")
    for code, name in MODE_NAMES.items():
        out = F.when(method == code, F.lit(name)).otherwise(out)
    return out


def erfc(z: Column, u: Column | None = None) -> Column:
    """Complementary error function for z >= 0 (rational-exponential form, relative error below 1.2e-7).

    ``u`` may hand in 1 / (1 + z/2) as a column computed before.
    """
    # The published coefficients, constant term first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
                    -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    u = F.lit(1.0) / (F.lit(1.0) + z / F.lit(2.0)) if u is None else u
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + u * poly
    return u * F.exp(poly - z * z)


def median_of(values: list[Column]) -> Column:
    """Median of a fixed handful of columns, nulls skipped."""
    a = F.sort_array(F.array_compact(F.array(*values)))
    n = F.size(a)
    lo = F.get(a, F.floor((n - 1) / F.lit(2)).cast("int"))
    hi = F.get(a, F.floor(n / F.lit(2)).cast("int"))
    return (lo + hi) / F.lit(2.0)
