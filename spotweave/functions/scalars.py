"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: str | Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    v = col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_nan(value: str | Column) -> Column:
    """A double; anything missing, unparsable or infinite becomes NaN."""
    v = F.expr(f"try_cast({value} AS DOUBLE)") if isinstance(value, str) else value
    return F.when(is_finite(v), v).otherwise(F.lit(NAN))


def nan_to_null(value: str | Column) -> Column:
    v = col(value)
    return F.when(is_finite(v), v)


def safe_int(value: str) -> Column:
    """Integer-like text or number as BIGINT, else NULL (hand-kept index cells)."""
    return F.expr(f"try_cast(trim(CAST({value} AS STRING)) AS BIGINT)")


def guarded_cosine(dot: str | Column, left_sq: str | Column, right_sq: str | Column) -> Column:
    """Plain cosine from sums; 0 when a norm is 0, clipped to [-1, 1]."""
    den = F.sqrt(col(left_sq)) * F.sqrt(col(right_sq))
    raw = F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(col(dot), den))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def harmonic_mean(a: str | Column, b: str | Column) -> Column:
    """2ab/(a+b); 0 when both are 0, NaN when one is negative or not finite."""
    a, b = col(a), col(b)
    usable = is_finite(a) & is_finite(b) & (a >= 0) & (b >= 0)
    return F.when(~usable, F.lit(NAN)).when(a + b > 0, F.try_divide(2.0 * a * b, a + b)).otherwise(
        F.lit(0.0)
    )


def clip01(value: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(value)))


def equal_width_bin(value: str | Column, low: Column, high: Column, n: int) -> Column:
    """0-based bin of ``n`` equal bins; the top edge, and a zero range, fall in the last bin."""
    v = col(value)
    raw = F.floor(F.try_divide(v - low, high - low) * n)
    return F.greatest(
        F.lit(0), F.least(F.coalesce(raw, F.lit(n - 1)), F.lit(n - 1))
    ).cast("int")


def fraction_true(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def k_folder(k: str | Column) -> Column:
    return F.format_string("k_%03d", col(k))


def alpha_tag(alpha: float) -> str:
    """0.5 -> ``0p50``: a noise level usable in a file name."""
    return f"{alpha:.2f}".replace(".", "p")


def natural_key(name: str | Column) -> list[Column]:
    """Three sort numbers of names like ``2_1_tissue``; names without a number go last."""
    n = col(name)

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(n, pattern, 1), F.lit("")).cast("int")

    first = part(r"^(\d+)_")
    second = part(r"^\d+_(\d+)_")
    third = part(r"^\d+_\d+_(\d+)_")
    missing = first.isNull()
    return [
        F.coalesce(first, F.lit(999)),
        F.when(missing, F.lit(999)).otherwise(F.coalesce(second, F.lit(0))),
        F.when(missing, F.lit(999)).otherwise(F.coalesce(third, F.lit(0))),
    ]


def first_json_object(text: str | Column) -> Column:
    """The first brace-delimited object in noisy text (one nesting level inside)."""
    found = F.regexp_extract(col(text), r"(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    return F.nullif(found, F.lit(""))
