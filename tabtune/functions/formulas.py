"""Closed-form statistical formulas rendered as SQL expression text.

The same text runs inside Spark (``F.expr``, so it stays JVM-side and in
whole-stage codegen) and inside DuckDB (the correctness twin), so both
engines evaluate exactly the same arithmetic.  Only functions spelled the
same in both dialects are used: ``ln``, ``exp``, ``sqrt``, ``asin``,
``abs``, ``CASE``.  Every numeric literal is written in exponent form so
that both engines type it as DOUBLE (plain ``1.5`` would be a DECIMAL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_sql(v: float) -> str:
    text = repr(float(v))
    if "e" not in text and "inf" not in text and "nan" not in text:
        text += "e0"
    return f"({text})"


def poly_sql(coefs: list[float], x: str) -> str:
    """c0 + c1*x + c2*x^2 + ... in Horner form."""
    acc = lit_sql(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"({lit_sql(c)} + ({x}) * {acc})"
    return acc


# Rational approximation of the standard normal quantile
# (P. J. Acklam, public), central region |p - .5| <= .47575.
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0]
ACKLAM_P_LOW = 0.02425

# Chebyshev fit of erfc (Press et al., Numerical Recipes, erfcc),
# fractional error below 1.2e-7 everywhere; coefficients of t^0..t^9.
ERFCC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _horner_desc(coefs: list[float], x: str) -> str:
    """coefs given highest power first (the usual way the table is printed)."""
    return poly_sql(list(reversed(coefs)), x)


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF of the SQL expression ``p`` in (0, 1)."""
    q = f"(({p}) - {lit_sql(0.5)})"
    r = f"({q} * {q})"
    central = f"({q} * {_horner_desc(ACKLAM_A, r)} / {_horner_desc(ACKLAM_B, r)})"
    lo_s = f"sqrt({lit_sql(-2.0)} * ln({p}))"
    hi_s = f"sqrt({lit_sql(-2.0)} * ln({lit_sql(1.0)} - ({p})))"
    lower = f"({_horner_desc(ACKLAM_C, lo_s)} / {_horner_desc(ACKLAM_D, lo_s)})"
    upper = f"(-{_horner_desc(ACKLAM_C, hi_s)} / {_horner_desc(ACKLAM_D, hi_s)})"
    return (f"(CASE WHEN ({p}) < {lit_sql(ACKLAM_P_LOW)} THEN {lower} "
            f"WHEN ({p}) > {lit_sql(1 - ACKLAM_P_LOW)} THEN {upper} "
            f"ELSE {central} END)")


def erfc_sql(x: str) -> str:
    z = f"abs({x})"
    t = f"({lit_sql(1.0)} / ({lit_sql(1.0)} + {lit_sql(0.5)} * {z}))"
    ans = f"({t} * exp(-({z}) * ({z}) + {poly_sql(ERFCC, t)}))"
    return f"(CASE WHEN ({x}) >= {lit_sql(0.0)} THEN {ans} ELSE {lit_sql(2.0)} - {ans} END)"


def norm_sf_sql(z: str) -> str:
    """Upper tail P(Z > z) of the standard normal."""
    return f"({lit_sql(0.5)} * {erfc_sql(f'({z}) / sqrt({lit_sql(2.0)})')})"


def expr(sql_text: str) -> Column:
    return F.expr(sql_text)
