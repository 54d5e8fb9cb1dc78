"""Tail probabilities and quantiles as column expressions.

Spark has no ``erf``; the normal tail uses W. J. Cody's rational approximations (1969) and the
normal quantile M. Wichura's AS 241 (1988). Both are produced as plain SQL arithmetic, so they
stay inside whole-stage code generation and read the same in any SQL dialect.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: Cody's erf/erfc coefficients -------------------------------------------
ERF_NUM = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
           3.20937758913846947e03, 1.85777706184603153e-1]
ERF_DEN = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
           2.84423683343917062e03]
ERFC_MID_NUM = [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01,
                2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
                2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
ERFC_MID_DEN = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
                1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
                3.43936767414372164e03, 1.23033935480374942e03]
ERFC_FAR_NUM = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
                1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
ERFC_FAR_DEN = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
                6.05183413124413191e-2, 2.33520497626869185e-3]
# --- fixed values: AS 241 coefficients, highest power first --------------------------------
PPF_CENTRE_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
                  45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
                  133.14166789178437745, 3.387132872796366608]
PPF_CENTRE_DEN = [5226.495278852545925, 28729.085735721942674, 39307.89580009271061,
                  21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
                  42.313330701600911252, 1.0]
PPF_NEAR_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                4.6303378461565452959, 1.42343711074968357734]
PPF_NEAR_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                2.05319162663775882187, 1.0]
PPF_FAR_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
               0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
               5.4637849111641143699, 6.6579046435011037772]
PPF_FAR_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
               7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
               0.59983220655588793769, 1.0]


def _lit(x: float) -> str:
    return f"{x:.17e}"


def _horner(coefs, x: str) -> str:
    out = _lit(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_lit(c)})"
    return out


def _cody_ratio(num, den, x: str) -> str:
    """num is stored with its leading coefficient last, den without its leading one."""
    return f"({_horner([num[-1]] + num[:-1], x)} / {_horner([1.0] + den, x)})"


def erfc_sql(x: str) -> str:
    """SQL text of erfc(x) for a column (or short expression) ``x`` with x >= 0."""
    sq = f"({x} * {x})"
    near = f"(1e0 - {x} * {_cody_ratio(ERF_NUM, ERF_DEN, sq)})"
    mid = f"(exp(-{sq}) * {_cody_ratio(ERFC_MID_NUM, ERFC_MID_DEN, x)})"
    inv = f"(1e0 / {sq})"
    far_poly = f"({inv} * {_cody_ratio(ERFC_FAR_NUM, ERFC_FAR_DEN, inv)})"
    far = f"(exp(-{sq}) * ({_lit(1.0 / math.sqrt(math.pi))} - {far_poly}) / {x})"
    return f"(CASE WHEN {x} <= 0.46875e0 THEN {near} WHEN {x} <= 4e0 THEN {mid} ELSE {far} END)"


def two_sided_p_sql(z: str) -> str:
    """SQL text of 2 * P(Z > |z|)."""
    return erfc_sql(f"(abs({z}) * {_lit(math.sqrt(0.5))})")


def ppf_tail_sql(p: str) -> str:
    return f"sqrt(-ln(least({p}, 1e0 - {p})))"


def norm_ppf_sql(p: str, r: str | None = None) -> str:
    """SQL text of the standard normal quantile of ``p``; ``r`` may name its stored tail term."""
    q = f"({p} - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    centre = f"({q} * {_horner(PPF_CENTRE_NUM, r0)} / {_horner(PPF_CENTRE_DEN, r0)})"
    r = r or ppf_tail_sql(p)
    rn, rf = f"({r} - 1.6e0)", f"({r} - 5e0)"
    near = f"({_horner(PPF_NEAR_NUM, rn)} / {_horner(PPF_NEAR_DEN, rn)})"
    far = f"({_horner(PPF_FAR_NUM, rf)} / {_horner(PPF_FAR_DEN, rf)})"
    tail = f"(CASE WHEN {r} <= 5e0 THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} "
            f"WHEN {p} < 0.5e0 THEN -{tail} ELSE {tail} END)")


def two_sided_p(z: str) -> Column:
    """P(|Z| > |z|) for the column named ``z``."""
    return F.expr(two_sided_p_sql(z))


def chi2_1df_sf(stat: str) -> Column:
    return F.expr(erfc_sql(f"sqrt({stat} * 0.5e0)"))


def norm_ppf(p: str) -> Column:
    return F.expr(norm_ppf_sql(p))


def with_norm_ppf(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add the normal quantile of column ``p``, computing its tail term once per row."""
    return df.withColumn("__tail", F.expr(ppf_tail_sql(p))).withColumn(out, F.expr(norm_ppf_sql(p, "__tail"))).drop("__tail")


def weighted_chi2_sf(q: float, weights: np.ndarray) -> float:
    """Upper tail at ``q`` of a sum of independent chi-squares (one degree each) with positive ``weights``, by saddlepoint.

    Close to the mean, where the saddlepoint formula has a hole, it is read off a straight line between two points beside it.
    """
    lam = weights[weights > 1e-9 * max(weights.max(initial=0.0), 1e-300)]
    if not len(lam) or q <= 0:
        return 1.0
    mean, sd = lam.sum(), math.sqrt(2 * (lam * lam).sum())
    if abs(q - mean) < 1e-3 * sd:
        lo, hi = mean - 1e-3 * sd, mean + 1e-3 * sd
        a, b = weighted_chi2_sf(lo * (1 - 1e-12), lam), weighted_chi2_sf(hi * (1 + 1e-12), lam)
        return a + (b - a) * (q - lo) / (hi - lo)
    slope = lambda z: float((lam / (1 - 2 * z * lam)).sum())
    lo, hi = -len(lam) / (2 * q), (1 - 1e-12) / (2 * lam.max())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) < q else (lo, mid)
    z = (lo + hi) / 2
    spread = 1 - 2 * z * lam
    w = math.copysign(math.sqrt(max(2 * (z * q + 0.5 * np.log(spread).sum()), 0.0)), z)
    v = z * math.sqrt(float((2 * (lam / spread) ** 2).sum()))
    return min(max(0.5 * math.erfc((w + math.log(v / w) / w) / math.sqrt(2)), 0.0), 1.0)


def _incomplete_beta(a, b, x, terms: int = 300):
    """Regularised incomplete beta by the modified Lentz continued fraction, element-wise."""
    tiny = 1e-300
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    lg = np.frompyfunc(math.lgamma, 1, 1)
    log_front = (lg(aa + bb) - lg(aa) - lg(bb)).astype(float) + aa * np.log(np.maximum(xx, tiny)) \
        + bb * np.log1p(-np.minimum(xx, 1 - 1e-16))
    c = np.ones_like(xx)
    d = 1.0 - (aa + bb) * xx / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    part = np.exp(log_front) * h / aa
    return np.where(swap, 1.0 - part, part)


def student_t_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided Student t p-values of numpy arrays."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    out = np.full(t.shape, np.nan)
    if ok.any():
        tt, dd = t[ok], df[ok]
        out[ok] = _incomplete_beta(dd / 2.0, np.full_like(dd, 0.5), dd / (dd + tt * tt))
    out[np.isinf(t) & (df > 0)] = 0.0
    return out


@F.pandas_udf(T.DoubleType())
def _student_t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    p = student_t_p_values(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


def correlation_p(r, n) -> Column:
    """p-value of a Pearson correlation ``r`` over ``n`` pairs (t test with n - 2 df)."""
    r = F.col(r) if isinstance(r, str) else r
    n = F.col(n) if isinstance(n, str) else n
    df = (n - F.lit(2)).cast("double")
    rest = F.lit(1.0) - r * r
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(r * F.sqrt(df / rest))
    return _student_t_udf(t, df)
