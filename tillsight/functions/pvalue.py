"""Two-sided p-value of Student's t, as a vectorised pandas UDF.

Spark has no Student-t CDF. The p-value of t with ``v`` degrees of freedom
is the regularised incomplete beta ``I_x(v/2, 1/2)`` at ``x = v / (v + t^2)``,
evaluated here by the modified Lentz continued fraction. It runs only on
already-aggregated rows (one per compared pair), never on facts.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors need not have this package installed: the UDF and its helpers are
# shipped inside the task by value (they only use numpy, pandas and math).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_EPS = 1e-15
_MAX_TERMS = 20000
_NORMAL_DOF = 1e5


def _lgamma(a: np.ndarray) -> np.ndarray:
    arr = np.asarray(a, dtype=float)
    return np.array([math.lgamma(v) for v in arr.ravel()], dtype=float).reshape(arr.shape)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the incomplete-beta continued fraction (x below the mode)."""
    ab, a1, am1 = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - ab * x / a1
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    done = np.zeros(x.shape, dtype=bool)
    m = 0
    while not done.all():
        m += 1
        if m > _MAX_TERMS:
            raise ArithmeticError("the continued fraction of the incomplete beta did not converge")
        two_m = 2.0 * m
        for coef in (m * (b - m) * x / ((am1 + two_m) * (a + two_m)),
                     -(a + m) * (ab + m) * x / ((a + two_m) * (a1 + two_m))):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = np.where(done, h, h * step)
        done |= np.abs(step - 1.0) < _EPS
    return h


def regularized_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """I_x(a, b) for arrays with 0 <= x <= 1, a, b > 0; ``rest`` is 1 - x where it is known more exactly."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    rest = 1.0 - x if rest is None else np.asarray(rest, dtype=float)
    out = np.full(x.shape, np.nan)
    out[x <= 0.0] = 0.0
    out[rest <= 0.0] = 1.0
    inner = (x > 0.0) & (rest > 0.0)
    if not inner.any():
        return out
    xi, yi, ai, bi = x[inner], rest[inner], a[inner], b[inner]
    flip = xi >= (ai + 1.0) / (ai + bi + 2.0)
    xs, ys = np.where(flip, yi, xi), np.where(flip, xi, yi)
    as_, bs = np.where(flip, bi, ai), np.where(flip, ai, bi)
    log_ys = np.where(ys > 0.5, np.log1p(-xs), np.log(ys))
    log_front = as_ * np.log(xs) + bs * log_ys - (_lgamma(as_) + _lgamma(bs) - _lgamma(as_ + bs))
    val = np.exp(log_front) * _continued_fraction(as_, bs, xs) / as_
    out[inner] = np.where(flip, 1.0 - val, val)
    return out


def _normal_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p through the normal distribution (Wallace's transform); its error falls with dof squared."""
    z = (8 * dof + 1) / (8 * dof + 3) * np.sqrt(dof * np.log1p(t * t / dof))
    return np.array([math.erfc(v / math.sqrt(2.0)) for v in z])


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); above ``_NORMAL_DOF`` degrees of freedom, where the log-gamma terms would cancel, by the normal tail."""
    t = np.asarray(t, dtype=float)
    dof = np.asarray(dof, dtype=float)
    ok = np.isfinite(t) & np.isfinite(dof) & (dof > 0)
    p = np.full(t.shape, np.nan)
    small, large = ok & (dof < _NORMAL_DOF), ok & (dof >= _NORMAL_DOF)
    if small.any():
        tt, vv = t[small], dof[small]
        total = vv + tt * tt
        p[small] = np.clip(regularized_beta(vv / total, vv / 2.0, np.full(vv.shape, 0.5), rest=tt * tt / total), 0.0, 1.0)
    if large.any():
        p[large] = _normal_tail(t[large], dof[large])
    return p


@F.pandas_udf(DoubleType())
def student_t_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    p = two_sided_p(t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p), None)
