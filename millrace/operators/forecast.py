"""Tests, volatility models, ARMA and lag regressions for many series at once.

Everything but the filter is solved from one object per series: the centred cross products of its
sliding windows (`window_moments`). Lags, differences and regression residuals are linear maps of
a window, so a whole order search is matrix algebra on sums that one scan produced. Values come
from closed-form estimators (Engle 1982; Hannan & Rissanen 1982); GARCH is refined by likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import dot
from ..session import TASK_ROWS, Shared, as_list, cut_lineage, largest_group
from .gram import combine, moments, of_rows
from .joins import lookup_join, top_per_key
from .order import windowed, with_position
from .series import acf

# MacKinnon's response surface for the unit-root test with a constant (1994).
MACKINNON_STAR, MACKINNON_MIN, MACKINNON_MAX = -1.61, -18.83, 2.74
MACKINNON_SMALL = (2.1659, 1.4412, 0.038269)
MACKINNON_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

# Noise levels, jump size and blend of the smoothing filter.
KALMAN_Q, KALMAN_R, KALMAN_JUMP = 1e-5, 0.1, 30.0
KALMAN_NEW, KALMAN_OLD = 0.382, 0.618


# Upper bound of a GARCH model's alphas and betas in sum.
PERSISTENCE = 0.9999


def window_moments(df: DataFrame, value: str, lags: int, order_by, partition_by=None,
                   max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., n, mean, m2) of the vectors (x[t-lags], .., x[t]) of every series."""
    groups = as_list(partition_by)
    rows, window, done = windowed(df.select(*groups, *as_list(order_by), F.col(value).cast("double").alias("__x")),
                                  order_by, groups, before=lags, max_rows=max_rows)
    full = done(rows.withColumn("__w", F.collect_list("__x").over(window.rowsBetween(-lags, 0))))
    return moments(full.filter(F.size("__w") == lags + 1), "__w", groups)


def _edge_values(df, value, n, order_by, groups, last: bool) -> DataFrame:
    """(partition.., edge): the first or last n values in time order; n is small."""
    order_by = as_list(order_by)
    rows = df.withColumn("__one", F.lit(0)).select(*groups, "__one", *order_by, F.col(value).cast("double").alias("__x"))
    order = [F.desc(c) for c in order_by] if last else order_by
    kept = top_per_key(rows, groups or ["__one"], order, n)
    array = F.transform(F.array_sort(F.collect_list(F.struct("rank", "__x"))), lambda s: s["__x"])
    return kept.groupBy(*groups).agg((F.reverse(array) if last else array).alias("edge"))


def _joined(a: DataFrame, b: DataFrame, groups: list) -> DataFrame:
    if groups:
        return a.join(b, groups)
    return a.withColumn("__one", F.lit(0)).join(b.withColumn("__one", F.lit(0)), "__one").drop("__one")


def _solve(df: DataFrame, groups: list, fields: str, fn: Callable[[pd.Series], list[tuple]]) -> DataFrame:
    """Rows fn(row) for every per-series row of sums."""
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([*[df.schema[g] for g in groups], *extra.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*[row[g] for g in groups], *r) for _, row in batch.iterrows() for r in fn(row)]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def _unpack(row) -> tuple:
    mean = np.asarray(row["mean"], dtype=float)
    return int(row["n"]), mean, np.asarray(row["m2"], dtype=float).reshape(len(mean), len(mean))


def _regress(m: tuple) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(coef, intercept, residual sum of squares, inverse of the centred products); target last."""
    n, mean, s = m
    a, b = s[:-1, :-1], s[:-1, -1]
    if len(b) == 0:
        return b, float(mean[-1]), float(s[-1, -1]), a
    inv = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
    coef = inv @ b
    ssr = max(float(s[-1, -1] - b @ coef), 0.0)
    return coef, float(mean[-1] - coef @ mean[:-1]), ssr, inv


def _mapped(m: tuple, t: np.ndarray) -> tuple:
    return m[0], t @ m[1], t @ m[2] @ t.T


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def mackinnon_p(tau: float) -> float:
    """p-value of the unit-root statistic (constant, one series)."""
    if tau > MACKINNON_MAX:
        return 1.0
    if tau < MACKINNON_MIN:
        return 0.0
    poly = MACKINNON_SMALL if tau <= MACKINNON_STAR else MACKINNON_LARGE
    return normal_cdf(sum(c * tau ** i for i, c in enumerate(poly)))


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with `dof` degrees of freedom > x), in closed form for whole dof."""
    half = x / 2
    if dof % 2 == 0:
        term, total = math.exp(-half), 0.0
        for i in range(dof // 2):
            total += term
            term *= half / (i + 1)
        return min(total, 1.0)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(dof // 2):
        total += term
        term *= half / (i + 1.5)
    return min(total, 1.0)


def _adf_map(lags: int, width: int) -> np.ndarray:
    """Rows: x[t-1], dx[t-1], .., dx[t-lags], dx[t] of a window of `width` values."""
    t = np.zeros((lags + 2, width))
    t[0, -2] = 1
    for k in range(1, lags + 1):
        t[k, -1 - k], t[k, -2 - k] = 1, -1
    t[-1, -1], t[-1, -2] = 1, -1
    return t


def adf_test(df: DataFrame, value: str, order_by, partition_by=None, max_lag: int | None = None, autolag: bool = True,
             alpha: float = 0.05, max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., n, lag, stat, p_value, stationary): augmented Dickey-Fuller with a constant.

    The lag minimises AIC on the rows all candidates share; the statistic uses every row the
    chosen lag allows. The default largest lag is 12 (n / 100)^(1/4) of each series.
    """
    groups = as_list(partition_by)
    longest = largest_group(df, groups)
    own_lag = lambda n: max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    top = own_lag(longest) if max_lag is None else max_lag
    sums = window_moments(df, value, top + 1, order_by, groups, max_rows)
    head = _edge_values(df, value, top + 2, order_by, groups, last=False)

    def test(row) -> list[tuple]:
        base = _unpack(row)
        first = np.asarray(row["edge"], dtype=float)
        n = base[0] + top + 1
        limit = min(top, own_lag(n)) if max_lag is None else max_lag

        def sample(lags: int, start: int) -> tuple:
            """Sums of the regression with `lags` on the rows t >= start."""
            early = []
            for t in range(start, top + 1):
                w = first[t - lags - 1:t + 1]
                early.append(_adf_map(lags, lags + 2) @ w)
            late = _mapped(base, _adf_map(lags, top + 2))
            return combine(of_rows(np.array(early)), late) if early else late

        best = limit
        if autolag:
            scores = []
            for lags in range(limit + 1):
                m = sample(lags, limit + 1)
                _, _, ssr, _ = _regress(m)
                scores.append(m[0] * (math.log(2 * math.pi * max(ssr, 1e-300) / m[0]) + 1) + 2 * (lags + 2))
            best = int(np.argmin(scores))
        m = sample(best, best + 1)
        coef, _, ssr, inv = _regress(m)
        free = m[0] - best - 2
        err = math.sqrt(ssr / free * inv[0, 0]) if free > 0 else 0.0
        if err <= 0:
            return [(n, best, None, None, None)]
        stat = float(coef[0]) / err
        p = mackinnon_p(stat)
        return [(n, best, stat, p, p <= alpha)]

    return _solve(_joined(sums, head, groups), groups,
                  "n bigint, lag int, stat double, p_value double, stationary boolean", test)


def ljung_box(df: DataFrame, value: str, lags: int, order_by, partition_by=None, max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., lag, q, p_value, white_noise) for every lag up to `lags`.

    White noise is rejected when the p-value rounds to 0 at six decimals.
    """
    groups = as_list(partition_by)
    rho = acf(df, value, lags, order_by, groups, max_rows)
    terms = F.transform(F.array_sort(F.collect_list(F.struct("lag", "rho"))), lambda s: s["rho"])
    wide = rho.groupBy(*groups, "n").agg(terms.alias("rhos"))

    def test(row) -> list[tuple]:
        n, total, out = int(row["n"]), 0.0, []
        for k, r in enumerate(row["rhos"], 1):
            total += n * (n + 2) * r * r / (n - k)
            p = chi2_tail(total, k)
            out.append((k, total, p, round(p, 6) != 0))
        return out

    return _solve(wide, groups, "lag int, q double, p_value double, white_noise boolean", test)


def _squared_residuals(df, value, order_by, groups) -> DataFrame:
    """Adds __mu and __e2 = (x - mean)^2."""
    means = df.groupBy(*groups).agg(F.avg(value).alias("__mu"))
    with_mean = (lookup_join(df, means, groups) if groups else df.withColumn("__mu", F.lit(means.first()["__mu"])))
    return with_mean.select(*groups, *as_list(order_by), "__mu", F.pow(F.col(value) - F.col("__mu"), 2).alias("__e2"))


def arch_fit(df: DataFrame, value: str, p: int, order_by, partition_by=None, max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., mu, omega, alpha, recent): constant mean, squared residuals on their p lags."""
    groups = as_list(partition_by)
    e2 = _squared_residuals(df, value, order_by, groups)
    sums = window_moments(e2, "__e2", p, order_by, groups, max_rows)
    edges = _joined(_edge_values(e2, "__e2", p, order_by, groups, last=True),
                    e2.groupBy(*groups).agg(F.first("__mu").alias("mu")), groups)

    def fit(row):
        coef, const, _, _ = _regress(_unpack(row))
        return [(float(row["mu"]), const, [float(c) for c in coef[::-1]], [float(x) for x in row["edge"]])]

    return _solve(_joined(sums, edges, groups), groups,
                  "mu double, omega double, alpha array<double>, recent array<double>", fit)


def arch_forecast(fits: DataFrame, h: int, partition_by=None) -> DataFrame:
    """(partition.., step, mean, variance): h variance steps from arch_fit rows."""

    def run(row):
        past, out = list(row["recent"]), []
        for step in range(1, h + 1):
            v = row["omega"] + sum(a * past[-1 - i] for i, a in enumerate(row["alpha"]))
            past.append(v)
            out.append((step, float(row["mu"]), float(v)))
        return out

    return _solve(fits, as_list(partition_by), "step int, mean double, variance double", run)


def _two_stage(m: tuple, p: int, q: int, long: int) -> tuple:
    """Hannan-Rissanen on window sums: (ar, ma, intercept, sigma2, long-AR coef, long-AR intercept, sums)."""
    width = len(m[1])
    pick = np.zeros((long + 1, width))
    pick[np.arange(long + 1), np.arange(width - long - 1, width)] = 1
    a, c, _, _ = _regress(_mapped(m, pick))  # a[0] belongs to the oldest lag
    t = np.zeros((p + q + 1, width))
    shift = np.zeros(p + q + 1)
    for i in range(p):
        t[i, width - 2 - i] = 1
    for j in range(q):
        at = width - 2 - j
        t[p + j, at] = 1
        t[p + j, at - long:at] -= a
        shift[p + j] = c
    t[-1, -1] = 1
    n, mean, s = _mapped(m, t)
    coef, const, ssr, _ = _regress((n, mean - shift, s))
    return coef[:p], coef[p:], const, ssr / n, a, c


def _long_order(m: tuple, need: int) -> int:
    return len(m[1]) - 1 - need


def _garch_variances(omega: float, alpha, beta, e2: np.ndarray) -> np.ndarray:
    """Variances of a series and of the step after it; the mean square stands for what lies before it."""
    level, p, q = float(e2.mean()), len(alpha), len(beta)
    driven = omega + np.convolve(np.concatenate([np.full(p, level), e2]), np.concatenate([[0.0], alpha]))[p:p + len(e2) + 1]
    past = [level] * q
    for v in driven.tolist():
        past.append(v + sum(b * past[-1 - j] for j, b in enumerate(beta)))
    return np.array(past[q:])


def _garch_loss(theta: np.ndarray, p: int, e2: np.ndarray) -> float:
    """Minus the Gaussian log likelihood per row, up to constants."""
    v = _garch_variances(*_garch_of(theta, p), e2)[:-1]
    return float((np.log(v) + e2 / v).mean()) if (v > 0).all() and np.isfinite(v).all() else float("inf")


def _garch_of(theta: np.ndarray, p: int) -> tuple:
    """(omega, alpha, beta) of free numbers: omega positive, the others non-negative and below PERSISTENCE in sum."""
    share = np.exp(np.clip(theta[1:], -40, 40))
    share = PERSISTENCE * share / (1.0 + share.sum())
    return float(np.exp(np.clip(theta[0], -700, 700))), share[:p], share[p:]


def _simplex(loss: Callable, start: np.ndarray, tol: float = 1e-9, steps: int = 600) -> tuple[np.ndarray, bool]:
    """Lowest point found by Nelder & Mead (1965), never above the start, and whether the simplex closed."""
    points = [start, *(start + 0.5 * row for row in np.eye(len(start)))]
    values = [loss(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tol * (1 + abs(values[0])):
            return points[0], True
        middle = np.mean(points[:-1], axis=0)
        near = middle + (middle - points[-1])
        got = loss(near)
        if got < values[0]:
            far = middle + 2 * (middle - points[-1])
            more = loss(far)
            points[-1], values[-1] = (far, more) if more < got else (near, got)
        elif got < values[-2]:
            points[-1], values[-1] = near, got
        else:
            inner = middle + 0.5 * ((near if got < values[-1] else points[-1]) - middle)
            less = loss(inner)
            if less < min(got, values[-1]):
                points[-1], values[-1] = inner, less
            else:
                points = [points[0], *(points[0] + 0.5 * (x - points[0]) for x in points[1:])]
                values = [values[0], *(loss(x) for x in points[1:])]
    return points[int(np.argmin(values))], False


def _garch_start(omega: float, alpha: np.ndarray, beta: np.ndarray, level: float) -> np.ndarray:
    """Free numbers of the closed form's values, moved inside the bounds."""
    share = np.maximum(np.concatenate([alpha, beta]), 1e-3)
    share = np.where(np.isfinite(share), share, 1e-3) / PERSISTENCE
    if share.sum() > 0.98:
        share *= 0.98 / share.sum()
    if not np.isfinite(omega) or omega <= 0:
        omega = (1 - share.sum()) * level
    return np.concatenate([[np.log(max(omega, 1e-300))], np.log(share / (1 - share.sum()))])


def garch_fit(df: DataFrame, value: str, p: int, q: int, order_by, partition_by=None, long_lags: int = 20, h: int = 0,
              max_rows: int = TASK_ROWS, refine_rows: int = 5000) -> DataFrame:
    """(partition.., mu, omega, alpha, beta, variances, converged): GARCH by maximum likelihood from the ARMA form.

    `p` lags of the squared residual, `q` lags of the variance; `variances` holds h steps ahead. The ARMA form of the
    squared residuals gives the start, from one scan of every series; the Gaussian likelihood of its last `refine_rows`
    values is then raised within the bounds: omega positive, alpha and beta non-negative and below 1 in sum.
    `converged` is false where the search did not close, and for a constant series, whose omega is 0.
    """
    groups = as_list(partition_by)
    r = max(p, q)
    e2 = _squared_residuals(df, value, order_by, groups)
    sums = window_moments(e2, "__e2", long_lags + r, order_by, groups, max_rows)
    edges = _joined(_edge_values(e2, "__e2", max(refine_rows, long_lags + r + 1), order_by, groups, last=True),
                    e2.groupBy(*groups).agg(F.first("__mu").alias("mu")), groups)

    def fit(row):
        ar, ma, const, _, _, _ = _two_stage(_unpack(row), r, q, long_lags)
        alpha = ar.copy()
        alpha[:q] += ma
        past = np.asarray(row["edge"], dtype=float)
        level = float(past.mean())
        if not level > 0:
            return [(float(row["mu"]), 0.0, [0.0] * p, [0.0] * q, [0.0] * h, False)]
        scaled = past / level
        theta, closed = _simplex(lambda x: _garch_loss(x, p, scaled),
                                 _garch_start(const / level, alpha[:p], -ma, 1.0))
        omega, alpha, beta = _garch_of(theta, p)
        known = _garch_variances(omega, alpha, beta, scaled)
        squares, v, out = scaled.tolist(), known[:-1].tolist(), []
        for _ in range(h):
            ahead = omega + sum(a * squares[-1 - i] for i, a in enumerate(alpha) if i < len(squares)) + sum(
                b * v[-1 - j] for j, b in enumerate(beta) if j < len(v))
            squares.append(ahead)
            v.append(ahead)
            out.append(float(ahead * level))
        return [(float(row["mu"]), omega * level, alpha.tolist(), beta.tolist(), out, closed)]

    return _solve(_joined(sums, edges, groups), groups, "mu double, omega double, alpha array<double>, beta array<double>, "
                  "variances array<double>, converged boolean", fit)


def _arma_scores(m: tuple, max_p: int, max_q: int, long: int) -> list[tuple]:
    out = []
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            _, _, _, s2, _, _ = _two_stage(m, p, q, long)
            n, k = m[0], p + q + 2
            base = n * math.log(max(s2, 1e-300))
            out.append((p, q, base + 2 * k, base + k * math.log(n), base + 2 * k * math.log(math.log(n))))
    return out


def arma_order(df: DataFrame, value: str, max_p: int, max_q: int, order_by, partition_by=None, long_lags: int = 20,
               max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., p, q, aic, bic, hqic) for every order, all from one scan."""
    groups = as_list(partition_by)
    sums = window_moments(df, value, long_lags + max(max_p, max_q, 1), order_by, groups, max_rows)
    return _solve(sums, groups, "p int, q int, aic double, bic double, hqic double",
                  lambda row: _arma_scores(_unpack(row), max_p, max_q, long_lags))


def best_order(scores: DataFrame, partition_by=None, by: str = "bic") -> DataFrame:
    """The order with the smallest criterion per series."""
    pick = F.min(F.struct(F.col(by), F.col("p"), F.col("q"))).alias("__s")
    return scores.groupBy(*as_list(partition_by)).agg(pick).select(*as_list(partition_by), "__s.p", "__s.q", f"__s.{by}")


def arma_forecast(df: DataFrame, value: str, h: int, order_by, partition_by=None, order: tuple[int, int] | None = None,
                  max_p: int = 5, max_q: int = 5, long_lags: int = 20, max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., p, q, step, forecast): h steps ahead; the order is given, or chosen by BIC."""
    groups = as_list(partition_by)
    need = max(*(order or (max_p, max_q)), 1)
    sums = window_moments(df, value, long_lags + need, order_by, groups, max_rows)
    edges = _edge_values(df, value, long_lags + need + 1, order_by, groups, last=True)

    def run(row):
        m = _unpack(row)
        p, q = order or min(_arma_scores(m, max_p, max_q, long_lags), key=lambda s: s[3])[:2]
        ar, ma, const, _, a, c = _two_stage(m, p, q, long_lags)
        values = [float(x) for x in row["edge"]]
        past = np.array(values)
        shocks = [float(past[i] - c - a @ past[i - long_lags:i]) for i in range(long_lags, len(past))]
        out = []
        for step in range(1, h + 1):
            v = const + sum(ar[i] * values[-1 - i] for i in range(p)) + sum(ma[j] * shocks[-1 - j] for j in range(q))
            values.append(v)
            shocks.append(0.0)
            out.append((int(p), int(q), step, float(v)))
        return out

    return _solve(_joined(sums, edges, groups), groups, "p int, q int, step int, forecast double", run)


def lag_forecast(df: DataFrame, value: str, lookback: int, order_by, test: str, partition_by=None,
                 est: str = "ols", max_rows: int = TASK_ROWS, **kw) -> DataFrame:
    """The test rows with `prediction`: one step ahead from the `lookback` actual values before.

    `test` names a 0/1 column. est='ols' fits one regression per series on its training rows;
    est='boosted' fits one boosted-tree model on the windows of all series, scaled to [0, 1] by
    the training range. Least squares does not change under that scaling, so it skips it.
    """
    groups = as_list(partition_by)
    rows, window, done = windowed(df, order_by, groups, before=lookback, max_rows=max_rows)
    past = F.collect_list(F.col(value).cast("double")).over(window.rowsBetween(-lookback, -1))
    full = done(rows.withColumn("__w", past)).filter((F.size("__w") == lookback) & F.col(value).isNotNull())
    if est == "ols":
        train = full.filter(F.col(test) == 0).select(
            *groups, F.concat("__w", F.array(F.col(value).cast("double"))).alias("__z"))
        fits = _solve(moments(train, "__z", groups), groups, "__coef array<double>, __const double",
                      lambda row: [(lambda f: (f[0].tolist(), f[1]))(_regress(_unpack(row)))])
        late = full.filter(F.col(test) == 1)
        if groups:
            joined = lookup_join(late, fits, groups)
        else:
            one = fits.first()
            joined = late.withColumn("__coef", F.array(*[F.lit(x) for x in one["__coef"]])).withColumn(
                "__const", F.lit(one["__const"]))
        return joined.withColumn("prediction", dot(F.col("__w"), F.col("__coef")) + F.col("__const")).drop(
            "__w", "__coef", "__const")
    if est != "boosted":
        raise ValueError("est is 'ols' or 'boosted'")
    from .stats import minmax_fit, scale, unscale
    from .trees import boost_reg

    params = minmax_fit(df, value, groups, F.col(test) == 0)
    scaled = scale(cut_lineage(full), value, params, groups, "__y")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    scaled = (lookup_join(scaled, params, groups) if groups else
              scaled.withColumns({c: F.lit(params.first()[c]) for c in ("lo", "hi")}))
    scaled = scaled.withColumn("__v", F.transform("__w", lambda x: (x - F.col("lo")) / width)).drop("lo", "hi")
    fit = boost_reg(scaled.filter(F.col(test) == 0).select("__v", "__y"), "__v", "__y", l1s=[0.0], **kw).fit
    predicted = fit.transform(scaled.filter(F.col(test) == 1), "__v", "prediction")
    return unscale(predicted, "prediction", params, groups).drop("__w", "__v", "__y")


def _filter(z: np.ndarray, x: float, p: float, q: float, r: float, jump: float) -> tuple[np.ndarray, float, float]:
    out = np.empty(len(z))
    for i, value in enumerate(z):
        if np.isnan(value):  # the estimate is carried over a gap, its variance moves on
            p = (1 - (p + q) / (p + q + r)) * (p + q)
            out[i] = x
            continue
        start = KALMAN_NEW * value + KALMAN_OLD * x if abs(x - value) >= jump else x
        ahead = p + q
        gain = ahead / (ahead + r)
        x = start + gain * (value - x)
        p = (1 - gain) * ahead
        out[i] = x
    return out, x, p


def _start(z: np.ndarray) -> float:
    """The first value that is there, or 0."""
    known = z[~np.isnan(z)]
    return float(known[0]) if len(known) else 0.0


def kalman_smooth(df: DataFrame, value: str, order_by, partition_by=None, out: str = "smooth", q: float = KALMAN_Q,
                  r: float = KALMAN_R, jump: float = KALMAN_JUMP, init: str = "zero",
                  max_rows: int = TASK_ROWS) -> DataFrame:
    """Scalar filter with a jump rule, started at 0 (or at the first value with init='first').

    A step depends on the step before, so a series runs in order. A series above `max_rows` is
    cut into chunks that run in parallel from a guessed start; the filter forgets its start, so
    handing each chunk the end of the one before and repeating until no end changes gives the
    sequential result exactly, usually after two rounds. A null value leaves the estimate as it is.
    """
    groups, order_by = as_list(partition_by), as_list(order_by)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
    first = init == "first"

    if largest_group(df, groups) <= max_rows:
        def whole(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order_by, kind="stable")
            z = part[value].to_numpy(dtype=float)
            return part.assign(**{out: _filter(z, _start(z) if first else 0.0, 1.0, q, r, jump)[0]})

        return df.groupBy(*groups).applyInPandas(whole, schema)

    placed = cut_lineage(with_position(df, order_by, groups, "__pos", max_rows).withColumn(
        "__chunk", F.floor(F.col("__pos") / max_rows).cast("int")))
    keys = [*groups, "__chunk"]
    n_chunks = placed.agg(F.max("__chunk")).first()[0] + 1
    # The variance does not depend on the values: P at every chunk start is one short recursion.
    starts, p = [1.0], 1.0
    for _ in range(n_chunks - 1):
        for _ in range(max_rows):
            ahead = p + q
            nxt = (1 - ahead / (ahead + r)) * ahead
            if nxt == p:
                break
            p = nxt
        starts.append(p)
    shared = Shared(df.sparkSession, starts)

    def run(part: pd.DataFrame) -> tuple[pd.DataFrame, float, float]:
        part = part.sort_values("__pos")
        z = part[value].to_numpy(dtype=float)
        chunk = int(part["__chunk"].iloc[0])
        x = part["__in"].iloc[0]
        if chunk == 0:
            x = _start(z) if first else 0.0
        elif pd.isna(x):
            x = _start(z)
        done, end, _ = _filter(z, float(x), shared.value[chunk], q, r, jump)
        return part.assign(**{out: done}), float(x), end

    state = T.StructType([*[placed.schema[k] for k in keys], T.StructField("__end", T.DoubleType())])

    def end_of(part: pd.DataFrame) -> pd.DataFrame:
        rows, _, end = run(part)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "__end": [end]})

    ends = cut_lineage(placed.withColumn("__in", F.lit(None).cast("double")).groupBy(*keys).applyInPandas(end_of, state))
    for _ in range(n_chunks):
        entry = ends.withColumn("__chunk", F.col("__chunk") + 1).withColumnRenamed("__end", "__in")
        fed = lookup_join(placed, entry, keys, "left")
        again = cut_lineage(fed.groupBy(*keys).applyInPandas(end_of, state))
        changed = again.join(ends.withColumnRenamed("__end", "__old"), keys).filter(~F.col("__end").eqNullSafe(F.col("__old")))
        settled = changed.isEmpty()
        ends = again
        if settled:
            break
    entry = ends.withColumn("__chunk", F.col("__chunk") + 1).withColumnRenamed("__end", "__in")
    fed = lookup_join(placed, entry, keys, "left")
    names = schema.fieldNames()
    return fed.groupBy(*keys).applyInPandas(lambda part: run(part)[0][names], schema)


def kalman_lag_forecast(df: DataFrame, value: str, lookback: int, order_by, test: str, partition_by=None,
                        max_rows: int = TASK_ROWS) -> DataFrame:
    """Filter, then a lag regression on the filtered values; the raw values stay for scoring."""
    smooth = kalman_smooth(df, value, order_by, partition_by, "smooth", max_rows=max_rows)
    return lag_forecast(smooth, "smooth", lookback, order_by, test, partition_by, max_rows=max_rows)
