"""Queries over time series: windows, autocorrelation, tests, volatility, forecasts, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import forecast as fc
from ..operators import relational as rl
from ..operators import series as se
from ..session import cut_lineage
from .registry import Tables, query
from .tabular import _round

BY = "o_orderpriority"

# One price series per order priority: the mean order price of a day.
DAILY = """daily AS (SELECT o_orderpriority, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day, avg(o_totalprice) AS close,
   ln(avg(o_totalprice)) AS x FROM orders GROUP BY 1, 2)"""


def daily(t: Tables) -> DataFrame:
    days = rl.day_key(t.orders, "o_orderdate").groupBy(BY, "day").agg(F.avg("o_totalprice").alias("close"))
    return days.withColumn("x", F.log("close"))


def split_daily(t: Tables) -> DataFrame:
    """The series with their last year marked as test rows."""
    return daily(t).withColumn("is_test", (F.col("day") >= 20010101).cast("int"))


@query("lag_windows", f"""WITH {DAILY} SELECT o_orderpriority, day, round(oldest, 6) AS oldest, round(newest, 6) AS newest,
   round(mean, 6) AS mean FROM (SELECT o_orderpriority, day, first_value(x) OVER w AS oldest, last_value(x) OVER w AS newest,
   avg(x) OVER w AS mean, count(*) OVER w AS n FROM daily
   WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)) q WHERE n = 120""")
def _(t):
    rows = se.lag_windows(daily(t), "x", 120, "day", BY)
    mean = F.aggregate("window", F.lit(0.0), lambda s, x: s + x) / 120
    return rows.select(BY, "day", F.round(F.element_at("window", 1), 6).alias("oldest"),
                       F.round(F.element_at("window", -1), 6).alias("newest"), F.round(mean, 6).alias("mean"))


_CENTRED = DAILY + """, c AS (SELECT o_orderpriority, day, x - avg(x) OVER (PARTITION BY o_orderpriority) AS e FROM daily)"""
_RHO = _CENTRED + """, l AS (SELECT c.o_orderpriority, k.lag, c.e, lag(c.e, CAST(k.lag AS INT)) OVER (PARTITION BY c.o_orderpriority, k.lag
   ORDER BY c.day) AS old FROM c CROSS JOIN (SELECT unnest(range(1, 6)) AS lag) k),
rho AS (SELECT o_orderpriority, lag, count(*) AS n, sum(e * old) / sum(e * e) AS rho FROM l GROUP BY 1, 2)"""


@query("acf", f"WITH {_RHO} SELECT o_orderpriority, CAST(lag AS INT) AS lag, n, round(rho, 6) AS rho FROM rho")
def _(t):
    return _round(se.acf(daily(t), "x", 5, "day", BY), "rho")


@query("ljung_box", f"""WITH {_RHO} SELECT o_orderpriority, CAST(lag AS INT) AS lag,
   round(sum(n * (n + 2) * rho * rho / (n - lag)) OVER (PARTITION BY o_orderpriority ORDER BY lag), 6) AS q FROM rho""")
def _(t):
    return _round(fc.ljung_box(daily(t), "x", 5, "day", BY), "q").select(BY, "lag", "q")


@query("ljung_box_test")
def _(t):
    return fc.ljung_box(daily(t), "x", 1, "day", BY)


@query("adf_lag0", f"""WITH {DAILY}, d AS (SELECT o_orderpriority, lag(x) OVER w AS x0, x - lag(x) OVER w AS dx FROM daily
   WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)), r AS (SELECT o_orderpriority, count(x0) AS m, regr_slope(dx, x0) AS b,
   regr_sxx(dx, x0) AS sxx, regr_syy(dx, x0) AS syy, regr_sxy(dx, x0) AS sxy FROM d GROUP BY 1)
   SELECT o_orderpriority, m + 1 AS n, round(b / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx), 6) AS stat FROM r""")
def _(t):
    return _round(fc.adf_test(daily(t), "x", "day", BY, max_lag=0), "stat").select(BY, "n", "stat")


@query("adf_test")
def _(t):
    return fc.adf_test(daily(t), "x", "day", BY)


_ARCH = DAILY + """, e AS (SELECT o_orderpriority, day, avg(x) OVER p AS mu, power(x - avg(x) OVER p, 2) AS e2 FROM daily
   WINDOW p AS (PARTITION BY o_orderpriority)), l AS (SELECT *, lag(e2) OVER (PARTITION BY o_orderpriority ORDER BY day) AS e1 FROM e),
arch AS (SELECT o_orderpriority, any_value(mu) AS mu, regr_intercept(e2, e1) AS omega, regr_slope(e2, e1) AS alpha,
   arg_max(e2, day) AS recent FROM l GROUP BY 1)"""


@query("arch_fit", f"""WITH {_ARCH} SELECT o_orderpriority, round(mu, 6) AS mu, round(omega, 8) AS omega, round(alpha, 6) AS alpha FROM arch""")
def _(t):
    fit = fc.arch_fit(daily(t), "x", 1, "day", BY)
    return fit.select(BY, F.round("mu", 6).alias("mu"), F.round("omega", 8).alias("omega"),
                      F.round(F.col("alpha")[0], 6).alias("alpha"))


@query("arch_forecast", f"""WITH RECURSIVE {_ARCH}, f AS (SELECT o_orderpriority, mu, omega, alpha, 1 AS step, omega + alpha * recent AS v
   FROM arch UNION ALL SELECT o_orderpriority, mu, omega, alpha, step + 1, omega + alpha * v FROM f WHERE step < 120)
   SELECT o_orderpriority, step, round(v, 8) AS variance, round(exp(mu), 2) AS price, round(exp(mu - v), 2) AS low_price FROM f""")
def _(t):
    steps = fc.arch_forecast(fc.arch_fit(daily(t), "x", 1, "day", BY), 120, BY)
    return steps.select(BY, "step", F.round("variance", 8).alias("variance"),
                        F.round(rl.to_price(F.col("mean")), 2).alias("price"),
                        F.round(rl.to_price(F.col("mean"), F.col("variance")), 2).alias("low_price"))


@query("garch_fit")
def _(t):
    fit = fc.garch_fit(daily(t), "x", 2, 2, "day", BY, h=120)
    return fit.select(BY, "mu", "omega", "converged", F.posexplode("variances").alias("step", "variance"))


@query("arma_order")
def _(t):
    return fc.arma_order(daily(t), "x", 5, 5, "day", BY)


@query("arma_forecast")
def _(t):
    steps = fc.arma_forecast(daily(t), "x", 120, "day", BY)
    return steps.withColumn("price", rl.to_price(F.col("forecast")))


@query("lag_forecast")
def _(t):
    return ev.rmse(fc.lag_forecast(split_daily(t), "close", 120, "day", "is_test", BY), "close", "prediction", BY)


@query("lag_forecast_boosted")
def _(t):
    out = fc.lag_forecast(split_daily(t), "close", 120, "day", "is_test", BY, est="boosted", n_trees=100, depth=3)
    return ev.rmse(out, "close", "prediction", BY)


@query("kalman_smooth", """WITH RECURSIVE daily AS (SELECT o_orderpriority AS s, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day,
   avg(o_totalprice) / 1000 AS z FROM orders GROUP BY 1, 2), n AS MATERIALIZED (SELECT s, day, z, row_number() OVER (PARTITION BY s ORDER BY day) AS i FROM daily),
   k(s, i, day, x, p) AS (SELECT s, CAST(0 AS BIGINT), 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM (SELECT DISTINCT s FROM n)
   UNION ALL SELECT k.s, n.i, n.day, CASE WHEN abs(k.x - n.z) >= 30 THEN 0.382::DOUBLE * n.z + 0.618::DOUBLE * k.x ELSE k.x END
     + (k.p + 1e-5::DOUBLE) / (k.p + 1e-5::DOUBLE + 0.1::DOUBLE) * (n.z - k.x),
     (1 - (k.p + 1e-5::DOUBLE) / (k.p + 1e-5::DOUBLE + 0.1::DOUBLE)) * (k.p + 1e-5::DOUBLE)
   FROM k JOIN n ON n.s = k.s AND n.i = k.i + 1)
   SELECT s AS o_orderpriority, day, round(x, 4) AS smooth FROM k WHERE i > 0""")
def _(t):
    thousands = daily(t).withColumn("z", F.col("close") / 1000)
    return _round(fc.kalman_smooth(thousands, "z", "day", BY), "smooth", 4).select(BY, "day", "smooth")


@query("kalman_lag_forecast")
def _(t):
    rows = cut_lineage(split_daily(t).withColumn("z", F.col("close") / 1000))
    return ev.rmse(fc.kalman_lag_forecast(rows, "z", 120, "day", "is_test", BY), "z", "prediction", BY)


@query("to_price", f"""WITH {DAILY} SELECT o_orderpriority, round(exp(avg(x)), 3) AS price, round(exp(avg(x) - var_pop(x)), 3) AS low_price
   FROM daily GROUP BY 1""")
def _(t):
    sums = daily(t).groupBy(BY).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return sums.select(BY, F.round(rl.to_price(F.col("m")), 3).alias("price"),
                       F.round(rl.to_price(F.col("m"), F.col("v")), 3).alias("low_price"))
