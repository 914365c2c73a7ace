"""Poisson log-linear trend per locality, fitted inside the JVM.

Each locality's rows are first added up by year, so the array a series is folded into has one entry
per year; a longer one than ``MOST_YEARS`` raises. Newton steps then run as array folds on that entry;
no Python worker, no shuffle per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions.numeric import cagr_pct, let, ratio, two_sided_p
from placetrend.operators.panel import KEY, VALUE, YEAR

#: Bound on the years of a series.
MOST_YEARS = 1000
#: Steps of a fit that may be Newton's, and then halvings of the bracket, enough for any bracket below a
#: thousand to close to ``SETTLED``. Nearly all series are done after six.
NEWTON_STEPS, HALVINGS = 40, 64
#: A fit is settled when a step moves it by less than this share of it.
SETTLED = 1e-11


def _zeros(*names: str) -> Column:
    return F.struct(*[F.lit(0.0).alias(n) for n in names])


def _weights(points: Column, rate: Column, span: Column) -> Column:
    """Sums of e^(rate d), d e^(rate d) and d^2 e^(rate d) over the points, scaled so that none overflows."""
    top = F.greatest(F.lit(0.0), rate * span)

    def gather(s: Column, p: Column) -> Column:
        d = p["d"]
        w = F.exp(rate * d - top)
        return F.struct((s["s0"] + w).alias("s0"), (s["s1"] + d * w).alias("s1"), (s["s2"] + d * d * w).alias("s2"))

    return F.aggregate(points, _zeros("s0", "s1", "s2"), gather)


def _fit(points: Column, span: Column) -> Column:
    """``rate``: the trend along ``d``, the distance of a year from the end that most of the counts are near.

    For a given rate the best level makes the fitted counts add up to the true ones. What is left is one
    equation: the mean distance under weights e^(rate d) is that under the counts. Its left side grows
    with the rate, from zero to ``span``, so there is one root whenever the counts are not all at an end,
    and bounds on it are known: at the lower the weights of all other years together are too small, at
    the upper they are too large. Newton steps inside the bracket find it, and halvings where they do not
    close in fast.
    """
    totals = F.aggregate(
        points, _zeros("y", "dy"), lambda s, p: F.struct((s["y"] + p["y"]).alias("y"), (s["dy"] + p["d"] * p["y"]).alias("dy"))
    )
    others = F.size(points) - 1

    def solve(t: Column) -> Column:
        target = ratio(t["dy"], t["y"])
        low = F.least(F.lit(0.0), F.ln(ratio(target, others * span)))
        high = F.ln(2.0 * others)
        start = F.struct(low.alias("low"), high.alias("high"), F.lit(0.0).alias("rate"), (high - low).alias("step"))

        def move(fit: Column, k: Column) -> Column:
            def judge(w: Column) -> Column:
                mean = ratio(w["s1"], w["s0"])
                spread = ratio(w["s2"], w["s0"]) - mean * mean
                miss = target - mean
                low = F.when(miss > 0, fit["rate"]).otherwise(fit["low"])
                high = F.when(miss > 0, fit["high"]).otherwise(fit["rate"])
                newton = F.when(spread > 0, miss / spread)
                there = fit["rate"] + newton
                fast = (k <= NEWTON_STEPS) & (F.abs(newton) * 2 <= F.abs(fit["step"])) & (there > low) & (there < high)
                step = F.when(miss == 0, F.lit(0.0)).when(fast, newton).otherwise((low + high) / 2 - fit["rate"])
                return let(
                    F.struct(low.alias("low"), high.alias("high"), step.alias("step")),
                    lambda m: F.struct(
                        m["low"].alias("low"), m["high"].alias("high"), (fit["rate"] + m["step"]).alias("rate"), m["step"].alias("step")
                    ),
                )

            return let(_weights(points, fit["rate"], span), judge)

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(NEWTON_STEPS + HALVINGS)),
            start,
            lambda fit, k: F.when(F.abs(fit["step"]) > SETTLED * (1.0 + F.abs(fit["rate"])), move(fit, k)).otherwise(fit),
            lambda fit: F.struct(F.when(target.isNotNull(), fit["rate"]).alias("rate"), F.ln(t["y"]).alias("level")),
        )

    return let(totals, solve)


def _with_fit(points: Column, fit: Column, span: Column) -> Column:
    """Points with their fitted mean and its logarithm."""

    def placed(w: Column) -> Column:
        top = F.greatest(F.lit(0.0), fit["rate"] * span)
        base = fit["level"] - F.ln(w["s0"]) - top

        def one(p: Column) -> Column:
            log_mu = base + fit["rate"] * p["d"]
            return F.struct(p["x"].alias("x"), p["y"].alias("y"), F.exp(log_mu).alias("mu"), log_mu.alias("log_mu"))

        return F.transform(points, one)

    return let(_weights(points, fit["rate"], span), placed)


def _quality(fitted: Column, trend: Column, mean: Column) -> Column:
    """Explained share of the deviance and the z statistic of the trend.

    The error of the trend is the robust one: information A, squared scores C, A^-1 C A^-1.
    """

    def part(y: Column, mu: Column, log_mu: Column) -> Column:
        return 2 * (F.when(y > 0, y * (F.ln(y) - log_mu)).otherwise(F.lit(0.0)) - (y - mu))

    def gather(s: Column, p: Column) -> Column:
        x, y, mu = p["x"], p["y"], p["mu"]
        square = (y - mu) * (y - mu)
        return F.struct(
            (s["deviance"] + part(y, mu, p["log_mu"])).alias("deviance"),
            (s["null_deviance"] + part(y, mean, F.ln(mean))).alias("null_deviance"),
            (s["a0"] + mu).alias("a0"),
            (s["a1"] + x * mu).alias("a1"),
            (s["a2"] + x * x * mu).alias("a2"),
            (s["c0"] + square).alias("c0"),
            (s["c1"] + x * square).alias("c1"),
            (s["c2"] + x * x * square).alias("c2"),
        )

    def judge(s: Column) -> Column:
        a0, a1, a2 = s["a0"], s["a1"], s["a2"]
        spread = a1 * a1 * s["c0"] - 2 * a0 * a1 * s["c1"] + a0 * a0 * s["c2"]
        error = ratio(F.sqrt(F.greatest(spread, F.lit(0.0))), F.abs(a0 * a2 - a1 * a1))
        unexplained = ratio(s["deviance"], s["null_deviance"])
        return F.struct(
            F.when(s["null_deviance"] > 0, F.least(F.greatest(F.lit(0.0), 1 - unexplained), F.lit(1.0)))
            .otherwise(F.lit(0.0))
            .alias("explained"),
            ratio(trend, error).alias("z"),
        )

    names = ("deviance", "null_deviance", "a0", "a1", "a2", "c0", "c1", "c2")
    return F.aggregate(fitted, _zeros(*names), gather, judge)


def _report(s: Column, year: str) -> Column:
    """Trend report of one folded series."""
    length = (s["last_year"] - s["first_year"]).cast("double")
    # distances are counted from the end that most of the counts are near: small sums keep their digits
    late = F.aggregate(s["series"], F.lit(0.0), lambda t, p: t + (2 * p[year] - s["first_year"] - s["last_year"]) * p["y"]) > 0
    sign = F.when(late, F.lit(-1.0)).otherwise(F.lit(1.0))
    points = F.transform(
        s["series"],
        lambda p: F.struct(
            (p[year] - s["mid"]).alias("x"),
            p["y"].alias("y"),
            F.when(late, s["last_year"] - p[year]).otherwise(p[year] - s["first_year"]).cast("double").alias("d"),
        ),
    )
    first, last = s["series"][0]["y"], F.element_at(s["series"], -1)["y"]
    span = s["last_year"] - s["first_year"]
    constant = F.struct(
        F.lit("constant").alias("status"),
        F.lit(0.0).alias("growth"),
        F.when((first > 0) & (span > 0), F.lit(0.0)).alias("cagr"),
        F.lit(1.0).alias("p_value"),
        F.lit(0.0).alias("explained"),
    )

    def fitted(points: Column, fit: Column) -> Column:
        trend = sign * fit["rate"]
        ok = trend.isNotNull()
        quality = F.when(ok, _quality(_with_fit(points, fit, length), trend, s["mean"]))
        return let(
            quality,
            lambda q: F.struct(
                F.when(ok, F.lit("ok")).otherwise(F.lit("not_converged")).alias("status"),
                ((F.exp(trend) - 1) * 100).alias("growth"),
                cagr_pct(first, last, span).alias("cagr"),
                F.when(ok, F.coalesce(two_sided_p(q["z"]), F.lit(0.0))).alias("p_value"),
                F.coalesce(q["explained"], F.lit(0.0)).alias("explained"),
            ),
        )

    positive = F.size(F.filter(s["series"], lambda p: p["y"] > 0))
    unbounded = F.struct(
        F.lit("not_converged").alias("status"),
        F.lit(None).cast("double").alias("growth"),
        cagr_pct(first, last, span).alias("cagr"),
        F.lit(None).cast("double").alias("p_value"),
        F.lit(0.0).alias("explained"),
    )
    moving = let(points, lambda pts: let(_fit(pts, length), lambda fit: fitted(pts, fit)))
    return (
        F.when(s["low"] == s["high"], constant)
        .when((positive == 1) & ((first > 0) | (last > 0)), unbounded)
        .otherwise(moving)
    )


def poisson_trend(
    panel: DataFrame,
    value: str = VALUE,
    key: str = KEY,
    year: str = YEAR,
) -> DataFrame:
    """Growth per year from a Poisson fit on the centred year, with its quality.

    All years count; which ones a job looks at is the job's filter. Several rows of one year are added
    up, and a sum with an unknown part is unknown.

    A constant series has growth 0 and p-value 1. The likelihood has no finite maximum exactly when
    all counts but that of an end year are zero; such a series is ``not_converged``, without score.

    The report is an output of the aggregate itself, so a later filter on it cannot be pushed
    below and make the fit run twice.
    """
    known = F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(value).cast("double")))
    yearly = panel.groupBy(key, year).agg(known.alias(value))
    number = F.col(value)
    entries = F.array_sort(F.collect_list(F.struct(F.col(year), number.alias("y"))))
    too_long = F.raise_error(F.lit(f"a series has more than {MOST_YEARS} years")).cast(f"array<struct<{year}:int,y:double>>")
    folded = F.struct(
        F.when(F.count(F.lit(1)) <= MOST_YEARS, entries).otherwise(too_long).alias("series"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.avg(year).alias("mid"),
        F.avg(number).alias("mean"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
    )
    fitted = (
        yearly.groupBy(key)
        .agg(
            F.concat_ws("-", F.min(year), F.max(year)).alias("years_covered"),
            F.count(F.lit(1)).alias("n_obs"),
            let(folded, lambda s: _report(s, year)).alias("_r"),
        )
    )
    return fitted.select(
        key,
        "years_covered",
        "n_obs",
        F.col("_r.growth").alias("annual_growth_pct_poisson"),
        F.col("_r.cagr").alias("cagr_pct"),
        F.col("_r.p_value").alias("p_value_year"),
        F.col("_r.explained").alias("deviance_explained"),
        F.col("_r.status").alias("fit_status"),
        (F.col("_r.growth") * F.col("_r.explained")).alias("trend_score"),
    )


def significant(trends: DataFrame, level: float = fv.SIGNIFICANCE_LEVEL) -> DataFrame:
    return trends.where(F.col("p_value_year") < level)


def fit_failures(trends: DataFrame) -> DataFrame:
    return trends.where(F.col("fit_status") == "not_converged")
