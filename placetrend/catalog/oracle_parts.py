"""SQL for the methods that several queries share, as CTE lists around a source CTE."""

from __future__ import annotations

# The check fits both coefficients by damped Newton steps, another way than the engine's; its constants are
# its own.
MAX_STEPS, STEP_LIMIT, TOLERANCE = 60, 1.0, 1e-7


def filled(src: str, value: str, out: str, last_year: int) -> str:
    """``out``_i: gaps filled; ``out``_c: open ends and stale series removed."""
    back = "PARTITION BY locality ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ahead = "PARTITION BY locality ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""{out}_n AS (
  SELECT locality, year, CAST({value} AS DOUBLE) AS v,
         row_number() OVER (PARTITION BY locality ORDER BY year) AS rn FROM {src}),
{out}_f AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN rn END AS pos FROM {out}_n),
{out}_b AS (
  SELECT *, last_value(v IGNORE NULLS) OVER ({back}) AS lo, last_value(pos IGNORE NULLS) OVER ({back}) AS rlo,
         first_value(v IGNORE NULLS) OVER ({ahead}) AS hi, first_value(pos IGNORE NULLS) OVER ({ahead}) AS rhi
  FROM {out}_f),
{out}_i AS (
  SELECT locality, year, coalesce(v, lo + (hi - lo) * (rn - rlo) / nullif(rhi - rlo, 0)) AS v FROM {out}_b),
{out}_c AS (
  SELECT * FROM {out}_i WHERE v IS NOT NULL
  QUALIFY max(year) OVER (PARTITION BY locality) >= {last_year})"""


def bayes(src: str, value: str, out: str, last_year: int) -> str:
    """Third-sector score of one measure as ``out``(locality, trend_score)."""
    return f"""{filled(src, value, out, last_year)},
{out}_g AS (
  SELECT locality, year, (v - p) / nullif(p, 0) AS growth
  FROM (SELECT *, lag(v) OVER (PARTITION BY locality ORDER BY year) AS p,
               min(year) OVER (PARTITION BY locality) AS y0 FROM {out}_c)
  WHERE year > y0),
{out}_w AS (
  SELECT *, exp(-0.4 * (max(year) OVER (PARTITION BY locality) - year)) AS w FROM {out}_g),
{out}_m AS (
  SELECT locality, sum(w) AS weight_sum, sum(w * growth) / sum(w) AS raw_score FROM {out}_w GROUP BY 1),
{out} AS (
  SELECT locality, (raw_score * weight_sum + (SELECT avg(raw_score) FROM {out}_m) * 3.0)
         / (weight_sum + 3.0) AS trend_score FROM {out}_m)"""


def features(src: str, out: str) -> str:
    """Nine series features of (locality, year, value) without missing values."""
    return f"""{out}_r AS (
  SELECT locality, year, value,
         row_number() OVER (PARTITION BY locality ORDER BY year) AS a,
         row_number() OVER (PARTITION BY locality ORDER BY year DESC) AS b,
         count(*) OVER (PARTITION BY locality) AS n
  FROM {src}),
{out} AS (
  SELECT locality, max(n) AS n_obs,
         CASE WHEN max(n) > 1 THEN regr_slope(value, year) ELSE 0 END AS slope,
         CASE WHEN max(n) > 1 THEN arg_max(value, year) - arg_min(value, year) ELSE 0 END AS croissance_totale,
         CASE WHEN max(n) > 1 THEN 100.0 * (arg_max(value, year) - arg_min(value, year))
              / (arg_min(value, year) + 1) ELSE 0 END AS taux_croissance,
         CASE WHEN max(n) >= 6 THEN avg(value) FILTER (WHERE b <= 3) - avg(value) FILTER (WHERE a <= 3)
              ELSE 0 END AS acceleration,
         CAST(sum(value) AS BIGINT) AS total_logements, avg(value) AS avg_logements,
         stddev_pop(value) AS volatilite,
         CASE WHEN max(n) >= 5 THEN regr_slope(value, year) FILTER (WHERE b <= 5)
              WHEN max(n) > 1 THEN regr_slope(value, year) ELSE 0 END AS recent_slope,
         max(value) AS max_logements
  FROM {out}_r GROUP BY 1)"""


def momentum(src: str, out: str) -> str:
    names = ("slope", "acceleration", "recent_slope", "taux_croissance", "max_logements")
    scaled = ",\n         ".join(
        f"coalesce(100.0 * ({n} - min({n}) OVER ()) / nullif(max({n}) OVER () - min({n}) OVER (), 0), 0) AS {n}_scaled"
        for n in names
    )
    return f"""{out}_s AS (SELECT locality, {scaled} FROM {src}),
{out}_m AS (SELECT *, recent_slope_scaled - slope_scaled AS momentum FROM {out}_s),
{out} AS (
  SELECT *, coalesce(100.0 * (momentum - min(momentum) OVER ())
         / nullif(max(momentum) OVER () - min(momentum) OVER (), 0), 0) AS momentum_scaled FROM {out}_m)"""


def building(src: str, out: str) -> str:
    return f"""{features(src, out + "_ft")},
{momentum(out + "_ft", out + "_mo")},
{out} AS (
  SELECT locality, 0.40 * acceleration_scaled + 0.30 * momentum_scaled + 0.20 * recent_slope_scaled
         + 0.10 * taux_croissance_scaled AS trend_score FROM {out}_mo)"""


SLOPES = (
    ("slope_jeunes_actifs", "jeunes_actifs_20_34", 0.40),
    ("slope_actifs_35_49", "actifs_35_49", 0.30),
    ("slope_pop_totale", "total", 0.15),
    ("slope_enfants", "enfants_0_19", 0.10),
    ("slope_seniors", "seniors_50_plus", 0.05),
)


def slopes(src: str, out: str) -> str:
    columns = ",\n         ".join(
        f"CASE WHEN count(DISTINCT year) = 1 THEN 0 ELSE regr_slope({m}, year) END AS {name}" for name, m, _ in SLOPES
    )
    return f"{out} AS (SELECT locality, count(*) AS n_rows, {columns} FROM {src} GROUP BY 1)"


def demography(src: str, out: str) -> str:
    raw = " + ".join(
        f"{w} * coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0), 0)" for n, _, w in SLOPES
    )
    return f"""{slopes(src, out + "_sl")},
{out}_raw AS (SELECT locality, {raw} AS raw FROM {out}_sl WHERE n_rows >= 5),
{out} AS (
  SELECT locality, 100.0 * (raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0) AS trend_score
  FROM {out}_raw)"""


def normal_p(z: str) -> str:
    a = f"abs({z})"
    top = "0.0352624965998911"
    for c in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871",
              "221.213596169931", "220.206867912376"):
        top = f"({top} * {a} + {c})"
    bottom = "0.0883883476483184"
    for c in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674",
              "637.333633378831", "793.826512519948", "440.413735824752"):
        bottom = f"({bottom} * {a} + {c})"
    far = f"1.0 / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) / 2.5066282746310002"
    return f"2 * exp(-{a} * {a} / 2) * CASE WHEN {a} < 7.07106781186547 THEN {top} / {bottom} ELSE {far} END"


def poisson(src: str, value: str, out: str) -> str:
    """Poisson trend report of (locality, year, value) as ``out``."""
    return f"""{out}_s AS (
  SELECT locality, year, CAST({value} AS DOUBLE) AS y, year - avg(year) OVER (PARTITION BY locality) AS x
  FROM {src}),
{out}_h AS (
  SELECT locality, count(*) AS n_obs, min(year) AS y0, max(year) AS y1, avg(y) AS m,
         arg_min(y, year) AS fv, arg_max(y, year) AS lv, min(y) = max(y) AS flat,
         count(*) FILTER (WHERE y > 0) = 1 AND (arg_min(y, year) > 0 OR arg_max(y, year) > 0) AS endless
  FROM {out}_s GROUP BY 1),
{out}_k(locality, i, b0, b1, moved) AS (
  SELECT locality, 0, ln(m), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM {out}_h WHERE NOT flat AND NOT endless
  UNION ALL
  SELECT locality, i + 1, b0 + d0, b1 + d1, abs(d0) + abs(d1)
  FROM (
    SELECT locality, i, b0, b1,
           greatest(-{STEP_LIMIT}, least({STEP_LIMIT}, (s2 * g0 - s1 * g1) / nullif(s0 * s2 - s1 * s1, 0))) AS d0,
           greatest(-{STEP_LIMIT}, least({STEP_LIMIT}, (s0 * g1 - s1 * g0) / nullif(s0 * s2 - s1 * s1, 0))) AS d1
    FROM (
      SELECT locality, i, b0, b1, sum(mu) AS s0, sum(x * mu) AS s1, sum(x * x * mu) AS s2,
             sum(y - mu) AS g0, sum(x * (y - mu)) AS g1
      FROM (SELECT k.locality, k.i, k.b0, k.b1, s.x, s.y, exp(k.b0 + k.b1 * s.x) AS mu
            FROM {out}_k k JOIN {out}_s s ON k.locality = s.locality
            WHERE k.i < {MAX_STEPS} AND k.moved > {TOLERANCE})
      GROUP BY 1, 2, 3, 4))),
{out}_e AS (
  SELECT locality, arg_max(b0, i) AS b0, arg_max(b1, i) AS b1, arg_max(moved, i) <= {TOLERANCE} AS ok
  FROM {out}_k GROUP BY 1),
{out}_q AS (
  SELECT locality, sum(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))) AS dev,
         sum(2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))) AS nul,
         sum(mu) AS a0, sum(x * mu) AS a1, sum(x * x * mu) AS a2,
         sum((y - mu) ** 2) AS c0, sum(x * (y - mu) ** 2) AS c1, sum(x * x * (y - mu) ** 2) AS c2
  FROM (SELECT s.locality, s.x, s.y, h.m, exp(e.b0 + e.b1 * s.x) AS mu
        FROM {out}_s s JOIN {out}_e e USING (locality) JOIN {out}_h h USING (locality) WHERE e.ok)
  GROUP BY 1),
{out}_z AS (
  SELECT h.*, e.b1, coalesce(e.ok, FALSE) AS ok, q.dev, q.nul,
         e.b1 / nullif(sqrt(greatest(0, (a1 * a1 * c0 - 2 * a0 * a1 * c1 + a0 * a0 * c2)
                / nullif((a0 * a2 - a1 * a1) ** 2, 0))), 0) AS z
  FROM {out}_h h LEFT JOIN {out}_e e USING (locality) LEFT JOIN {out}_q q USING (locality)),
{out} AS (
  SELECT locality, CAST(y0 AS VARCHAR) || '-' || CAST(y1 AS VARCHAR) AS years_covered, n_obs,
         annual_growth_pct_poisson, cagr_pct, p_value_year, deviance_explained, fit_status,
         annual_growth_pct_poisson * deviance_explained AS trend_score
  FROM (
    SELECT *,
           CASE WHEN flat THEN 0 WHEN ok THEN (exp(b1) - 1) * 100 END AS annual_growth_pct_poisson,
           CASE WHEN flat THEN CASE WHEN fv > 0 THEN 0 END
                WHEN fv > 0 THEN ((lv / fv) ** (1.0 / (y1 - y0)) - 1) * 100 END AS cagr_pct,
           CASE WHEN flat THEN 1 WHEN ok THEN coalesce({normal_p("z")}, 0) END AS p_value_year,
           CASE WHEN ok AND nul > 0 THEN greatest(0, 1 - dev / nul) ELSE 0 END AS deviance_explained,
           CASE WHEN flat THEN 'constant' WHEN ok THEN 'ok' ELSE 'not_converged' END AS fit_status
    FROM {out}_z))"""


def sign_scale(src: str, out: str, column: str = "trend_score") -> str:
    c = column
    return f"""{out} AS (
  SELECT locality, CASE WHEN {c} > 0 THEN 10 * {c} / max({c}) FILTER (WHERE {c} > 0) OVER ()
                        WHEN {c} < 0 THEN -10 * {c} / min({c}) FILTER (WHERE {c} < 0) OVER ()
                        ELSE {c} END AS {c}
  FROM {src})"""
