"""Panels, trend statistics, scaling and fusion: fixtures, properties, cross-checks."""

from __future__ import annotations

import math
import re
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.operators import fuse, panel, poisson, profile, scale, trend
from placetrend.plans import building, composite, demography, restaurants, third_sector
from placetrend.storage import stored_by_key
from tests.helpers import by_key, frame, plan_of, table

PANEL = "locality string, year int, value bigint"
SOME = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def series(spark, **values):
    """Locality -> [(year, value), ...]"""
    return frame(spark, PANEL, [(k, y, v) for k, pairs in values.items() for y, v in pairs])


# --- panels -----------------------------------------------------------------------------------------


def test_duplicates_are_added_up_or_rejected(spark):
    df = frame(spark, PANEL, [("a", 2020, 1), ("a", 2020, 2), ("a", 2021, None), ("a", 2021, 5), (None, 2020, 9)])
    assert table(panel.to_panel(df, rows="n")) == [("a", 2020, 3, 2), ("a", 2021, None, 2)]
    with pytest.raises(PySparkException, match="more than one row"):
        panel.to_panel(df, duplicates="reject").collect()
    with pytest.raises(ValueError):
        panel.to_panel(df, duplicates="first")


def test_gaps(spark):
    df = series(spark, a=[(2011, None), (2012, 1), (2013, None), (2015, None), (2016, 4), (2017, None)], b=[(2011, None)])
    got = {(r.locality, r.year): r.value for r in panel.interpolate_gaps(df).collect()}
    assert [got["a", y] for y in (2011, 2012, 2013, 2015, 2016, 2017)] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert got["b", 2011] is None


@SOME
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=12))
def test_interpolation_equals_numpy(spark, values):
    df = series(spark, a=[(2000 + 2 * i, v) for i, v in enumerate(values)])
    got = [r.value for r in panel.interpolate_gaps(df).orderBy("year").collect()]
    known = [i for i, v in enumerate(values) if v is not None]
    for i, v in enumerate(values):
        if v is not None:
            assert got[i] == v
        elif known and known[0] < i < known[-1]:
            assert got[i] == pytest.approx(np.interp(i, known, [values[k] for k in known]))
        else:
            assert got[i] is None


def test_row_and_year_gates(spark):
    rows = [(k, 2000 + i, 1) for k, n in (("two", 2), ("three", 3), ("four", 4), ("five", 5)) for i in range(n)]
    rows += [("dup", 2000 + i % 2, 1) for i in range(5)]
    counted = panel.to_panel(frame(spark, PANEL, rows), rows="n")
    kept = lambda df: sorted({r.locality for r in df.collect()})
    assert kept(panel.min_rows_gate(counted, 5, "n")) == ["dup", "five"]
    assert kept(panel.min_years_gate(counted, 3)) == ["five", "four", "three"]
    assert table(panel.excluded_keys(counted, 3)) == [("dup", 2), ("two", 2)]
    assert kept(panel.recency_gate(counted, 2003)) == ["five", "four"]


def test_growth_is_over_the_previous_row(spark):
    df = series(spark, a=[(2010, 4), (2013, 6), (2014, 0), (2015, 5)])
    grown = panel.drop_first_obs(panel.yoy_growth(df))
    assert table(grown, "year", "growth") == [(2013, 0.5), (2014, -1.0), (2015, None)]


# --- slopes and features ------------------------------------------------------------------------------


def test_slopes(spark):
    df = frame(spark, PANEL, [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 1), ("b", 1, 9), ("c", 7, 3)])
    got = by_key(trend.ols_slopes(df, {"s": "value"}))
    assert [got[k].s for k in "abc"] == [pytest.approx(0.5), 0.0, 0.0]


def test_first_last_and_cagr(spark):
    df = series(spark, a=[(2011, 2), (2013, 8)], flat=[(2011, 4), (2012, 4)], zero=[(2011, 0), (2012, 0)], up=[(2011, 0), (2012, 3)])
    got = by_key(trend.first_last(df))
    assert got["a"].cagr_pct == pytest.approx(100.0)
    assert (got["flat"].cagr_pct, got["zero"].cagr_pct, got["up"].cagr_pct) == (0.0, None, None)
    assert (got["a"].years_covered, got["a"].absolute_change, got["a"].growth_pct) == ("2011-2013", 6, 200.0)


def numpy_features(years, values):
    y = np.array([np.nan if v is None else v for v in values], dtype=float)
    x = np.array(years, dtype=float)

    def fit(x, y):
        return np.nan if np.isnan(y).any() else np.polyfit(x - x.mean(), y, 1)[0]

    slope = fit(x, y) if len(x) > 1 else 0.0
    return {
        "slope": slope,
        "croissance_totale": y[-1] - y[0] if len(y) >= 2 else 0.0,
        "taux_croissance": (y[-1] - y[0]) / (y[0] + 1) * 100 if len(y) >= 2 else 0.0,
        "acceleration": np.mean(y[-3:]) - np.mean(y[:3]) if len(y) >= 6 else 0.0,
        "total_logements": np.sum(y),
        "avg_logements": np.mean(y),
        "volatilite": np.std(y),
        "recent_slope": fit(x[-5:], y[-5:]) if len(y) >= 5 else slope,
        "max_logements": np.max(y),
    }


def test_features_equal_numpy_also_with_missing_values(spark):
    rng = np.random.default_rng(5)
    data = {}
    for n in range(1, 12):
        for kind in ("full", "holes"):
            values = [int(v) for v in rng.integers(0, 30, n)]
            if kind == "holes":
                values[int(rng.integers(0, n))] = None
            data[f"{kind}{n}"] = [(2013 + i, v) for i, v in enumerate(values)]
    got = by_key(trend.trend_features(series(spark, **data)))
    for name, pairs in data.items():
        want = numpy_features(*zip(*pairs))
        if len(pairs) == 1:
            want["slope"] = want["recent_slope"] = None if pairs[0][1] is None else 0.0
        for feature, w in want.items():
            g = got[name][feature]
            if w is None or math.isnan(w):
                assert g is None, (name, feature)
            else:
                assert g == pytest.approx(w, abs=1e-9), (name, feature)


# --- Poisson ----------------------------------------------------------------------------------------


POIS = dict(
    a=[(2011, 3), (2012, 4), (2013, 6), (2014, 9)],
    b=[(2011, 5), (2012, 0), (2013, 2)],
    c=[(2011, 4), (2012, 4), (2013, 4)],
    d=[(2011, 0), (2012, 0), (2013, 0)],
    e=[(2011, 0), (2012, 0), (2013, 5)],
    f=[(2011, 0), (2012, 5), (2013, 0)],
)


def test_poisson_fixtures(spark):
    got = by_key(poisson.poisson_trend(series(spark, **POIS)))
    assert math.log(got["a"].annual_growth_pct_poisson / 100 + 1) == pytest.approx(0.378167, abs=1e-6)
    assert got["a"].annual_growth_pct_poisson == pytest.approx(45.960664, abs=1e-5)
    assert got["b"].annual_growth_pct_poisson == pytest.approx(-50.0)
    for flat in "cd":
        assert (got[flat].trend_score, got[flat].p_value_year, got[flat].fit_status) == (0.0, 1.0, "constant")
    assert (got["c"].cagr_pct, got["d"].cagr_pct) == (0.0, None)
    e = got["e"]
    assert (e.fit_status, e.trend_score, e.annual_growth_pct_poisson, e.deviance_explained) == ("not_converged", None, None, 0.0)
    assert (got["f"].fit_status, got["f"].annual_growth_pct_poisson) == ("ok", pytest.approx(0.0, abs=1e-9))
    assert got["a"].years_covered == "2011-2014"
    assert [r.locality for r in poisson.fit_failures(poisson.poisson_trend(series(spark, **POIS))).collect()] == ["e"]


def numpy_poisson(pdf: pd.DataFrame) -> dict:
    """Iteratively reweighted least squares with matrices, as an independent check."""
    pdf = pdf.sort_values("year")
    x, y = (pdf.year - pdf.year.mean()).to_numpy(float), pdf.value.to_numpy(float)
    design = np.column_stack([np.ones_like(x), x])
    mu = (y + y.mean()) / 2
    for _ in range(200):
        eta = np.log(mu)
        work = eta + (y - mu) / mu
        beta = np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (mu * work))
        mu = np.exp(design @ beta)
    bread = np.linalg.inv(design.T @ (design * mu[:, None]))
    cov = bread @ (design.T @ (design * ((y - mu) ** 2)[:, None])) @ bread
    z = beta[1] / math.sqrt(cov[1, 1])

    def deviance(m):
        return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - (y - m))

    explained = max(0.0, 1 - deviance(mu) / deviance(np.full_like(y, y.mean())))
    growth = (math.exp(beta[1]) - 1) * 100
    return {"growth": growth, "p": math.erfc(abs(z) / math.sqrt(2)), "explained": explained}


def test_poisson_equals_a_per_group_numpy_fit(spark):
    rng = np.random.default_rng(11)
    rows = [
        (f"s{i}", 2011 + int(t), int(rng.poisson(rng.uniform(1, 40))))
        for i in range(60)
        for t in rng.choice(15, size=int(rng.integers(3, 15)), replace=False)
    ]
    df = frame(spark, PANEL, rows)
    native = by_key(poisson.poisson_trend(df))

    def per_group(pdf):
        fit = numpy_poisson(pdf)
        return pd.DataFrame([{"locality": pdf.locality.iloc[0], **fit}])

    ok = [k for k, r in native.items() if r.fit_status == "ok"]
    assert len(ok) > 50
    checked = df.where(F.col("locality").isin(ok)).groupBy("locality").applyInPandas(
        per_group, "locality string, growth double, p double, explained double"
    )
    for r in checked.collect():
        n = native[r.locality]
        assert n.annual_growth_pct_poisson == pytest.approx(r.growth, rel=1e-6, abs=1e-7)
        assert n.p_value_year == pytest.approx(r.p, rel=1e-6, abs=1e-9)
        assert n.deviance_explained == pytest.approx(r.explained, rel=1e-6, abs=1e-8)


def test_restaurant_trend_merges_duplicates_and_gates(spark):
    counts = frame(
        spark,
        "` Locality` string, YEAR int, num_restaurants bigint",
        [("a", 2011, 1), ("a", 2011, 2), ("a", 2012, 4), ("a", 2013, 6), ("a", 2014, 9), ("a", 1999, 50),
         ("a", 2013, -1), ("b", 2011, 1), ("b", 2012, 3), (None, 2011, 1)],
    )
    report = restaurants.restaurant_trend(counts).collect()
    assert [r.locality for r in report] == ["a"]
    assert report[0].n_obs == 4
    assert report[0].annual_growth_pct_poisson == pytest.approx(45.960664, abs=1e-5)
    with pytest.raises(ValueError, match="num_restaurants"):
        restaurants.restaurant_trend(counts.withColumnRenamed("num_restaurants", "restaurant_count"))


def test_empty_inputs_give_empty_reports(spark):
    none = frame(spark, "locality string, year int, num_restaurants bigint", [])
    report = restaurants.restaurant_trend(none)
    assert report.columns == [
        "locality", "years_covered", "n_obs", "annual_growth_pct_poisson", "cagr_pct",
        "p_value_year", "deviance_explained", "trend_score",
    ]
    assert report.count() == 0
    rows = frame(spark, "locality string, year int, jobs bigint", [])
    assert third_sector.third_sector_score(rows, "jobs").count() == 0
    assert building.building_score(frame(spark, PANEL, [])).count() == 0


# --- scaling ----------------------------------------------------------------------------------------

SCORE = "locality string, trend_score double"


def scores(spark, values):
    return frame(spark, SCORE, [(f"k{i}", v) for i, v in enumerate(values)])


def scaled(spark, values):
    return [r.trend_score for r in scale.sign_preserving(scores(spark, values)).orderBy("locality").collect()]


def test_sign_scale_fixtures(spark):
    assert scaled(spark, [4.0, 2.0, 0.0, -3.0, -6.0, None]) == [10.0, 5.0, 0.0, -5.0, -10.0, None]
    assert scaled(spark, [4.0, 2.0, 0.0]) == [10.0, 5.0, 0.0]
    assert scaled(spark, [0.0, None]) == [0.0, None]


@SOME
@given(st.lists(st.floats(-1e6, 1e6).filter(lambda v: v == 0 or abs(v) > 1e-6), min_size=1, max_size=9))
def test_sign_scale_keeps_sign_and_order_and_is_idempotent(spark, values):
    once = scaled(spark, values)
    assert [np.sign(a) for a in once] == [np.sign(v) for v in values]
    order = sorted(range(len(values)), key=lambda i: values[i])
    assert all(once[a] <= once[b] for a, b in zip(order, order[1:]))
    assert all(-10 - 1e-9 <= v <= 10 + 1e-9 for v in once)
    assert scaled(spark, once) == pytest.approx(once)


def test_flat_columns(spark):
    flat = scores(spark, [3.0, 3.0, None])
    z = scale.zscore(flat, ["trend_score"]).orderBy("locality").collect()
    assert [r.trend_score_norm for r in z] == [0.0, 0.0, None]
    for level in (None, 0.0):
        got = scale.minmax(flat, {"s": "trend_score"}, flat=level).orderBy("locality").collect()
        assert [r.s for r in got] == [level, level, None]


def test_zscore_uses_the_population_deviation(spark):
    got = [r.trend_score_norm for r in scale.zscore(scores(spark, [1.0, 3.0]), ["trend_score"]).orderBy("locality").collect()]
    assert got == [-1.0, 1.0]


def test_shrinkage_fixture(spark):
    growth = frame(spark, "locality string, year int, growth double", [("a", 2020, 0.1), ("b", 2020, 0.3)])
    got = by_key(third_sector.bayes_score(growth))
    assert got["a"].trend_score == pytest.approx(0.175)
    assert got["b"].trend_score == pytest.approx(0.225)


def test_shrunk_scores_lie_between_own_and_overall_mean(spark):
    rng = np.random.default_rng(3)
    growth = frame(
        spark, "locality string, year int, growth double",
        [(f"k{i}", 2010 + t, float(rng.normal())) for i in range(12) for t in range(1 + i)],
    )
    weighted = panel.with_group_extremes(growth).withColumn("w", F.exp(-0.4 * (F.col("max_year") - F.col("year"))))
    means = by_key(trend.weighted_mean(weighted, "growth", "w"))
    overall = np.mean([m.raw_score for m in means.values()])
    for k, r in by_key(third_sector.bayes_score(growth)).items():
        low, high = sorted((means[k].raw_score, overall))
        assert low - 1e-12 <= r.trend_score <= high + 1e-12


# --- jobs -------------------------------------------------------------------------------------------


def test_third_sector_chain_by_hand(spark):
    raw = frame(
        spark,
        "`Année` int, `Commune` string, `Secteur économique` string, `Etablissements` string, `Emplois` string",
        [
            (2021, "1 Aa", "Secteur tertiaire", "5", "10"), (2022, "1 Aa", "Secteur tertiaire", "5", "X"),
            (2023, "1 Aa", "Secteur tertiaire", "5", "30"), (2023, "1 Aa", "Secteur primaire", "5", "99"),
            (2021, "2 Bb", "Secteur tertiaire", "5", "0"), (2022, "2 Bb", "Secteur tertiaire", "5", "8"),
            (2023, "2 Bb", "Secteur tertiaire", "5", "4"), (2022, "3 Old", "Secteur tertiaire", "5", "4"),
            (2023, "Suisse", "Secteur tertiaire", "5", "4"), (2023, "1 Aa", "Secteur - total", "5", "4"),
        ],
    )
    rows = third_sector.third_sector_rows(raw)
    growth = third_sector.growth_panel(third_sector.filled_panel(rows, "jobs"), "jobs")
    assert table(growth, "locality", "year", "growth") == [("Aa", 2022, 1.0), ("Aa", 2023, 0.5), ("Bb", 2023, -0.5)]
    w = math.exp(-0.4)
    raw_a, weight_a = (w * 1.0 + 0.5) / (w + 1), w + 1
    overall = (raw_a - 0.5) / 2
    got = third_sector.ranked_third_sector(raw, "jobs").collect()
    assert [r.locality for r in got] == ["Aa", "Bb"]
    assert got[0].trend_score == pytest.approx((raw_a * weight_a + overall * 3) / (weight_a + 3))
    assert got[1].trend_score == pytest.approx((-0.5 + overall * 3) / 4)


def test_demography_against_numpy(spark):
    rng = np.random.default_rng(7)
    names = ["Âge - total", *fv.AGE_SEGMENTS]
    rows = [
        (y, f"k{i}", *[int(v) for v in rng.integers(50, 900, 5)])
        for i in range(8)
        for y in range(2024 - (3 if i == 0 else 6), 2025)
        if not (i == 1 and y == 2024)
    ]
    schema = "year int, locality string, " + ", ".join(f"`{n}` bigint" for n in names)
    detail = by_key(demography.demography_detail(frame(spark, schema, rows)))
    assert "k0" not in detail and len(detail) == 7
    pdf = pd.DataFrame(rows, columns=["year", "locality", *names])
    slopes = pd.DataFrame(
        {
            k: {out: np.polyfit(g.year - g.year.mean(), g[m], 1)[0] for out, m in demography.SLOPE_OF.items()}
            for k, g in pdf.groupby("locality")
            if k != "k0"
        }
    ).T
    z = (slopes - slopes.mean()) / slopes.std(ddof=0)
    raw = sum(z[c] * w for c, w in fv.DEMOGRAPHY_WEIGHTS.items())
    want = (raw - raw.min()) / (raw.max() - raw.min()) * 100
    for k, r in detail.items():
        assert r.trend_score == pytest.approx(want[k], abs=1e-7)
    last = pdf[(pdf.locality == "k2") & (pdf.year == 2024)].iloc[0]
    assert detail["k2"].pop_totale_2024 == last["Âge - total"]
    share = (last["jeunes_actifs_20_34"] + last["actifs_35_49"]) / last["Âge - total"] * 100
    assert detail["k2"].ratio_attractivite_2024 == pytest.approx(share)
    assert detail["k1"].pop_totale_2024 is None


def test_building_weights_and_flat_features(spark):
    df = series(spark, a=[(2013 + i, i) for i in range(7)], b=[(2013 + i, 6 - i) for i in range(7)])
    got = by_key(building.building_score(df))
    # both slopes are constant over time, so momentum is flat and counts 0
    assert got["a"].trend_score == pytest.approx(40 + 20 + 10)
    assert got["b"].trend_score == pytest.approx(0.0)


def five_tables(spark):
    shared = {n: [("both", float(i + 1)), (f"only{i}", -1.0), (None, 2.0)] for i, n in enumerate(fv.COMPOSITE_SCORES)}
    return {n: frame(spark, SCORE, rows) for n, rows in shared.items()}


def test_chain_and_one_shuffle_fusion_agree_also_on_null_keys(spark):
    tables = five_tables(spark)
    chain = fuse.full_outer_chain(tables).select("locality", *fv.COMPOSITE_SCORES)
    stacked = fuse.fuse_scores(tables).select("locality", *fv.COMPOSITE_SCORES)
    assert chain.count() == 1 + 5 + 5
    assert chain.exceptAll(stacked).count() == 0 and stacked.exceptAll(chain).count() == 0


def test_repeated_keys_are_not_lost_silently(spark):
    tables = {"x": frame(spark, SCORE, [("a", 1.0), ("a", 2.0)]), "y": frame(spark, SCORE, [("a", 3.0)])}
    with pytest.raises(PySparkException, match="more than one x"):
        fuse.fuse_scores(tables).collect()
    assert table(fuse.full_outer_chain(tables)) == [("a", 1.0, 3.0), ("a", 2.0, 3.0)]
    keyless = {"x": frame(spark, SCORE, [(None, 1.0), (None, 2.0)]), "y": frame(spark, SCORE, [(None, 3.0)])}
    want = [(None, 1.0, None), (None, 2.0, None), (None, None, 3.0)]
    assert table(fuse.fuse_scores(keyless)) == table(fuse.full_outer_chain(keyless)) == want


@SOME
@given(
    st.lists(
        st.dictionaries(st.sampled_from("abcdef"), st.floats(-9, 9), max_size=6), min_size=2, max_size=3
    )
)
def test_fusion_forms_agree(spark, drawn):
    tables = {f"t{i}": frame(spark, SCORE, d.items()) for i, d in enumerate(drawn)}
    names = list(tables)
    assert table(fuse.full_outer_chain(tables), "locality", *names) == table(fuse.fuse_scores(tables), "locality", *names)


@SOME
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=9))
def test_minmax_stays_in_range(spark, values):
    got = [r.s for r in scale.minmax(scores(spark, values), {"s": "trend_score"}, flat=0.0).collect()]
    assert sum(v is None for v in got) == sum(v is None for v in values)
    assert all(-1e-9 <= v <= 100 + 1e-9 for v in got if v is not None)


def test_composite(spark):
    for write_first in (True, False):
        final = composite.composite_score(five_tables(spark), write_first=write_first)
        assert final.columns == ["commune", *fv.COMPOSITE_SCORES, "total"]
        rows = final.collect()
        totals = [r.total for r in rows]
        assert totals == sorted(totals, reverse=True)
        # 'both' is 1..5 against 2.0 from the keyless row of each table
        best = rows[0]
        assert best.commune == "both" and best.total == pytest.approx(5 + 10 + 10 + 10 + 10)
        assert sum(r.total == pytest.approx(-10.0) for r in rows) == 5
    with pytest.raises(ValueError, match="restau_score"):
        composite.composite_score({k: v for k, v in five_tables(spark).items() if k != "restau_score"})


def test_read_scores_skips_bad_files_and_cleans_numbers(spark, tmp_path):
    (tmp_path / "good.csv").write_text("locality,trend_score\nAa,1.5\nBb,NaN\nCc,abc\nDd,\n")
    (tmp_path / "bad.csv").write_text("nom_commune,trend_score\nAa,1\n")
    got = composite.read_scores(spark, {"good": str(tmp_path / "good.csv"), "bad": str(tmp_path / "bad.csv")})
    assert list(got) == ["good"]
    assert table(got["good"]) == [("Aa", 1.5), ("Bb", None), ("Cc", None), ("Dd", None)]


def test_no_usable_score_table_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("nom_commune,trend_score\nAa,1\n")
    with pytest.raises(ValueError, match="no score table"):
        composite.normalised_scores(composite.read_scores(spark, {"bad": str(tmp_path / "bad.csv")}))


def test_anti_join_null_keys(spark):
    df = frame(spark, SCORE, [("a", 1.0), ("b", 2.0), (None, 3.0)])
    keys = frame(spark, "locality string", [("a",), (None,)])
    assert table(fuse.anti_join_keys(df, keys)) == [("b", 2.0)]
    assert table(fuse.anti_join_keys(df, keys, keep_null=True)) == [("b", 2.0), (None, 3.0)]


def test_top_n_series(spark):
    df = series(spark, a=[(1, 1), (2, 2)], b=[(1, 5)], c=[(1, 0)])
    best = scores(spark, []).unionByName(frame(spark, SCORE, [("a", 1.0), ("b", 1.0), ("c", None)]))
    assert [tuple(r) for r in fuse.top_n_series(df, best, 1).collect()] == [("a", 1, 1), ("a", 2, 2)]


def test_profiles(spark):
    df = frame(spark, SCORE, [("a", 1.0), ("b", None), ("b", 3.0)])
    assert table(profile.null_profile(df)) == [(0, 1)]
    assert table(profile.row_profile(df, "locality")) == [(3, 2)]
    d = profile.describe_score(df).first()
    assert (d.n, d.n_missing, d["mean"], d["min"], d.q50, d["max"]) == (2, 1, 2.0, 1.0, 2.0, 3.0)


# --- rows that used to be lost ------------------------------------------------------------------


def test_poisson_looks_at_all_years_and_adds_up_repeated_ones(spark):
    rows = [("a", y, n) for y, n in ((1995, 3), (1996, 4), (1997, 6), (1998, 9))]
    got = poisson.poisson_trend(frame(spark, PANEL, rows)).first()
    assert (got.years_covered, got.n_obs) == ("1995-1998", 4)
    twice = poisson.poisson_trend(frame(spark, PANEL, [*rows[:3], ("a", 1998, 4), ("a", 1998, 5)])).first()
    assert tuple(twice) == tuple(got)


def exact_trend(points):
    """The trend at the greatest likelihood, by bisection in decimals of sixty digits."""
    with localcontext() as context:
        context.prec = 60
        y = {Decimal(a): Decimal(n) for a, n in points}
        mean = sum(a * n for a, n in y.items()) / sum(y.values())
        low, high = Decimal(-200), Decimal(200)
        for _ in range(190):
            b = (low + high) / 2
            top = max(b * a for a in y)
            weights = {a: (b * a - top).exp() for a in y}
            if sum(a * w for a, w in weights.items()) / sum(weights.values()) < mean:
                low = b
            else:
                high = b
        return float(low)


EXTREME = dict(
    late=[(2011, 1), (2012, 0), (2013, 0), (2014, 0), (2015, 10**12)],
    early=[(2011, 10**13), (2012, 0), (2013, 1)],
    wide=[(1000, 1), (1500, 7), (2013, 10**9)],
    steep=[(2011, 1), (2012, 10**6), (2013, 10**12)],
    middle=[(2011, 0), (2012, 10**9), (2013, 0), (2014, 1)],
    nearly_flat=[(2011, 10**12), (2012, 10**12 + 1), (2013, 10**12)],
    two=[(2011, 1), (2012, 10**14)],
    gaps=[(1900, 3), (1901, 0), (2000, 0), (2001, 5), (2013, 2)],
    small=[(2011, 0), (2012, 1), (2013, 0), (2014, 0), (2015, 1)],
)


def test_extreme_series_agree_with_a_fit_of_sixty_digits(spark):
    got = by_key(poisson.poisson_trend(series(spark, **EXTREME)))
    for name, points in EXTREME.items():
        assert got[name].fit_status == "ok", name
        assert got[name].annual_growth_pct_poisson == pytest.approx(math.expm1(exact_trend(points)) * 100, rel=1e-9, abs=1e-11), name
        assert 0 <= got[name].p_value_year <= 1 and 0 <= got[name].deviance_explained <= 1


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(many=st.lists(st.lists(st.integers(0, 40), min_size=3, max_size=9), min_size=1, max_size=8))
def test_only_series_without_a_finite_maximum_have_no_fit(spark, many):
    rows = {f"s{k}": [(2000 + 2 * j, n) for j, n in enumerate(ys)] for k, ys in enumerate(many)}
    for name, r in by_key(poisson.poisson_trend(series(spark, **rows))).items():
        ys = [n for _, n in rows[name]]
        if len(set(ys)) == 1:
            assert r.fit_status == "constant"
        elif sum(n > 0 for n in ys) == 1 and (ys[0] or ys[-1]):
            assert (r.fit_status, r.trend_score) == ("not_converged", None)
        else:
            assert r.fit_status == "ok"
            assert math.log1p(r.annual_growth_pct_poisson / 100) == pytest.approx(exact_trend(rows[name]), rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("at_once", [3, 100_000])
@pytest.mark.parametrize("kind", ["ties", "spread", "one", "hot", "two"])
def test_quantiles_equal_those_of_one_buffer(spark, kind, at_once):
    rng = np.random.default_rng(3)
    values = {
        "ties": rng.integers(-3, 4, 3000).astype(float), "spread": rng.normal(0, 100, 2500), "one": np.array([-7.5]),
        "hot": np.concatenate([np.zeros(2000), rng.normal(0, 1e-3, 500), [1e9, -1e9]]), "two": np.array([-1.0, 4.0]),
    }[kind]
    df = frame(spark, "v double", [(float(v),) for v in values] + [(None,)])
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first().q
    assert profile.exact_quantiles(df, "v", shares, at_once) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_a_range_that_is_sorted_holds_few_values(spark, monkeypatch):
    sizes = []
    original = profile._ranked
    monkeypatch.setattr(profile, "_ranked", lambda v, rank: sizes.append(v.count()) or original(v, rank))
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_000_007).cast("double").alias("v"))
    want = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q
    assert profile.exact_quantiles(df, "v", (0.25, 0.5, 0.75), at_once=500) == pytest.approx(want)
    assert len(sizes) == 3 and max(sizes) <= 500
    empty = df.where("v IS NULL")
    assert profile.describe_score(empty, "v").first().q50 is None


def test_gates_count_years_of_raw_rows_and_windows_refuse_them(spark):
    rows = [("a", 2001, 1), ("a", 2001, 2), ("a", 2002, 3), ("b", 2001, 1), ("b", 2002, 1), ("b", 2003, 1)]
    raw = frame(spark, PANEL, rows)
    assert {r.locality for r in panel.min_years_gate(raw, 3).collect()} == {"b"}
    assert table(panel.excluded_keys(raw, 3)) == [("a", 2)]
    for windowed in (panel.yoy_growth, panel.interpolate_gaps):
        with pytest.raises(Exception, match="more than one row of the year 2001"):
            windowed(raw).collect()
        assert windowed(panel.to_panel(raw)).count() == 5


def exchanges_of(df) -> int:
    df.collect()  # the adaptive plan that ran
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan_of(df)))


def test_stored_panels_need_no_exchange(spark):
    rows = spark.range(4000).select((F.col("id") % 400).cast("string").alias("locality"), (2000 + F.floor(F.col("id") / 400)).cast("int").alias("year"), (F.col("id") * 7 % 91).cast("double").alias("value"))

    def chain(df):
        kept = panel.recency_gate(panel.min_years_gate(panel.interpolate_gaps(df), 3), 2005)
        return panel.with_group_extremes(panel.drop_first_obs(panel.yoy_growth(kept)))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = stored_by_key(panel.to_panel(rows), "panel", "locality", "year", buckets=4)
        assert exchanges_of(chain(stored)) == 0 and exchanges_of(chain(panel.to_panel(rows))) > 0
        assert table(chain(stored)) == table(chain(panel.to_panel(rows)))
        scores = {n: rows.groupBy("locality").agg(F.sum(F.col("value") * k).alias("trend_score")) for k, n in enumerate("abc", 1)}
        kept = {n: stored_by_key(df, f"score-{n}", "locality", buckets=4) for n, df in scores.items()}
        two = kept["a"].join(kept["b"].withColumnRenamed("trend_score", "b"), "locality", "full")
        assert exchanges_of(two) == 0
        sums = [df.groupBy("locality").agg(F.sum("trend_score").alias("s")) for df in kept.values()]
        assert [exchanges_of(s) for s in sums] == [0, 0, 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_series_of_too_many_years_raises(spark):
    rows = frame(spark, PANEL, [("a", y, 1) for y in range(poisson.MOST_YEARS + 1)])
    with pytest.raises(Exception, match="more than"):
        poisson.poisson_trend(rows).collect()


def test_scores_that_are_no_finite_number_are_missing(spark):
    rows = [("a", float("nan")), ("b", 2.0), ("c", -1.0), ("d", float("inf")), ("e", float("-inf")), ("f", 1.0)]
    scores = frame(spark, "locality string, trend_score double", rows)
    expected = {"a": None, "b": 10.0, "c": -10.0, "d": None, "e": None, "f": 5.0}
    assert {r.locality: r.trend_score for r in scale.sign_preserving(scores).collect()} == expected
    fused = fuse.fuse_scores({"x": scores})
    assert {r.locality: r.x for r in fused.collect()} == {"a": None, "b": 2.0, "c": -1.0, "d": None, "e": None, "f": 1.0}


def test_fusion_reads_every_input_once(spark, tmp_path):
    tables = {}
    for name in "abc":
        path = str(tmp_path / name)
        frame(spark, "locality string, trend_score double", [("k", 1.0), (None, 2.0)]).write.parquet(path)
        tables[name] = spark.read.parquet(path)
    for joined in (fuse.full_outer_chain(tables), fuse.fuse_scores(tables)):
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 3
        assert sorted(map(str, joined.collect())).count("Row(locality='k', a=1.0, b=1.0, c=1.0)") == 1 and joined.count() == 4
