import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharedrift.functions import statistics
from sharedrift.operators import counts as counting
from sharedrift.operators import fits, trends
from sharedrift.operators.joins import spread_join


def p_value(t, nu):
    """P(|T| > t) by numerical integration of the density."""
    norm = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    x = np.linspace(0.0, t, 200001)
    density = norm * (1 + x * x / nu) ** (-(nu + 1) / 2)
    return 1 - 2 * np.trapezoid(density, x)


def fit(xs, ys, min_n):
    """The expected statistics, from the textbook formulas over all points."""
    n = len(xs)
    names = ("slope", "intercept", "significance", "sse", "intercept_stderr", "mse", "slope_stderr")
    none = dict.fromkeys(names)
    if n < max(min_n, 2) or len(set(xs)) < 2:
        return none
    x, y = np.array(xs, float), np.array(ys, float)
    sxx = ((x - x.mean()) ** 2).sum()
    flat = y.max() == y.min()
    slope = 0.0 if flat else ((x - x.mean()) * (y - y.mean())).sum() / sxx
    out = dict(none, slope=slope, intercept=y.mean() - slope * x.mean())
    sse = 0.0 if flat else ((y - out["intercept"] - slope * x) ** 2).sum()
    out["sse"] = sse
    if n >= 3:
        out["mse"] = sse / (n - 2)
        out["slope_stderr"] = math.sqrt(out["mse"] / sxx)
        out["intercept_stderr"] = math.sqrt(out["mse"] * (1 / n + x.mean() ** 2 / sxx))
        if out["slope_stderr"] > 1e-9:
            out["significance"] = p_value(abs(slope) / out["slope_stderr"], n - 2)
        elif slope != 0:
            out["significance"] = 0.0
    return out


def same(got, want, tol=1e-7):
    return (got is None) == (want is None) and (got is None or abs(got - want) <= tol * max(1, abs(want)))


@pytest.mark.parametrize("nu", [1, 2, 3, 4, 5, 8, 17, 50, 115])
def test_t_two_sided(spark, nu):
    ts = [0.0, 0.1, 0.7, 1.0, 2.5, 6.0]
    rows = spark.createDataFrame([(t, nu) for t in ts], "t double, nu bigint")
    got = statistics.with_t_two_sided(rows, "p", F.col("t"), F.col("nu")).orderBy("t").collect()
    for row in got:
        assert abs(row["p"] - p_value(row["t"], nu)) < 1e-8


def test_line_through_origin(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "k int, year int, n int")
    (row,) = fits.ols_sums_of_squares(rows, ["k"], "n").collect()
    assert (row["m"], row["c"], row["ssto"], row["ssr"], row["sse"]) == (1.0, 0.0, 2.0, 2.0, 0.0)
    (row,) = fits.ols_diagnostics(rows, ["k"], "n").collect()
    assert (row["r2"], row["slope_stderr"], row["intercept_stderr"]) == (1.0, 0.0, 0.0)
    (row,) = fits.slopes(rows, ["k"], "n").collect()
    assert row["slope"] == 1.0


def test_slope_needs_two_years(spark):
    rows = spark.createDataFrame([(1, 1990, 5)], "k int, year int, n int")
    assert fits.slopes(rows, ["k"], "n").first()["slope"] is None
    (row,) = fits.ols_sums_of_squares(rows, ["k"], "n").collect()
    assert row["m"] is None and row["sse"] is None


def test_worked_example(spark):
    """Species 4 of 12 in 1968 and 3 of 6 in 2002."""
    rows = spark.createDataFrame(
        [(1, 10, 1968, 4), (1, 11, 1968, 8), (1, 10, 2002, 3), (1, 11, 2002, 3)],
        "orderkey int, specieskey int, year int, n bigint")
    row = trends.species_trends(rows, min_fit_years=2).where("specieskey = 10").first()
    assert row["slope"] == pytest.approx((1 / 2 - 1 / 3) / 34)
    assert row["slope"] * 1968 + row["intercept"] == pytest.approx(1 / 3)
    assert row["mse"] is None and row["significance"] is None
    assert trends.species_trends(rows).where("specieskey = 10").first()["slope"] is None


def random_counts(seed, places=6, species=9, years=range(1990, 2002)):
    rng = np.random.default_rng(seed)
    rows = []
    for place in range(places):
        seen = [y for y in years if rng.random() < 0.7]
        for s in range(species):
            for y in seen:
                if rng.random() < 0.5:
                    rows.append((s % 2, s, place * 10, -place * 7, y, int(rng.integers(1, 9))))
    return rows


SCHEMA = "orderkey int, specieskey int, lat_e2 int, lng_e2 int, year int, n bigint"


@pytest.mark.parametrize("min_years", [1, 3])
def test_trends_equal_brute_force(spark, min_years):
    rows = random_counts(5)
    got = trends.point_trends(
        spark.createDataFrame(rows, SCHEMA), years=(1991, 2000), min_species_years=min_years).collect()
    rows = [r for r in rows if 1991 <= r[4] <= 2000]
    group, own = {}, {}
    for o, s, la, lo, y, n in rows:
        totals = group.setdefault((o, la, lo), {})
        totals[y] = totals.get(y, 0) + n
        own.setdefault((o, s, la, lo), {})[y] = n
    expected = {k: v for k, v in own.items() if len(v) >= min_years}
    assert {(r["orderkey"], r["specieskey"], r["lat_e2"], r["lng_e2"]) for r in got} == set(expected)
    for r in got:
        key = (r["orderkey"], r["specieskey"], r["lat_e2"], r["lng_e2"])
        totals = group[(key[0], key[2], key[3])]
        years = sorted(totals)
        filled = {y: expected[key].get(y, 0) for y in years}
        assert r["species_counts"] == filled and r["group_counts"] == totals
        assert r["species_years"] == len(expected[key]) and r["group_years"] == len(totals)
        want = fit(years, [filled[y] / totals[y] for y in years], 3)
        for name, value in want.items():
            if name == "significance" and r["slope_stderr"] is not None and r["slope_stderr"] < 1e-8:
                continue  # perfect fits differ in rounding noise only
            assert same(r[name], value), (key, name, r[name], value)


def test_constant_and_perfect_fits(spark):
    rows = (
        [(1, 1, 0, 0, y, 1) for y in (2000, 2001, 2002)] + [(1, 2, 0, 0, y, 2) for y in (2000, 2001, 2002)]
        + [(2, 3, 0, 0, y, n) for y, n in ((2000, 1), (2001, 2), (2002, 3))]
        + [(2, 4, 0, 0, y, n) for y, n in ((2000, 3), (2001, 2), (2002, 1))]
    )
    got = {r["specieskey"]: r for r in trends.point_trends(spark.createDataFrame(rows, SCHEMA)).collect()}
    for key in (1, 2):  # constant share
        assert got[key]["slope"] == 0 and got[key]["sse"] == 0 and got[key]["significance"] is None
    assert got[3]["slope"] == pytest.approx(0.25) and got[4]["slope"] == pytest.approx(-0.25)
    assert got[3]["sse"] == pytest.approx(0) and got[3]["significance"] == pytest.approx(0, abs=1e-6)


def test_long_form_has_inferred_zeros(spark):
    rows = [(1, 1, 0, 0, 2000, 2), (1, 2, 0, 0, 2000, 2), (1, 2, 0, 0, 2001, 5)]
    got = trends.yearly_shares(spark.createDataFrame(rows, SCHEMA), ("lat_e2", "lng_e2"))
    assert {(r["specieskey"], r["year"], r["species_n"], r["group_n"], r["share"]) for r in got.collect()} == {
        (1, 2000, 2, 4, 0.5), (1, 2001, 0, 5, 0.0), (2, 2000, 2, 4, 0.5), (2, 2001, 5, 5, 1.0)}


def test_group_totals_two_ways(spark, sf_dir):
    """Summing species counts equals counting observations."""
    from sharedrift.plans import catalogue

    clean = catalogue.clean(spark, sf_dir)
    summed = counting.group_point_year(counting.species_point_year(clean))
    direct = counting.group_point_year_direct(clean)
    columns = ["orderkey", "lat_e2", "lng_e2", "year", "n"]
    assert summed.select(columns).exceptAll(direct.select(columns)).isEmpty()
    assert direct.select(columns).exceptAll(summed.select(columns)).isEmpty()


@pytest.mark.parametrize("spread", [1, 3, 8])
def test_spread_join(spark, spread):
    many = spark.createDataFrame([(1, s, 5) for s in range(40)] + [(None, 99, 5)],
                                 "orderkey int, specieskey int, place int")
    one = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "orderkey int, place int, v string")
    got = spread_join(many, one, ["orderkey", "place"], spread=spread).collect()
    assert sorted(r["specieskey"] for r in got) == list(range(40)) and {r["v"] for r in got} == {"a"}
