import numpy as np
import pytest
from pyspark.sql import functions as F

from sharedrift import schemas
from sharedrift import settings as S
from sharedrift.operators import boxes, charts, filters, hexes, learning, names, tiles, trends
from sharedrift.operators.counts import GROUP_POINT, group_point_year, over_groups, species_point_year
from sharedrift.functions import features

GOOD = dict(orderkey=797, specieskey=1, taxonkey=1, decimallatitude=10.0, decimallongitude=20.0,
            hasgeospatialissues=False, year=1950, basisofrecord="HUMAN_OBSERVATION", scientificname="Aa bb")


def occurrences(spark, *changes):
    rows = [{**dict.fromkeys(schemas.OCCURRENCE.fieldNames()), **GOOD, **c, "recordid": i}
            for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, schemas.OCCURRENCE)


@pytest.mark.parametrize("change, kept", [
    ({}, True),
    ({"decimallatitude": 85.0}, True), ({"decimallatitude": -85.0}, True), ({"decimallatitude": 85.01}, False),
    ({"decimallatitude": None}, False),
    ({"decimallongitude": 180.0}, True), ({"decimallongitude": -180.0}, True),
    ({"decimallongitude": -180.01}, False), ({"decimallongitude": None}, False),
    ({"hasgeospatialissues": True}, False), ({"hasgeospatialissues": None}, False),
    ({"year": 1900}, True), ({"year": 1899}, False), ({"year": None}, False),
    ({"basisofrecord": "FOSSIL_SPECIMEN"}, False), ({"basisofrecord": "LIVING_SPECIMEN"}, False),
    ({"basisofrecord": None}, False), ({"specieskey": None}, False),
    ({"orderkey": 798}, False),
])
def test_quality_filter(spark, change, kept):
    df = filters.quality_filter(occurrences(spark, change), S.DEFAULT_GROUP_KEY)
    assert df.count() == int(kept)


def test_quality_filter_of_all_groups_and_later_floor(spark):
    df = occurrences(spark, {}, {"orderkey": 5}, {"year": 1971}, {"orderkey": None})
    assert filters.quality_filter(df).count() == 3
    assert filters.quality_filter(df, min_year=S.MIN_RECORD_YEAR_PYRAMID).count() == 1


def test_names(spark):
    df = occurrences(
        spark, {}, {}, {"specieskey": 2, "scientificname": "Aa cc"},
        {"specieskey": 3, "taxonkey": 9}, {"specieskey": 3, "taxonkey": 9},
        *[{"specieskey": 10 + i, "taxonkey": 10 + i, "scientificname": f"Zz {i:02}"} for i in range(30)] * 2)
    found = names.species_names(df)
    assert found.where("scientificname like 'Aa%'").count() == 1  # once is not enough; synonyms are left out
    top = names.autocomplete(found, "Zz").collect()
    assert [r["scientificname"] for r in top] == [f"Zz {i:02}" for i in range(25)]
    assert names.autocomplete(found, "Z_ 0%").count() == 10  # the caller's wildcards stay live
    assert names.autocomplete(found, "zz").count() == 0
    assert names.autocomplete(found, "zz", ignore_case=True).count() == 25


SCHEMA = "orderkey int, specieskey int, lat_e2 int, lng_e2 int, year int, n bigint"


def test_year_range_two_ways(spark):
    rows = [(1, s, 0, 0, y, s + y % 3 + 1) for s in range(5) for y in range(1990, 1995 + s)]
    df = spark.createDataFrame(rows, SCHEMA)
    maps = trends.species_year_maps(df, ("lat_e2", "lng_e2")).withColumn(
        "kept", features.years_between(F.col("species_seen"), 1994, 1997)).where(F.size("kept") >= 3)
    long = trends.species_year_maps(filters.in_years(df, 1994, 1997), ("lat_e2", "lng_e2"), min_years=3)
    assert {r["specieskey"]: r["kept"] for r in maps.collect()} == {
        r["specieskey"]: r["species_seen"] for r in long.collect()}
    assert filters.of_species(df, 2, 3).select("specieskey").distinct().count() == 2


def test_hexagons_keep_every_observation(spark):
    rng = np.random.default_rng(8)
    rows = [(1, int(rng.integers(3)), int(a), int(b), int(rng.integers(1990, 1996)), 2)
            for a, b in zip(rng.integers(-8500, 8500, 400), rng.integers(-18000, 18000, 400))]
    df = spark.createDataFrame(rows, SCHEMA)
    counted = hexes.hex_year_counts(df, (0, 4), 80.0)
    assert {r["z"]: r["s"] for r in counted.groupBy("z").agg(F.sum("n").alias("s")).collect()} == {0: 800, 4: 800}
    t = hexes.hex_trends(df, (0,), 400.0, years=(1991, 1995), min_species_years=5).collect()
    assert t and all(r["species_years"] == 5 and len(r["species_counts"]) == 5 for r in t)


def box_brute_force(counts, request):
    rid, order, species, lat_a, lng_a, lat_b, lng_b, y0, y1 = request
    lo, hi = sorted((lat_a, lat_b))
    left, right = sorted((lng_a, lng_b))
    rows = [r for r in counts if r[0] == order and y0 <= r[4] <= y1]
    if not any(r[1] == species for r in rows):
        return None
    inside = [r for r in rows if lo <= r[2] / 100 <= hi and left <= r[3] / 100 <= right]
    group, own = {}, {}
    for r in inside:
        group[r[4]] = group.get(r[4], 0) + r[5]
        if r[1] == species:
            own[r[4]] = own.get(r[4], 0) + r[5]
    return {y: own.get(y, 0) for y in group}, group, len(own)


def test_small_boxes_on_dense_places(spark):
    """Places next to each other, boxes of 0.01 to 2 degrees with sides on and between whole hundredths."""
    rng = np.random.default_rng(4)
    cells = {(0, int(s), int(a), int(b), int(y)) for s, a, b, y in zip(
        rng.integers(0, 3, 6000), rng.integers(-130, 131, 6000), rng.integers(-130, 131, 6000), rng.integers(1990, 1995, 6000))}
    counts = [(*c, int(rng.integers(1, 5))) for c in sorted(cells)]
    requests = []
    for i in range(120):
        a, b = (int(x) for x in rng.integers(-120, 100, 2))
        h, w = (int(x) for x in rng.choice([0, 1, 3, 19, 20, 21, 99, 100, 200], 2))
        shift = (0, 0.004)[i % 2]
        requests.append((i, 0, i % 3, a / 100 + shift, b / 100 - shift, (a + h) / 100 + shift, (b + w) / 100, 1990, 1994))
    got = {r["request_id"]: r for r in boxes.box_trends(
        spark.createDataFrame(counts, SCHEMA), spark.createDataFrame(requests, schemas.BOX_REQUEST)).collect()}
    assert len(got) == len(requests)
    for request in requests:
        row = got[request[0]]
        assert (row["species_counts"], row["group_counts"], row["species_years"]) == box_brute_force(counts, request)


def test_box_joins_grow_with_their_answers(spark):
    """10,000 places in one degree: a small box meets the places of the half-degree cells it cuts, a large one meets sums."""
    places = spark.range(10_000).select(
        F.lit(0).alias("orderkey"), F.lit(1).alias("specieskey"), (F.col("id") / 100).cast("int").alias("lat_e2"),
        (F.col("id") % 100).cast("int").alias("lng_e2"), F.lit(1990).alias("year"), F.lit(1).cast("long").alias("n"))

    def met(rows):
        requests = boxes.with_corners_ordered(spark.createDataFrame(rows, schemas.BOX_REQUEST))
        return boxes.met_in_cells(requests, places, ["orderkey", "specieskey"]).count()

    small = [(i, 0, 1, i % 90 / 100, i % 80 / 100, i % 90 / 100 + 0.01, i % 80 / 100 + 0.01, 1990, 1990) for i in range(300)]
    assert met(small) <= 300 * 4 * 400 < 300 * 10_000
    assert met([(0, 0, 1, 0.0, 0.0, 0.995, 0.995, 1990, 1990)]) == 4  # the whole degree: four sums of half a degree
    assert met([(0, 0, 1, -85.0, -180.0, 85.0, 180.0, 1990, 1990)]) == 1


def test_cells_tile_a_box_once(spark):
    """Where every place has data, each place of a box lies in exactly one of the cells that answer it."""
    rows = [(0, 0, 1, -1.31, 0.02, 1.47, 3.0, 1, 2), (1, 0, 1, 0.0, 0.0, 0.0, 0.0, 1, 2), (2, 0, 1, -0.07, -0.2, 0.19, 0.19, 1, 2)]
    places = spark.range(600 * 600).select(
        F.lit(0).alias("orderkey"), F.lit(1).alias("specieskey"), (F.floor(F.col("id") / 600) - 200).cast("int").alias("lat_e2"),
        (F.col("id") % 600 - 200).cast("int").alias("lng_e2"), F.lit(1).alias("year"), F.lit(1).cast("long").alias("n"))
    asked = boxes.with_corners_ordered(spark.createDataFrame(rows, schemas.BOX_REQUEST))
    found = boxes.met_in_cells(asked, places, ["orderkey", "specieskey"]).collect()
    for rid, _, _, a, b, c, d, _, _ in rows:
        lat, lng = (np.arange(round(x * 100), round(y * 100) + 1) for x, y in ((a, c), (b, d)))
        seen = np.zeros((len(lat), len(lng)), dtype=int)
        for r in (r for r in found if r["request_id"] == rid):
            inside = np.outer(lat // r["size"] == r["row"], lng // r["size"] == r["column"])
            assert inside.any() and inside.sum() == r["n"] and (not r["whole"] or inside.sum() == r["size"] ** 2)
            seen += inside
        assert (seen == 1).all()


def test_a_species_in_two_groups_has_one_year_map(spark):
    rows = [(1, 5, 0, 0, 1990, 2), (2, 5, 0, 0, 1990, 3), (1, 5, 0, 0, 1991, 1)]
    maps = trends.year_maps(over_groups(spark.createDataFrame(rows, SCHEMA)), ["specieskey", "lat_e2", "lng_e2"])
    assert [r["species_seen"] for r in maps.collect()] == [{1990: 5, 1991: 1}]


def test_boxes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    cells = {(int(s) % 2, int(s), int(a), int(b), int(y)) for s, a, b, y in zip(
        rng.integers(0, 8, 3000), rng.integers(-60, 61, 3000) * 125, rng.integers(-70, 71, 3000) * 250,
        rng.integers(1990, 1997, 3000))}
    counts = [(*c, int(rng.integers(1, 5))) for c in sorted(cells)]
    requests = [(i, int(s) % 2, int(s), float(a), float(b), float(a + h), float(b + w), 1991, 1995)
                for i, (s, a, b, h, w) in enumerate(zip(
                    rng.integers(0, 8, 40), rng.integers(-80, 60, 40), rng.integers(-175, 100, 40),
                    rng.integers(-30, 90, 40), rng.integers(-60, 170, 40)))]
    requests += [
        (100, 0, 0, -90.0, -200.0, 90.0, 200.0, 1900, 2016),   # the whole world and more
        (101, 0, 0, 1.25, 2.5, 1.25, 2.5, 1990, 1996),         # a single place
        (102, 1, 1, 12.31, 7.77, 12.34, 7.79, 1990, 1996),     # nothing inside
        (103, 0, 77, -50.0, -50.0, 50.0, 50.0, 1990, 1996),    # unknown species: no answer
        (104, 0, 0, -50.0, -50.0, 50.0, 50.0, 1800, 1801),     # no data in the years: no answer
    ]
    got = {r["request_id"]: r for r in boxes.box_trends(
        spark.createDataFrame(counts, SCHEMA), spark.createDataFrame(requests, schemas.BOX_REQUEST)).collect()}
    for request in requests:
        want = box_brute_force(counts, request)
        row = got.pop(request[0], None)
        if want is None:
            assert row is None
            continue
        assert (row["species_counts"], row["group_counts"], row["species_years"]) == want
        assert row["group_years"] == len(want[1])
    assert not got


def test_point_on_the_date_line_is_in_the_last_tile(spark):
    df = spark.createDataFrame([(0, 18000), (0, -18000)], "lat_e2 int, lng_e2 int")
    got = {r["lng_e2"]: (r["x"], r["local_x"]) for r in tiles.point_tile_features(df, (1,)).collect()}
    assert got == {18000: (1, 4095), -18000: (0, 0)}


def trend_row(spark, slope, intercept, own, group):
    return spark.createDataFrame(
        [(1, slope, intercept, own, group)],
        "k int, slope double, intercept double, species_counts map<int,bigint>, group_counts map<int,bigint>")


def test_chart_of_the_worked_example(spark):
    slope = (1 / 2 - 1 / 3) / 34
    row = trend_row(spark, slope, 1 / 3 - slope * 1968, {1968: 4, 2002: 3}, {1968: 12, 2002: 6})
    series = {r["year"]: r for r in charts.chart_series(row, ["k"], F.lit(1968), F.lit(2003)).collect()}
    assert len(series) == 35 and series[1968]["share"] == pytest.approx(1 / 3) and series[2002]["share"] == 0.5
    assert series[1990]["share"] is None and series[1990]["group_line"] == 0
    assert series[1968]["group_line"] == 0.5  # the largest group count meets the largest share
    summary = charts.trend_summary(row, ["k"], F.lit(1968), F.lit(2003)).first()
    assert (summary["rate_per_10k"], summary["level_ratio_pct"], summary["change_pct"]) == (49.02, 150, 50)
    exclusive = charts.chart_series(row, ["k"], F.lit(1968), F.lit(2002))
    assert exclusive.agg(F.max("year")).first()[0] == 2001


def test_summary_without_level(spark):
    row = trend_row(spark, -0.1, 200.0, {2000: 1}, {2000: 1})
    got = charts.trend_summary(row, ["k"], F.lit(1990), F.lit(2011)).first()
    assert got["level_ratio_pct"] is None and got["direction"] == "decline" and got["rate_per_10k"] == -1000.0


def test_level_of_a_line_that_starts_at_zero(spark):
    slope = 0.1 / 3
    row = trend_row(spark, slope, -slope * 1995 + 3e-14, {2000: 1}, {2000: 1})
    assert charts.trend_summary(row, ["k"], F.lit(1995), F.lit(2001)).first()["level_ratio_pct"] is None


@pytest.mark.parametrize("slope, direction", [(-1e-19, "no decline"), (1e-19, "no decline"), (-1e-9, "decline")])
def test_direction_of_a_line_that_is_flat_but_for_rounding(spark, slope, direction):
    row = trend_row(spark, slope, 0.3, {2000: 1}, {2000: 1})
    assert charts.trend_summary(row, ["k"], F.lit(1995), F.lit(2001)).first()["direction"] == direction


def test_slope_classes(spark):
    cases = [(0.01, 0), (0.0008, 0), (0.00079, 1), (0.0006, 1), (0.0004, 2), (0.0002, 3), (0.0, 4), (-1e-9, 5),
             (-0.0002, 5), (-0.0004, 6), (-0.0006, 7), (-0.0008, 8), (-0.00081, 9), (-1.0, 9), (None, None)]
    df = spark.createDataFrame([(s,) for s, _ in cases], "slope double")
    assert [r[0] for r in df.select(charts.slope_class(F.col("slope"))).collect()] == [c for _, c in cases]


def test_learning_fit(spark):
    rows = spark.createDataFrame([(y, 2 * y - 3000) for y in range(1990, 2010)], "year int, count bigint")
    data = learning.labelled(rows)
    model = learning.train(data)
    assert model.coefficients[0] == pytest.approx(2.0, rel=1e-6)
    got = learning.mean_squared_error(learning.predictions(model, data)).first()
    assert got["n"] == 20 and got["mse"] == pytest.approx(0, abs=1e-6)


def test_training_share(spark):
    df = spark.range(20000).where(learning.in_training("id"))
    assert 0.68 < df.count() / 20000 < 0.72
    training, test = learning.random_split(spark.range(20000), seed=1)
    assert 0.68 < training.count() / 20000 < 0.72 and training.count() + test.count() == 20000


def test_group_maps(spark):
    df = spark.createDataFrame([(1, 1, 5, 6, 2000, 2), (1, 2, 5, 6, 2000, 3), (1, 2, 5, 6, 2001, 1)], SCHEMA)
    row = trends.group_year_maps(group_point_year(df), list(GROUP_POINT)).first()
    assert row["group_counts"] == {2000: 5, 2001: 1}


def test_places_merge_when_rounded(spark):
    df = occurrences(spark, {"decimallatitude": 10.004}, {"decimallatitude": 10.0}, {"decimallatitude": 10.005})
    got = {r["lat_e2"]: r["n"] for r in species_point_year(df).collect()}
    assert got == {1000: 2, 1001: 1}


def test_level_of_a_rare_species(spark):
    """Shares of 1e-12 have a level like any others."""
    row = spark.createDataFrame([(1, 1e-13, 1e-13 * -1980.0)], "k int, slope double, intercept double")
    got = charts.trend_summary(row, ["k"], F.lit(1990), F.lit(2011)).first()
    assert (got["level_ratio_pct"], got["change_pct"]) == (300, 200)


def test_tile_document_of_a_species_in_two_groups(spark):
    rows = [(group, 3, 0, 0, 0, 1990, 4, 1) for group in (1, 2)]
    pyramid = spark.createDataFrame(
        rows, "orderkey int, specieskey int, z int, x long, y long, year int, cellid long, n_points long")
    [doc] = tiles.tile_documents(pyramid).collect()
    assert doc["json"] == '{"1990":{"4":2}}'
