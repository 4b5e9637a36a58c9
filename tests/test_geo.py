import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions import features, hexagons, mercator
from sharedrift.operators import hexes, tiles
from sharedrift.operators.counts import hundredths


def points(spark, rows):
    return spark.createDataFrame(rows, "lat double, lng double")


def test_addresses_at_the_edges(spark):
    rows = [(0.0, 180.0), (0.0, -180.0), (85.0, 0.0), (-85.0, 0.0), (85.01, 0.0), (0.0, 180.5), (None, 1.0)]
    df = points(spark, rows)
    x, y = mercator.address(F.col("lat"), F.col("lng"), 4)
    cx, cy = mercator.address(F.col("lat"), F.col("lng"), 4, clamp=True)
    got = [tuple(r) for r in df.select(x, y, cx, cy).collect()]
    assert got[0] == (16, 8, 15, 8)  # one past the last tile unless clamped
    assert got[1] == (0, 8, 0, 8)
    assert got[2][:2] == (8, 0) and got[3][:2] == (8, 15)
    assert got[4:] == [(None,) * 4] * 3


def test_pixels_there_and_back(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-85, 85, 500), rng.uniform(-180, 180, 500))]
    for zoom in (0, 3, 8):
        df = points(spark, rows).select(
            "lat", "lng",
            mercator.pixel_to_lat(mercator.pixel_y(F.col("lat"), zoom), zoom).alias("a"),
            mercator.pixel_to_lng(mercator.pixel_x(F.col("lng"), zoom), zoom).alias("b"))
        for r in df.collect():
            assert r["a"] == pytest.approx(r["lat"], abs=1e-9) and r["b"] == pytest.approx(r["lng"], abs=1e-9)


def test_tile_corners_and_clamping(spark):
    df = points(spark, [(0.0, 0.0), (89.9, 180.0)])
    row = df.select(
        mercator.lat_to_tile(F.col("lat"), 2).alias("ty"), mercator.lng_to_tile(F.col("lng"), 2).alias("tx"),
        mercator.tile_to_lat(F.lit(2), 2).alias("clat"), mercator.tile_to_lng(F.lit(1), 2).alias("clng"),
        mercator.metres_per_pixel(F.lit(0.0), 0).alias("m"),
    ).collect()
    assert (row[0]["tx"], row[0]["ty"]) == (2, 2) and (row[1]["tx"], row[1]["ty"]) == (3, 0)
    assert row[0]["clat"] == pytest.approx(0.0, abs=1e-12) and row[0]["clng"] == -90.0
    assert row[0]["m"] == pytest.approx(40075016.686 / 4096)


def test_zoom_as_column_equals_number(spark):
    df = points(spark, [(51.5, -0.12)]).withColumn("z", F.lit(5))
    a, b = df.select(mercator.pixel_x(F.col("lng"), 5), mercator.pixel_x(F.col("lng"), F.col("z"))).first()
    assert a == b


def test_hundredths_round_half_up_on_the_decimal(spark):
    values = [1.005, -1.005, 2.675, 0.0, -0.004, 179.995, -179.999, 12.344999, 12.345, 8.125, -8.125]
    want = [101, -101, 268, 0, 0, 18000, -18000, 1234, 1235, 813, -813]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(hundredths(F.col("v"))).collect()] == want
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(float(v),) for v in np.round(rng.uniform(-180, 180, 20000), 3)], "v double")
    bad = many.where(hundredths(F.col("v")) != F.rint(F.round("v", 2) * 100).cast("int"))
    assert bad.count() == 0


def test_pyramid_shift_equals_direct_address(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 7, 2000, float(a), float(b), 2) for a, b in
            zip(rng.uniform(-85, 85, 300), rng.uniform(-180, 180, 300))] + [(1, 7, 2000, 0.0, 180.0, 2)]
    pts = spark.createDataFrame(rows, "orderkey int, specieskey int, year int, lat double, lng double, count bigint")
    pyramid = tiles.tile_pyramid(pts)
    for z in (0, 5, 8):
        x, y = mercator.address(F.col("lat"), F.col("lng"), z)
        direct = {(r[0], r[1]): r[2] for r in pts.groupBy(x, y).count().collect()}
        got = {(r[0], r[1]): r[2] for r in
               pyramid.where(F.col("z") == z).groupBy("x", "y").agg(F.sum("n_points")).collect()}
        assert got == direct
    assert pyramid.where("z = 8").agg(F.sum("n_obs")).first()[0] == 602


@pytest.mark.parametrize("radius", [48.0, 80.0, 400.0])
def test_hexagon_is_the_nearest_centre(spark, radius):
    rng = np.random.default_rng(4)
    xy = rng.uniform(-2000, 9000, (1500, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "px double, py double")
    got = hexagons.with_hexagon(df, F.col("px"), F.col("py"), radius)
    cx, cy = hexagons.centre(radius)
    h = math.sqrt(3) * radius
    c = np.arange(math.floor(-2600 / (1.5 * radius)), math.ceil(9600 / (1.5 * radius)))
    k = np.arange(math.floor(-2600 / h) - 1, math.ceil(9600 / h) + 1)
    cc, kk = (a.ravel() for a in np.meshgrid(c, k))
    gx, gy = radius + 1.5 * radius * cc, h * (kk + 0.5 + 0.5 * (cc % 2))
    for r in got.withColumns({"cx": cx, "cy": cy}).collect():
        d = (gx - r["px"]) ** 2 + (gy - r["py"]) ** 2
        best = d.argmin()
        assert (r["hex_c"], r["hex_k"]) == (cc[best], kk[best])
        assert (r["cx"], r["cy"]) == (pytest.approx(gx[best]), pytest.approx(gy[best]))


def test_lattice_does_not_depend_on_the_tile():
    """The per-tile shift of a lattice anchored at each tile's corner restores one world lattice."""
    for size in S.HEX_SIZE_CHOICES:
        r = hexagons.radius_of_size(size)
        period_x, period_y = 3.0 * r, hexagons.height(r)
        for tile in (0, 1, 7, 100):
            shift_x = (tile * (S.TILE_SIZE % period_x)) % period_x
            shift_y = (tile * (S.TILE_SIZE % period_y)) % period_y
            for shift, period in ((shift_x, period_x), (shift_y, period_y)):
                off = (tile * S.TILE_SIZE - shift) / period
                assert abs(off - round(off)) < 1e-6
    assert hexagons.radius_of_size(None) == 80.0


def test_hexagon_tiles_equal_clipping(spark):
    """A hexagon is drawn exactly where it overlaps the tile and its border."""
    radius = 300.0
    rng = np.random.default_rng(6)
    cells = [(2, int(c), int(k)) for c, k in zip(rng.integers(-1, 40, 400), rng.integers(-1, 34, 400))]
    trends = spark.createDataFrame(cells, "z int, hex_c bigint, hex_k bigint").distinct()
    got = {}
    for r in hexes.hex_tile_features(trends, radius).collect():
        got.setdefault((r["hex_c"], r["hex_k"]), set()).add((r["x"], r["y"]))
        assert r["ring"][0] == r["ring"][6] and len(r["ring"]) == 7
    angles = np.arange(6) * math.pi / 3
    h = hexagons.height(radius)
    for _, c, k in set(cells):
        cx, cy = radius + 1.5 * radius * c, h * (k + 0.5 + 0.5 * (c % 2))
        ring = list(zip(cx + radius * np.cos(angles), cy + radius * np.sin(angles)))
        want = {(x, y) for x in range(4) for y in range(4)
                if overlap(ring, x * 4096 - 8, y * 4096 - 8, x * 4096 + 4104, y * 4096 + 4104)}
        assert got.get((c, k), set()) == want


def overlap(polygon, x0, y0, x1, y1):
    """Clip the polygon to the rectangle edge by edge; something left means overlap."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        clipped = []
        for a, b in zip(polygon, polygon[1:] + polygon[:1]):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                clipped.append(a)
            if da * db < 0:
                t = da / (da - db)
                clipped.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        polygon = clipped
        if not polygon:
            return False
    return True


def test_wkt_and_json(spark):
    df = points(spark, [(1.5, -2.25)]).select(features.wkt_point(F.col("lng"), F.col("lat")).alias("g"))
    assert df.first()["g"] == "POINT(-2.25 1.5)"
    assert tuple(df.select(features.wkt_x(F.col("g")), features.wkt_y(F.col("g"))).first()) == (-2.25, 1.5)
    text = spark.createDataFrame([('{"1990":3,"2001":1}',)], "t string")
    assert text.select(features.json_to_year_counts(F.col("t"))).first()[0] == {1990: 3, 2001: 1}
    bad = spark.createDataFrame([("{oops",)], "t string")
    with pytest.raises(Exception):
        bad.select(features.json_to_year_counts(F.col("t"))).collect()
