"""The catalogue's queries as plain SQL for another engine, written from the definitions rather than from the Spark
plans: absences are real zero rows, hexagons the nearest of enumerated centres, boxes a direct range test."""

from sharedrift.plans import catalogue as C

OCC = """
occ AS (
  SELECT l_orderkey*10 + l_linenumber AS recordid,
         CAST(NULL AS INTEGER) AS kingdomkey, CAST(NULL AS INTEGER) AS phylumkey, CAST(NULL AS INTEGER) AS classkey,
         CAST(n_regionkey AS INTEGER) AS orderkey, CAST(s_nationkey AS INTEGER) AS familykey,
         CAST(NULL AS INTEGER) AS genuskey,
         CAST(l_suppkey AS INTEGER) AS specieskey, CAST(l_suppkey AS INTEGER) AS taxonkey,
         CASE WHEN o_custkey % 97 = 0 THEN NULL
              ELSE ((o_custkey % 60 * 7919) % 17800) / CAST(100 AS DOUBLE) - 89
                   + (l_partkey % 9 - 4) / CAST(1000 AS DOUBLE) END AS decimallatitude,
         ((o_custkey % 60 * 6133) % 36000) / CAST(100 AS DOUBLE) - 180
           + (l_partkey % 7 - 3) / CAST(1000 AS DOUBLE) AS decimallongitude,
         l_linenumber = 7 AS hasgeospatialissues,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(day(l_shipdate) AS INTEGER) AS day,
         CASE l_returnflag WHEN 'R' THEN 'FOSSIL_SPECIMEN' WHEN 'N' THEN 'HUMAN_OBSERVATION'
              ELSE 'PRESERVED_SPECIMEN' END AS basisofrecord,
         o_orderpriority AS datasetkey, o_orderstatus AS publishingorgkey, n_name AS countrycode,
         s_name AS scientificname
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

CLEAN = OCC + """,
clean AS (
  SELECT *, decimallatitude AS lat, decimallongitude AS lng,
         CAST(round(round(decimallatitude, 2) * 100) AS INTEGER) AS lat_e2,
         CAST(round(round(decimallongitude, 2) * 100) AS INTEGER) AS lng_e2
  FROM occ
  WHERE orderkey IS NOT NULL AND specieskey IS NOT NULL AND decimallatitude BETWEEN -85 AND 85 AND decimallongitude BETWEEN -180 AND 180
    AND hasgeospatialissues = false AND year >= 1900
    AND basisofrecord <> 'FOSSIL_SPECIMEN' AND basisofrecord <> 'LIVING_SPECIMEN')"""

EXACT = CLEAN + """,
exact_points AS (
  SELECT orderkey, specieskey, scientificname, year, lat, lng, count(*) AS "count"
  FROM clean GROUP BY ALL)"""

SPY = CLEAN + """,
spy AS (
  SELECT orderkey, specieskey, lat_e2, lng_e2, year, count(*) AS n FROM clean GROUP BY ALL)"""

GPY = SPY + """,
gpy AS (
  SELECT orderkey, lat_e2, lng_e2, year, CAST(sum(n) AS BIGINT) AS n FROM spy GROUP BY ALL)"""

LAT, LNG = "lat_e2 / CAST(100 AS DOUBLE)", "lng_e2 / CAST(100 AS DOUBLE)"

# P(|T| > t): finite series, even and odd degrees of freedom nu
P_VALUE = """greatest(0.0, 1 - CASE WHEN nu % 2 = 1 THEN
      2 / pi() * (atan(t / sqrt(nu)) + t / sqrt(nu + t * t) * coalesce(list_sum(list_transform(
        range(0, (nu - 1) // 2), lambda j: sqrt(nu / (nu + t * t)) * coalesce(list_product(list_transform(
          range(1, j + 1), lambda i: 2.0 * i / (2.0 * i + 1) * nu / (nu + t * t))), 1))), 0))
    ELSE
      t / sqrt(nu + t * t) * list_sum(list_transform(
        range(0, nu // 2), lambda j: coalesce(list_product(list_transform(
          range(1, j + 1), lambda i: (2.0 * i - 1) / (2.0 * i) * nu / (nu + t * t))), 1)))
    END)"""


def json_map(key: str, value: str) -> str:
    return f"""'{{' || coalesce(string_agg('"' || {key} || '":' || {value}, ',' ORDER BY {key}), '') || '}}'"""


def stats_cte(keys: str, min_fit: int, source: str = "filled") -> str:
    """Fit statistics per key from rows (keys, year, n, g): the share n/g on year, zero rows included."""
    return f""",
moments AS (
  SELECT {keys}, count(year) AS cnt, count(CASE WHEN seen THEN 1 END) AS species_years,
         regr_sxx(n / CAST(g AS DOUBLE), CAST(year AS DOUBLE)) AS sxx,
         CASE WHEN max(n / CAST(g AS DOUBLE)) = min(n / CAST(g AS DOUBLE)) THEN 0
              ELSE regr_syy(n / CAST(g AS DOUBLE), CAST(year AS DOUBLE)) END AS syy,
         CASE WHEN max(n / CAST(g AS DOUBLE)) = min(n / CAST(g AS DOUBLE)) THEN 0
              ELSE regr_sxy(n / CAST(g AS DOUBLE), CAST(year AS DOUBLE)) END AS sxy,
         avg(CAST(year AS DOUBLE)) AS mx, avg(n / CAST(g AS DOUBLE)) AS my,
         {json_map("year", "n")} AS all_counts,
         '{{' || coalesce(string_agg('"' || year || '":' || n, ',' ORDER BY year) FILTER (WHERE seen), '') || '}}'
           AS seen_counts,
         {json_map("year", "g")} AS group_counts
  FROM {source} GROUP BY {keys}),
errors AS (
  SELECT *, CASE WHEN cnt >= {min_fit} AND cnt >= 2 AND sxx > 0 THEN sxy / sxx END AS slope,
         CASE WHEN cnt >= {min_fit} AND cnt >= 2 AND sxx > 0 THEN greatest(0, syy - sxy * sxy / sxx) END AS sse
  FROM moments),
tested AS (
  SELECT *, CASE WHEN cnt >= 3 THEN sse / (cnt - 2) END AS mse,
         CASE WHEN cnt >= 3 THEN sqrt(sse / (cnt - 2) / sxx) END AS slope_stderr, cnt - 2 AS nu,
         CASE WHEN cnt >= 3 AND sse > 0 THEN abs(slope) / sqrt(sse / (cnt - 2) / sxx) END AS t
  FROM errors),
fit AS (
  SELECT *, my - slope * mx AS intercept, sqrt(mse * (1.0 / cnt + mx * mx / sxx)) AS intercept_stderr,
         CASE WHEN t IS NOT NULL THEN {P_VALUE} WHEN slope_stderr = 0 AND slope <> 0 THEN 0 END AS significance
  FROM tested)"""


def filled_cte(place: str, min_years: int, source: str) -> str:
    """Rows of every species at every place it was seen in enough years: one per group year, zeros included."""
    place_list = f", {place}" if place else ""
    on_place = "".join(f" AND k.{c} = t.{c}" for c in place.split(", ") if c)
    on_same = "".join(f" AND k.{c} = s.{c}" for c in place.split(", ") if c)
    k_place = "".join(f", k.{c}" for c in place.split(", ") if c)
    return f""",
totals AS (SELECT orderkey{place_list}, year, CAST(sum(n) AS BIGINT) AS g FROM {source} GROUP BY ALL),
kept AS (SELECT orderkey, specieskey{place_list} FROM {source} GROUP BY ALL HAVING count(*) >= {min_years}),
filled AS (
  SELECT k.orderkey, k.specieskey{k_place}, t.year, t.g, coalesce(s.n, 0) AS n, s.n IS NOT NULL AS seen
  FROM kept k JOIN totals t ON k.orderkey = t.orderkey{on_place}
  LEFT JOIN {source} s ON k.specieskey = s.specieskey AND k.orderkey = s.orderkey AND s.year = t.year{on_same})"""


def stat_columns() -> str:
    return ", ".join(f"round({name}, {d}) + 0.0 AS {name}" for name, d in C.DECIMALS.items())


def trend_select(keys: str, extra: str = "", species_counts: str = "all_counts") -> str:
    return f"""
SELECT {keys}, species_years, cnt AS group_years, {stat_columns()},
       {species_counts} AS species_counts, group_counts{extra} FROM fit"""


POINT_FIT = SPY + filled_cte("lat_e2, lng_e2", 1, "spy") + stats_cte("orderkey, specieskey, lat_e2, lng_e2", 3)

SPECIES_YEAR = CLEAN + """,
sy AS (SELECT orderkey, specieskey, year, count(*) AS n FROM clean GROUP BY ALL)"""
SPECIES_FIT = SPECIES_YEAR + filled_cte("", 1, "sy") + stats_cte("orderkey, specieskey", 3)

PX = f"({LNG} + 180) / 360 * 4096 * (2 ** z)"
PY = f"""(0.5 - ln((1 + sin(radians({LAT}))) / (1 - sin(radians({LAT})))) / (4 * pi())) * 4096 * (2 ** z)"""
R = C.HEX_RADIUS


def hex_cte(radius: float, source: str = "spy") -> str:
    """Hexagon counts; every centre within two columns and rows of the place is tried, and the nearest wins."""
    return f""",
places AS (SELECT DISTINCT lat_e2, lng_e2 FROM {source}),
zooms AS (SELECT unnest({list(C.HEX_ZOOMS)}) AS z),
pixels AS (SELECT lat_e2, lng_e2, z, {PX} AS px, {PY} AS py FROM places, zooms),
candidates AS (
  SELECT lat_e2, lng_e2, z, px, py, c, floor(py / (sqrt(3.0) * {radius})) + dk AS k,
         {radius} + 1.5 * {radius} * c AS cx
  FROM (SELECT *, CAST(floor(px / (1.5 * {radius})) AS BIGINT) + unnest(range(-2, 3)) AS c FROM pixels),
       (SELECT unnest(range(-2, 3)) AS dk)),
centred AS (
  SELECT *, sqrt(3.0) * {radius} * (k + 0.5 + CASE WHEN c % 2 <> 0 THEN 0.5 ELSE 0 END) AS cy FROM candidates),
nearest AS (
  SELECT lat_e2, lng_e2, z, arg_min(c, (px - cx) ** 2 + (py - cy) ** 2) AS hex_c,
         CAST(arg_min(k, (px - cx) ** 2 + (py - cy) ** 2) AS BIGINT) AS hex_k
  FROM centred GROUP BY ALL),
hy AS (
  SELECT orderkey, specieskey, CAST(z AS INTEGER) AS z, hex_c, hex_k, year, CAST(sum(n) AS BIGINT) AS n
  FROM {source} JOIN nearest USING (lat_e2, lng_e2) GROUP BY ALL)"""


HEX = SPY + hex_cte(R)
HEX_KEYS = "orderkey, specieskey, z, hex_c, hex_k"


def hex_fit_cte(radius: float, min_years: int) -> str:
    return filled_cte("z, hex_c, hex_k", min_years, "hy") + stats_cte(HEX_KEYS, 3) + f""",
hexes AS (
  SELECT *, {radius} + 1.5 * {radius} * hex_c AS cx,
         sqrt(3.0) * {radius} * (hex_k + 0.5 + CASE WHEN hex_c % 2 <> 0 THEN 0.5 ELSE 0 END) AS cy FROM fit),
named AS (
  SELECT *, CAST(round_even(90 - 360 * atan(exp(-(0.5 - cy / (4096 * 2 ** z)) * 2 * pi())) / pi(), 3) + 0.0
                 AS DOUBLE)::VARCHAR || ',' ||
            CAST(round_even(360 * (cx / (4096 * 2 ** z) - 0.5), 3) + 0.0 AS DOUBLE)::VARCHAR AS hex_id
  FROM hexes)"""


HEX_FIT = HEX + hex_fit_cte(R, C.HEX_MIN_YEARS)
HEX_SELECT = f"""
SELECT {HEX_KEYS}, hex_id, species_years, cnt AS group_years, {stat_columns()},
       CASE WHEN cnt >= 3 THEN all_counts ELSE seen_counts END AS species_counts, group_counts FROM named"""

WINDOW = SPY + f""",
windowed AS (SELECT * FROM spy WHERE year BETWEEN {C.RANGE[0]} AND {C.RANGE[1]})"""
POINT_WINDOW_FIT = WINDOW + filled_cte("lat_e2, lng_e2", C.RANGE_MIN_YEARS, "windowed") + stats_cte(
    "orderkey, specieskey, lat_e2, lng_e2", 3)
HEX_WINDOW_FIT = WINDOW + hex_cte(16.0 * C.HEX_SIZE, "windowed") + hex_fit_cte(16.0 * C.HEX_SIZE, C.RANGE_MIN_YEARS)

BOX_FIT = GPY + f""",
requests AS (
  SELECT s_suppkey AS request_id, CAST(s_suppkey AS INTEGER) AS specieskey,
         CAST(s_suppkey * 37 % 130 - 80 AS DOUBLE) AS min_lat,
         CAST(s_suppkey * 37 % 130 - 80 + s_suppkey % 5 * 10 + 15 AS DOUBLE) AS max_lat,
         CAST(s_suppkey * 53 % 300 - 175 AS DOUBLE) AS min_lng,
         CAST(s_suppkey * 53 % 300 - 175 + s_suppkey % 7 * 10 + 20 AS DOUBLE) AS max_lng,
         CASE WHEN s_suppkey % 2 = 1 THEN 1996 ELSE 1995 END AS min_year,
         CASE WHEN s_suppkey % 3 = 0 THEN 2000 ELSE 2001 END AS max_year
  FROM supplier
  UNION ALL
  SELECT s_suppkey + {C.CLOSE_REQUESTS}, CAST(s_suppkey AS INTEGER), (lat_e2 - s_suppkey % 3) / CAST(100 AS DOUBLE),
         (lat_e2 + s_suppkey % 5 * 45) / CAST(100 AS DOUBLE), (lng_e2 - s_suppkey % 4) / CAST(100 AS DOUBLE),
         (lng_e2 + s_suppkey % 7 * 30) / CAST(100 AS DOUBLE), 1992, 1999
  FROM (SELECT s_suppkey, s_suppkey % 60 * 7919 % 17800 - 8900 AS lat_e2, s_suppkey % 60 * 6133 % 36000 - 18000 AS lng_e2
        FROM supplier)),
answered AS (
  SELECT DISTINCT r.*, s.orderkey FROM requests r JOIN spy s USING (specieskey)
  WHERE s.year BETWEEN r.min_year AND r.max_year),
box_group AS (
  SELECT a.request_id, g.year, sum(g.n) AS g FROM answered a JOIN gpy g
    ON g.orderkey = a.orderkey AND g.year BETWEEN a.min_year AND a.max_year
   AND g.lat_e2 / CAST(100 AS DOUBLE) BETWEEN a.min_lat AND a.max_lat
   AND g.lng_e2 / CAST(100 AS DOUBLE) BETWEEN a.min_lng AND a.max_lng GROUP BY ALL),
box_species AS (
  SELECT a.request_id, s.year, sum(s.n) AS n FROM answered a JOIN spy s
    ON s.specieskey = a.specieskey AND s.year BETWEEN a.min_year AND a.max_year
   AND s.lat_e2 / CAST(100 AS DOUBLE) BETWEEN a.min_lat AND a.max_lat
   AND s.lng_e2 / CAST(100 AS DOUBLE) BETWEEN a.min_lng AND a.max_lng GROUP BY ALL),
filled AS (
  SELECT a.request_id, a.orderkey, a.specieskey, a.min_year, a.max_year, b.year, b.g,
         CASE WHEN b.year IS NOT NULL THEN coalesce(s.n, 0) END AS n, s.n IS NOT NULL AS seen
  FROM answered a LEFT JOIN box_group b USING (request_id)
  LEFT JOIN box_species s ON s.request_id = a.request_id AND s.year = b.year)""" + stats_cte(
    "request_id, orderkey, specieskey, min_year, max_year", 2)

AXIS = BOX_FIT + """,
axis AS (SELECT *, CAST(unnest(range(min_year, max_year)) AS INTEGER) AS year FROM fit),
series AS (
  SELECT a.request_id, a.specieskey, a.year, a.slope * a.year + a.intercept AS line,
         f.n / CAST(f.g AS DOUBLE) AS share, f.g
  FROM axis a LEFT JOIN filled f ON f.request_id = a.request_id AND f.year = a.year)"""

UNIT_X, UNIT_Y = "(lng / 360 + 0.5)", "(0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()))"
GRID10 = CLEAN + f""",
grid AS (
  SELECT specieskey, year, CAST(floor({UNIT_X} * 1024) AS BIGINT) AS x,
         CAST(floor({UNIT_Y} * 1024) AS BIGINT) AS y, count(*) AS "count"
  FROM clean GROUP BY ALL)"""

CELLS = EXACT + f""",
cells AS (
  SELECT specieskey, year, CAST(floor({UNIT_X} * 16) AS BIGINT) AS x, CAST(floor({UNIT_Y} * 16) AS BIGINT) AS y,
         CAST(floor({UNIT_X} * 512) AS BIGINT) AS x1, CAST(floor({UNIT_Y} * 512) AS BIGINT) AS y1,
         CAST(sum("count") AS BIGINT) AS "count"
  FROM exact_points GROUP BY ALL)"""

PYRAMID = EXACT + f""",
pyramid AS (
  SELECT orderkey, specieskey, CAST(z AS INTEGER) AS z,
         CAST(floor({UNIT_X} * 2 ** z) AS BIGINT) AS x, CAST(floor({UNIT_Y} * 2 ** z) AS BIGINT) AS y,
         CAST(floor({UNIT_X} * 2 ** (z + 3)) AS BIGINT) || ':' || CAST(floor({UNIT_Y} * 2 ** (z + 3)) AS BIGINT)
           AS cellid,
         year, count(*) AS n_points, CAST(sum("count") AS BIGINT) AS n_obs
  FROM exact_points, (SELECT unnest(range(0, 9)) AS z) GROUP BY ALL),
flagged AS (
  SELECT *, false AS is_group FROM pyramid
  UNION ALL BY NAME
  SELECT orderkey, orderkey AS specieskey, z, x, y, cellid, year, CAST(sum(n_points) AS BIGINT) AS n_points,
         CAST(sum(n_obs) AS BIGINT) AS n_obs, true AS is_group
  FROM pyramid GROUP BY orderkey, z, x, y, cellid, year)"""


def documents(source: str, keys: str) -> str:
    return f""",
per_year AS (
  SELECT {keys}, year, {json_map("cellid", "n_points")} AS cells
  FROM (SELECT * REPLACE (cellid AS cellid) FROM {source}) GROUP BY {keys}, year),
docs AS (SELECT {keys}, {json_map("year", "cells")} AS "json" FROM per_year GROUP BY {keys})"""


OLS = SPECIES_YEAR + """,
m AS (
  SELECT orderkey, specieskey, count(*) AS cnt, avg(CAST(year AS DOUBLE)) AS mx, avg(CAST(n AS DOUBLE)) AS my,
         regr_sxx(CAST(n AS DOUBLE), CAST(year AS DOUBLE)) AS sxx,
         regr_syy(CAST(n AS DOUBLE), CAST(year AS DOUBLE)) AS syy,
         regr_sxy(CAST(n AS DOUBLE), CAST(year AS DOUBLE)) AS sxy
  FROM sy GROUP BY ALL),
o AS (
  SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS m, CASE WHEN sxx > 0 THEN sxy * sxy / sxx END AS ssr,
         CASE WHEN sxx > 0 THEN greatest(0, syy - sxy * sxy / sxx) END AS sse FROM m)"""

_lo, _hi = C.RANGE

_SLOPE = 'CASE WHEN count(*) >= 2 THEN regr_slope(CAST("count" AS DOUBLE), CAST(year AS DOUBLE)) END'

SELECTS: dict[str, str] = {
    "occurrence_snapshot": OCC + """
SELECT * REPLACE (round(decimallatitude, 6) AS decimallatitude, round(decimallongitude, 6) AS decimallongitude)
FROM occ""",
    "snapshot_orc_round_trip": OCC + """
SELECT * REPLACE (round(decimallatitude, 6) AS decimallatitude, round(decimallongitude, 6) AS decimallongitude)
FROM occ""",
    "quality_filter_counts": CLEAN + """
SELECT orderkey, year, basisofrecord, count(*) AS records FROM clean GROUP BY ALL""",
    "species_point_year_exact": EXACT + """
SELECT orderkey, specieskey, year, round(lat, 6) + 0.0 AS lat, round(lng, 6) + 0.0 AS lng, "count"
FROM exact_points""",
    "species_point_year": SPY + f"""
SELECT orderkey, specieskey, year, {LAT} AS lat, {LNG} AS lng, n FROM spy""",
    "group_point_year": GPY + f"""
SELECT orderkey, year, {LAT} AS lat, {LNG} AS lng, n FROM gpy""",
    "group_point_year_direct": CLEAN + f"""
SELECT orderkey, year, {LAT} AS lat, {LNG} AS lng, count(*) AS n FROM clean GROUP BY ALL""",
    "species_group_wide": GPY + f"""
SELECT s.orderkey, s.specieskey, s.year, s.lat_e2 / CAST(100 AS DOUBLE) AS lat, s.lng_e2 / CAST(100 AS DOUBLE) AS lng,
       s.n AS speciescount, g.n AS ordercount
FROM spy s JOIN gpy g ON s.orderkey = g.orderkey AND s.lat_e2 = g.lat_e2 AND s.lng_e2 = g.lng_e2
 AND s.year = g.year""",
    "species_names": CLEAN + """
SELECT scientificname, specieskey, count(year) AS records FROM clean WHERE specieskey = taxonkey
GROUP BY ALL HAVING count(year) > 1""",
    "name_autocomplete": CLEAN + f"""
SELECT specieskey, scientificname FROM clean WHERE specieskey = taxonkey AND scientificname LIKE '{C.NAME_PATTERN}%'
GROUP BY ALL HAVING count(year) > 1 ORDER BY scientificname, specieskey LIMIT 25""",
    "species_year_maps": SPY + f"""
SELECT specieskey, 'POINT(' || ({LNG}) || ' ' || ({LAT}) || ')' AS geom, {json_map("year", "n")} AS yearcounts
FROM spy GROUP BY specieskey, lat_e2, lng_e2""",
    "group_year_maps": GPY + f"""
SELECT orderkey, 'POINT(' || ({LNG}) || ' ' || ({LAT}) || ')' AS geom, {json_map("year", "n")} AS yearcounts
FROM gpy GROUP BY orderkey, lat_e2, lng_e2""",
    "species_points": SPY + f"""
SELECT specieskey, {LNG} AS longitude, {LAT} AS latitude, year, n FROM spy""",
    "group_points": GPY + f"""
SELECT orderkey, {LNG} AS longitude, {LAT} AS latitude, year, n FROM gpy""",
    "features_tsv_round_trip": SPY + f"""
SELECT specieskey, {LNG} AS longitude, {LAT} AS latitude, year, n FROM spy""",
    "wkt_round_trip": SPY + f"""
SELECT specieskey, year, 'POINT(' || ({LNG}) || ' ' || ({LAT}) || ')' AS geom, n, {LNG} AS x, {LAT} AS y FROM spy""",
    "json_round_trip": SPY + f"""
SELECT specieskey, lat_e2, lng_e2, {json_map("year", "n")} AS text, count(*) AS years,
       CAST(sum(n) AS BIGINT) AS records
FROM spy GROUP BY specieskey, lat_e2, lng_e2""",
    "species_group_concat": GPY + f"""
SELECT s.orderkey, s.specieskey, s.lng_e2 / CAST(100 AS DOUBLE) AS x, s.lat_e2 / CAST(100 AS DOUBLE) AS y,
       string_agg(s.year || ',' || s.n || ',' || g.n, ',' ORDER BY s.year) AS features
FROM spy s JOIN gpy g ON s.orderkey = g.orderkey AND s.lat_e2 = g.lat_e2 AND s.lng_e2 = g.lng_e2
 AND s.year = g.year
WHERE s.year BETWEEN {_lo} AND {_hi}
GROUP BY s.orderkey, s.specieskey, s.lat_e2, s.lng_e2 HAVING count(s.year) >= {C.RANGE_MIN_YEARS}""",
    "year_count_strings": GPY + """
SELECT 'species' AS level, specieskey AS key, lat_e2, lng_e2,
       string_agg(year || ':' || n, ',' ORDER BY year) AS yearcounts FROM spy GROUP BY specieskey, lat_e2, lng_e2
UNION ALL
SELECT 'group' AS level, orderkey AS key, lat_e2, lng_e2,
       string_agg(year || ':' || n, ',' ORDER BY year) AS yearcounts FROM gpy GROUP BY orderkey, lat_e2, lng_e2""",
    "year_range_features": SPY + f"""
SELECT specieskey, {LAT} AS lat, {LNG} AS lng, {json_map("year", "n")} AS yearcounts
FROM spy WHERE year BETWEEN {_lo} AND {_hi}
GROUP BY specieskey, lat_e2, lng_e2 HAVING count(*) >= {C.RANGE_MIN_YEARS}""",
    "species_point_trend": POINT_FIT + trend_select(
        f"orderkey, specieskey, {LAT} AS lat, {LNG} AS lng"),
    "yearly_shares": SPY + filled_cte("lat_e2, lng_e2", 1, "spy") + f"""
SELECT orderkey, specieskey, {LAT} AS lat, {LNG} AS lng, year, n AS species_n, g AS group_n,
       round(n / CAST(g AS DOUBLE), 9) + 0.0 AS share FROM filled""",
    "hex_year_counts": HEX + """
SELECT * FROM hy""",
    "hex_trend": HEX_FIT + HEX_SELECT,
    "hex_trend_window": HEX_WINDOW_FIT + HEX_SELECT,
    "species_point_trend_window": POINT_WINDOW_FIT + trend_select(
        f"orderkey, specieskey, {LAT} AS lat, {LNG} AS lng"),
    "species_keyed_read": EXACT + f"""
SELECT orderkey, specieskey, year, round(lat, 6) + 0.0 AS lat, round(lng, 6) + 0.0 AS lng, "count"
FROM exact_points WHERE specieskey IN {C.READ_SPECIES}""",
    "group_keyed_read": GPY + f"""
SELECT orderkey, 'POINT(' || ({LNG}) || ' ' || ({LAT}) || ')' AS geom, {json_map("year", "n")} AS yearcounts
FROM gpy WHERE orderkey = {C.READ_GROUP} GROUP BY orderkey, lat_e2, lng_e2""",
    "job_wide_records": GPY + f"""
SELECT s.specieskey, 'POINT(' || (s.lng_e2 / CAST(100 AS DOUBLE)) || ' ' || (s.lat_e2 / CAST(100 AS DOUBLE)) || ')' AS geom,
       s.year, s.n AS speciescount, g.n AS ordercount
FROM spy s JOIN gpy g ON s.orderkey = g.orderkey AND s.lat_e2 = g.lat_e2 AND s.lng_e2 = g.lng_e2
 AND s.year = g.year""",
    "points_compacted": EXACT + """
SELECT orderkey, specieskey, year, round(lat, 6) + 0.0 AS lat, round(lng, 6) + 0.0 AS lng, "count"
FROM exact_points""",
    "bbox_trend": BOX_FIT + trend_select("request_id, orderkey, specieskey"),
    "trend_by_name": SPECIES_FIT + f""",
names AS (
  SELECT scientificname, specieskey FROM clean WHERE specieskey = taxonkey GROUP BY ALL HAVING count(year) > 1)
SELECT specieskey, scientificname, orderkey, cnt AS group_years, round(slope, 9) + 0.0 AS slope,
       round(significance, 6) + 0.0 AS significance
FROM names JOIN fit USING (specieskey) WHERE scientificname LIKE '{C.NAME_PATTERN}%'""",
    "trend_significance": SPECIES_FIT + """
SELECT orderkey, specieskey, cnt AS group_years, round(slope, 9) + 0.0 AS slope,
       round(slope_stderr, 9) + 0.0 AS slope_stderr, round(significance, 9) + 0.0 AS significance FROM fit""",
    "ols_sums_of_squares": OLS + """
SELECT orderkey, specieskey, round(m, 6) + 0.0 AS m, round(my - m * mx, 3) + 0.0 AS c, round(syy, 6) + 0.0 AS ssto,
       round(ssr, 6) + 0.0 AS ssr, round(sse, 6) + 0.0 AS sse FROM o""",
    "ols_diagnostics": OLS + """
SELECT orderkey, specieskey, CASE WHEN syy > 0 THEN round(ssr / syy, 8) + 0.0 END AS r2,
       CASE WHEN cnt > 2 THEN round(sse / (cnt - 2), 6) + 0.0 END AS residual_variance,
       CASE WHEN cnt > 2 THEN round(sqrt(sse / (cnt - 2) / sxx), 6) + 0.0 END AS slope_stderr,
       CASE WHEN cnt > 2 THEN round(sqrt(sse / (cnt - 2) * (1.0 / cnt + mx * mx / sxx)), 3) + 0.0 END
         AS intercept_stderr,
       CASE WHEN cnt > 2 THEN round(sqrt(sse / (cnt - 2) * (sxx + cnt * mx * mx) / (cnt * sxx)), 3) + 0.0 END
         AS intercept_stderr_alt
FROM o""",
    "cell_year_counts": CELLS + """
SELECT * FROM cells""",
    "cell_slopes": CELLS + f"""
SELECT specieskey, x, y, x1, y1, round({_SLOPE}, 9) + 0.0 AS slope, {json_map("year", '"count"')} AS year_counts
FROM cells GROUP BY specieskey, x, y, x1, y1""",
    "grid10_counts": GRID10 + """
SELECT * FROM grid""",
    "grid10_slopes": GRID10 + f"""
SELECT specieskey, x, y, round({_SLOPE}, 9) + 0.0 AS slope FROM grid GROUP BY specieskey, x, y""",
    "mllib_mse": GRID10 + """,
train AS (
  SELECT CAST("count" AS DOUBLE) AS label, CAST(year AS DOUBLE) AS feature FROM grid
  WHERE substr(md5(specieskey || ':' || year || ':' || x || ':' || y), 1, 4) < 'b333'),
model AS (SELECT regr_slope(label, feature) AS m, regr_intercept(label, feature) AS c FROM train)
SELECT count(*) AS n, round(avg((label - (m * feature + c)) ** 2), 9) + 0.0 AS mse FROM train, model""",
    "mercator_tiles": EXACT + f"""
SELECT specieskey, year, round(lat, 6) + 0.0 AS lat, round(lng, 6) + 0.0 AS lng, round({UNIT_X}, 9) AS unit_x,
       round({UNIT_Y}, 9) AS unit_y, CAST(floor({UNIT_X} * 16) AS BIGINT) AS x4,
       CAST(floor({UNIT_Y} * 16) AS BIGINT) AS y4, CAST(floor({UNIT_X} * 512) AS BIGINT) AS x9,
       CAST(floor({UNIT_Y} * 512) AS BIGINT) AS y9,
       CAST(greatest(least(floor({UNIT_X} * 512), 511), 0) AS BIGINT) AS cx,
       CAST(greatest(least(floor({UNIT_Y} * 512), 511), 0) AS BIGINT) AS cy
FROM exact_points""",
    "mercator_pixels": EXACT + """,
p AS (
  SELECT *, (lng + 180) / 360 * 262144 AS px,
         (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 262144 AS py
  FROM exact_points),
t AS (
  SELECT *, CAST(floor(least(greatest(px / 4096, 0), 63)) AS BIGINT) AS tile_x,
         CAST(floor(least(greatest(py / 4096, 0), 63)) AS BIGINT) AS tile_y FROM p)
SELECT specieskey, year, tile_x, tile_y, round(lat, 6) + 0.0 AS lat, round(lng, 6) + 0.0 AS lng,
       round(px, 4) + 0.0 AS px, round(py, 4) + 0.0 AS py,
       round(360 * (px / 262144 - 0.5), 6) + 0.0 AS back_lng,
       round(90 - 360 * atan(exp(-(0.5 - py / 262144) * 2 * pi())) / pi(), 6) + 0.0 AS back_lat,
       round(360 * (tile_x * 4096 / CAST(262144 AS DOUBLE) - 0.5), 6) + 0.0 AS corner_lng,
       round(90 - 360 * atan(exp(-(0.5 - tile_y * 4096 / CAST(262144 AS DOUBLE)) * 2 * pi())) / pi(), 6) + 0.0
         AS corner_lat,
       round(cos(radians(lat)) * 40075016.686 / 262144, 6) + 0.0 AS metres
FROM t""",
    "tile_pyramid": PYRAMID + """
SELECT * FROM pyramid""",
    "pyramid_with_group": PYRAMID + """
SELECT * FROM flagged""",
    "tile_json": PYRAMID + documents("flagged", "specieskey, z, x, y, is_group") + """
SELECT * FROM docs""",
    "tile_table_round_trip": PYRAMID + documents("pyramid", "specieskey, z, x, y") + """
SELECT * FROM docs""",
    "point_tile_features": POINT_FIT + f""",
placed AS (
  SELECT orderkey, specieskey, lat_e2, lng_e2, CAST(z AS INTEGER) AS z, slope, significance, {PX} AS px, {PY} AS py
  FROM fit, (SELECT unnest({list(C.POINT_ZOOMS)}) AS z))
SELECT orderkey, specieskey, lat_e2, lng_e2, z, CAST(floor(px / 4096) AS BIGINT) AS x,
       CAST(floor(py / 4096) AS BIGINT) AS y, CAST(floor(px % 4096) AS BIGINT) AS local_x,
       CAST(floor(py % 4096) AS BIGINT) AS local_y, round(slope, 9) + 0.0 AS slope,
       round(significance, 6) + 0.0 AS significance
FROM placed""",
    # a hexagon is on a tile when no separating line exists between it and the tile with its border
    "hex_tile_features": HEX_FIT + f""",
all_tiles AS (SELECT z, unnest(range(0, CAST(2 ** z AS BIGINT))) AS x FROM zooms),
tiles AS (SELECT a.z, a.x, b.x AS y FROM all_tiles a JOIN all_tiles b USING (z)),
pairs AS (
  SELECT h.*, t.x, t.y, abs(cx - (t.x * 4096 + 2048)) AS dx, abs(cy - (t.y * 4096 + 2048)) AS dy
  FROM named h JOIN tiles t USING (z)),
drawn AS (
  SELECT * FROM pairs WHERE dx <= {R} + 2056 AND dy <= sqrt(3.0) / 2 * {R} + 2056
     AND dx * cos(pi() / 6) + dy * sin(pi() / 6)
         <= sqrt(3.0) / 2 * {R} + 2056 * (cos(pi() / 6) + sin(pi() / 6)))
SELECT orderkey, specieskey, z, x, y, hex_c, hex_k, hex_id, round(slope, 9) + 0.0 AS slope,
       'POLYGON((' || list_aggregate(list_transform([0, 1, 2, 3, 4, 5, 0], lambda i:
          CAST(round(cx - x * 4096 + {R} * cos(i * pi() / 3), 2) + 0.0 AS VARCHAR) || ' ' ||
          CAST(round(cy - y * 4096 + {R} * sin(i * pi() / 3), 2) + 0.0 AS VARCHAR)), 'string_agg', ', ')
       || '))' AS ring
FROM drawn""",
    "chart_series": AXIS + """
SELECT request_id, specieskey, year, round(share, 9) + 0.0 AS share, round(line, 6) + 0.0 AS line,
       CASE WHEN max(g) OVER w > 0
            THEN round(coalesce(max(share) OVER w, 0) * coalesce(g, 0) / CAST(max(g) OVER w AS DOUBLE), 8) + 0.0
       END AS group_line
FROM series WINDOW w AS (PARTITION BY request_id)""",
    "trend_summary": BOX_FIT + """,
ends AS (
  SELECT *, slope * min_year + intercept AS a, slope * (max_year - 1) + intercept AS b FROM fit)
SELECT request_id, specieskey, floor(1000000 * slope + 0.5) / CAST(100 AS DOUBLE) AS rate_per_10k,
       CASE WHEN a > 1e-10 * greatest(abs(a), abs(b)) AND b > 1e-10 * greatest(abs(a), abs(b)) THEN CAST(floor(100 * b / a + 0.5) AS BIGINT) END AS level_ratio_pct,
       CASE WHEN a > 1e-10 * greatest(abs(a), abs(b)) AND b > 1e-10 * greatest(abs(a), abs(b)) THEN CAST(floor(100 * b / a + 0.5) AS BIGINT) - 100 END AS change_pct,
       CASE WHEN slope < -1e-13 * greatest(abs(a), abs(b)) THEN 'decline' WHEN slope IS NOT NULL THEN 'no decline' END
         AS direction
FROM ends""",
    "slope_classes": HEX_FIT + f""",
s AS (SELECT {HEX_KEYS}, round(slope, 9) + 0.0 AS slope FROM named)
SELECT *, CAST(CASE WHEN slope IS NULL THEN NULL WHEN slope >= 0.0008 THEN 0 WHEN slope >= 0.0006 THEN 1
       WHEN slope >= 0.0004 THEN 2 WHEN slope >= 0.0002 THEN 3 WHEN slope >= 0 THEN 4 WHEN slope >= -0.0002 THEN 5
       WHEN slope >= -0.0004 THEN 6 WHEN slope >= -0.0006 THEN 7 WHEN slope >= -0.0008 THEN 8 ELSE 9 END AS INTEGER)
         AS slope_class,
       CASE WHEN slope < 0 THEN 'decline' WHEN slope >= 0 THEN 'no decline' END AS direction
FROM s""",
}

# the jobs write what these queries compute
SELECTS |= {"job_tile_documents": SELECTS["tile_json"], "job_grid": SELECTS["grid10_counts"]}

ORACLE_SQL: dict[str, str] = {name: "WITH " + text.strip() for name, text in SELECTS.items()}
