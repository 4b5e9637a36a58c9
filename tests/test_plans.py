"""What the physical plans must look like at scale."""

import re

import pytest
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.operators import boxes, joins, tiles, trends
from sharedrift.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("name", [
    "species_point_trend", "species_group_wide", "hex_trend", "bbox_trend", "chart_series", "tile_json",
    "yearly_shares", "trend_significance", "year_count_strings", "species_group_concat",
])
def test_one_scan_of_the_observations(spark, name):
    plan = final_plan(catalogue.QUERIES[name](spark, SMALL))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoop", "Cartesian", "Python", "ArrowEval", "MapInPandas", "Window"):
        assert operator not in plan


def test_scan_reads_few_columns_and_takes_filters(spark):
    plan = catalogue.point_counts(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line)
    assert "l_extendedprice" not in lineitem and "IsNotNull(l_suppkey)" in lineitem


def test_a_crowded_place_is_split(spark):
    """A third of all rows at one place: the join spreads them over several tasks and loses none."""
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        n = 3000
        rows = spark.range(n).select(
            F.lit(1).alias("orderkey"), F.col("id").cast("int").alias("specieskey"),
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("int").alias("lat_e2"),
            F.lit(0).alias("lng_e2"), F.explode(F.sequence(F.lit(2000), F.lit(2004))).alias("year"),
        ).withColumn("n", F.lit(1).cast("long"))
        out = trends.point_trends(rows)
        at = out.select("lat_e2", F.spark_partition_id().alias("p")).where("lat_e2 = 0").groupBy("p").count()
        parts = {r["p"]: r["count"] for r in at.collect()}
        assert sum(parts.values()) == n // 3 and len(parts) >= 4 and max(parts.values()) < n // 6
        assert out.count() == n
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_copies_are_each_keys_own(spark):
    """The few rows of a key are copied by the measured rows of that key: once for most, over many tasks for a crowded one."""
    n = 100_000
    species = spark.range(n + 50).select(
        F.lit(1).alias("orderkey"), F.col("id").cast("int").alias("specieskey"),
        F.when(F.col("id") < n, 0).otherwise(F.col("id") - n + 1).cast("int").alias("lat_e2"), F.lit(0).alias("lng_e2"),
        F.lit(2000).alias("year"), F.lit(1).cast("long").alias("n"))
    keys = ["orderkey", "lat_e2", "lng_e2"]
    totals = trends.group_totals(species, keys)
    crowded = joins.crowded_keys(totals, keys, "n_rows")
    copies = joins.copied(joins.with_salts(trends.group_year_maps(totals, keys), crowded, keys)).groupBy("lat_e2").count()
    found = {r["lat_e2"]: r["count"] for r in copies.collect()}
    assert found.pop(0) == n // S.ROWS_PER_COPY > 8
    assert found == {k: 1 for k in range(1, 51)}
    assert joins.crowded_keys(totals, keys, "n_rows", 1, 1).count() == 1  # no more are broadcast than allowed
    assert trends.share_trends(species, ("lat_e2", "lng_e2")).count() == n + 50


def test_every_key_meets_its_rows_whatever_the_salts(spark):
    many = spark.range(400).select((F.col("id") % 7).alias("k"), "id").withColumn("k", F.when(F.col("k") < 6, F.col("k")))
    few = spark.createDataFrame([(k, f"v{k}") for k in [*range(9), None]], "k long, v string")
    sizes = many.withColumn("n_rows", F.lit(100))
    got = joins.spread_join(many, few, ["k"], ("id",), sizes=sizes)
    assert got.columns == ["k", "id", "v"] and got.count() == 400
    assert got.where("v <> concat('v', coalesce(cast(k AS string), 'None'))").isEmpty()


def _strips(spark, n):
    """The same narrow box, which cuts a column of cells, asked for n times."""
    return spark.range(n).select(
        "id", F.lit(1).alias("orderkey"), F.lit(5).alias("specieskey"), F.lit(0.0).alias("lat_a"), F.lit(0.05).alias("lng_a"),
        F.lit(1.99).alias("lat_b"), F.lit(0.06).alias("lng_b"), F.lit(2000).alias("min_year"), F.lit(2000).alias("max_year"),
    ).withColumnRenamed("id", "request_id")


def _dense(spark):
    return spark.range(40_000).select(
        F.lit(1).alias("orderkey"), F.lit(5).alias("specieskey"), (F.col("id") / 200).cast("int").alias("lat_e2"),
        (F.col("id") % 200).cast("int").alias("lng_e2"), F.lit(2000).alias("year"), F.lit(1).cast("long").alias("n"))


def test_boxes_look_closer_only_where_their_edge_cuts_dense_cells(spark):
    subject, strip = ["orderkey", "specieskey"], boxes.with_corners_ordered(_strips(spark, 1))

    def met(boxes_, places):
        return sorted((r["size"], r["whole"], r["listed"]) for r in boxes.met_in_cells(boxes_, places, subject).collect())

    # the one cell of five degrees is too dense; four fine cells list all their places
    assert met(strip, _dense(spark)) == [(50, False, 2500)] * 4
    sparse = _dense(spark).where("lat_e2 % 20 = 0 AND lng_e2 % 20 = 5")
    assert met(strip, sparse) == [(500, False, 100)]
    assert boxes.years_in_boxes(strip, sparse, subject).first()["n"] == 10
    world = strip.withColumns({"min_lat": F.lit(-85.0), "max_lat": F.lit(85.0), "min_lng": F.lit(-180.0), "max_lng": F.lit(180.0)})
    [(size, whole, _)] = met(world, _dense(spark))
    assert (size, whole) == (500, True)


def test_a_cell_many_requests_ask_for_is_spread(spark):
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        n, subject = 100_000, ["orderkey", "specieskey"]
        sparse = _dense(spark).where("lat_e2 % 20 = 0 AND lng_e2 % 20 = 5")
        met = boxes.met_in_cells(boxes.with_corners_ordered(_strips(spark, n)), sparse, subject)
        parts = {r["p"]: r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()}
        assert sum(parts.values()) == n and len(parts) >= 6 and max(parts.values()) < n / 3
        plan = final_plan(met)
        assert len([line for line in plan.splitlines() if "SortMergeJoin" in line and "_salt#" in line]) == 2
        few = boxes.years_in_boxes(boxes.with_corners_ordered(_strips(spark, 2000)), _dense(spark), subject)
        assert few.groupBy("n").count().collect() == [(400, 2000)]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_the_pyramid_shuffles_cells_once_for_its_lower_and_once_for_its_upper_zooms(spark):
    plan = final_plan(catalogue.tile_pyramid(spark, SMALL))
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    assert len(dealt) == 2
    assert "sequence(0, 8" not in plan  # no copies for all nine zooms at once


def test_a_task_of_the_pyramid_sums_one_zoom(spark):
    """No cell is copied for several zooms within a task; all zooms read the same two shuffles."""
    plan = final_plan(catalogue.tile_pyramid(spark, SMALL))
    assert "Generate" not in plan and "Union" in plan
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1
    for max_zoom in (0, 3, 4, 6):  # below, at and above the middle zoom
        points = catalogue.exact_points(spark, SMALL, with_name=True)
        found = tiles.tile_pyramid(points, max_zoom).groupBy("z").agg(F.sum("n_obs"), F.sum("n_points")).collect()
        total = points.agg(F.sum("count"), F.count("*")).first()
        assert sorted(tuple(r) for r in found) == [(z, *total) for z in range(max_zoom + 1)]


def test_only_the_groups_of_matching_names_are_counted(spark):
    plan = catalogue.trend_by_name(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2
    counted = [k for k, line in enumerate(plan.splitlines()) if "Aggregate [orderkey" in line]
    pruned = [k for k, line in enumerate(plan.splitlines()) if "Join LeftSemi" in line and "orderkey" in line]
    assert counted and pruned and min(counted) < min(pruned)  # the aggregate stands above the semi-join
