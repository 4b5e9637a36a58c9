import json
import os
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sharedrift import schemas
from sharedrift.functions import features
from sharedrift.operators import counts, filters, names, tiles
from sharedrift.plans import catalogue, jobs
from sharedrift.sources import occurrence, tables

SMALL = "/root/testdata/sf0.001"


def same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and \
        b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_occurrences_as_orc_parquet_and_table(spark, tmp_path):
    snapshot = occurrence.occurrence_snapshot(occurrence.occurrences_from_star(spark, SMALL))
    tables.write_orc(snapshot, f"{tmp_path}/orc")
    tables.write_parquet(snapshot, f"{tmp_path}/parquet")
    assert same_rows(snapshot, occurrence.read_occurrences(spark, f"{tmp_path}/orc", "orc"))
    assert same_rows(snapshot, occurrence.read_occurrences(spark, f"{tmp_path}/parquet", "parquet"))
    assert same_rows(snapshot, tables.read_orc(spark, f"{tmp_path}/orc", schemas.OCCURRENCE))
    tables.save_table(snapshot, "occurrence_snapshot_table", f"{tmp_path}/table")
    assert same_rows(snapshot, occurrence.read_occurrences(spark, "occurrence_snapshot_table"))
    spark.sql("DROP TABLE occurrence_snapshot_table")


def test_a_snapshot_is_laid_out_by_group(spark, tmp_path):
    source = occurrence.occurrences_from_star(spark, SMALL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        occurrence.write_snapshot(source, f"{tmp_path}/snapshot", "parquet")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = occurrence.read_occurrences(spark, f"{tmp_path}/snapshot", "parquet")
    assert same_rows(back, occurrence.occurrence_snapshot(source))
    files = [pq.read_table(f"{tmp_path}/snapshot/{name}", columns=["orderkey"])["orderkey"].to_pylist()
             for name in sorted(os.listdir(f"{tmp_path}/snapshot")) if name.endswith(".parquet")]
    ranges = [(min(keys), max(keys)) for keys in files if keys]
    groups = {key for keys in files for key in keys}
    touched = [sum(low <= key <= high for low, high in ranges) for key in groups]
    assert len(ranges) >= 4 and sum(touched) < len(ranges) + len(groups)  # a border file is read for two groups
    one = filters.quality_filter(back, group_key=3)
    assert "EqualTo(orderkey,3)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == filters.quality_filter(source, group_key=3).count()


def test_tsv_keeps_quotes_and_json(spark, tmp_path):
    rows = [(1, 'Odd "name" \\ here'), (2, "Plain")]
    tables.write_tsv(spark.createDataFrame(rows, schemas.NAMES), f"{tmp_path}/names")
    back = tables.read_tsv(spark, f"{tmp_path}/names", schemas.NAMES)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_wide_records_as_text(spark, tmp_path):
    rows = [(1, "POINT(10.5 -3.25)", 1999, 2, 7)]
    tables.write_tsv(spark.createDataFrame(rows, schemas.WIDE_RECORD_TEXT), f"{tmp_path}/wide")
    assert [tuple(r) for r in tables.read_tsv(spark, f"{tmp_path}/wide", schemas.WIDE_RECORD_TEXT).collect()] == rows


def test_a_small_export_is_one_file(spark, tmp_path):
    tables.compact(spark.range(1000).repartition(7), f"{tmp_path}/one")
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_jdbc_read_is_partitioned():
    options = tables.jdbc_options("jdbc:x", "species_points", "specieskey", 0, 100, 16)
    assert options["partitionColumn"] == "specieskey" and options["numPartitions"] == "16"


def test_shared_folder_is_the_sessions(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = tables.shared_folder(spark), tables.shared_folder(spark)
    assert first.startswith(base) and first != second


def test_jobs_from_observations_to_map(spark, tmp_path):
    source = occurrence.occurrences_from_star(spark, SMALL)
    prepared, out = f"{tmp_path}/prepared", f"{tmp_path}/out"
    jobs.prepare(source, prepared)
    assert same_rows(jobs.read_species_point_year(spark, prepared), catalogue.point_counts(spark, SMALL))

    one = filters.of_species(jobs.read_species_point_year(spark, prepared), 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(specieskey), EqualTo(specieskey,3)]" in plan or "In(specieskey" in plan

    jobs.export_text(spark, prepared, out)
    species = tables.features_from_text(tables.read_tsv(spark, f"{out}/species", schemas.SPECIES_FEATURE_TEXT))
    long = species.select("specieskey", F.explode("year_counts").alias("year", "n"))
    total = jobs.read_species_point_year(spark, prepared).agg(F.sum("n")).first()[0]
    assert long.agg(F.sum("n")).first()[0] == total
    group = tables.features_from_text(tables.read_tsv(spark, f"{out}/group", schemas.GROUP_FEATURE_TEXT))
    assert group.select(F.explode("year_counts").alias("y", "n")).agg(F.sum("n")).first()[0] == total
    assert tables.read_tsv(spark, f"{out}/names", schemas.NAMES).count() > 0

    jobs.cell_slopes(spark, f"{prepared}/points", f"{out}/slopes")
    slopes = tables.read_parquet(spark, f"{out}/slopes", schemas.CELL_SLOPE)
    assert slopes.count() == catalogue.cell_slopes(spark, SMALL).count()

    jobs.tile_documents(spark, f"{prepared}/points", f"{out}/tiles")
    tile = tables.read_tiles(spark, f"{out}/tiles").where("z = 0").first()
    assert all(isinstance(cells, dict) for cells in json.loads(tile["json"]).values())
    # all test years lie after the pyramid's first, so the job's table is the query's, group rows and names included
    assert same_rows(tables.read_tiles(spark, f"{out}/tiles", with_groups=True), catalogue.tile_json(spark, SMALL))
    jobs.tile_documents(spark, f"{prepared}/points", f"{out}/late", min_year=1999)
    years = tables.read_tiles(spark, f"{out}/late", with_groups=True).select(F.explode(F.json_object_keys("json")).alias("y"))
    assert {int(r.y) for r in years.distinct().collect()} == {1999, 2000, 2001}

    jobs.wide_records(spark, prepared, f"{out}/wide")
    wide = tables.read_tsv(spark, f"{out}/wide", schemas.WIDE_RECORD_TEXT)
    want = catalogue.species_group_wide(spark, SMALL).select(
        "specieskey", features.wkt_point(F.col("lng"), F.col("lat")).alias("geom"), "year", "speciescount", "ordercount")
    assert same_rows(wide, want)
    jobs.grid(spark, prepared, f"{out}/grid")
    assert same_rows(tables.read_parquet(spark, f"{out}/grid", schemas.GRID), catalogue.grid10_counts(spark, SMALL))
    assert same_rows(tables.read_parquet(spark, f"{prepared}/names", schemas.NAMES),
                     catalogue.species_names(spark, SMALL).select("specieskey", "scientificname"))

    jobs.map_features(spark, prepared, f"{out}/features", (0, 1), 80.0, (1995, 2001), min_years=2)
    assert spark.read.parquet(f"{out}/features/points").count() > 0
    assert spark.read.parquet(f"{out}/features/hexagons").where("z = 1").count() > 0


def test_prepare_reads_the_observations_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = occurrence.occurrences_from_star(spark, SMALL)
    watched = source.mapInArrow(counted, source.schema)
    jobs.prepare(watched, f"{tmp_path}/prepared")
    assert read.value == source.count()


def test_a_read_by_key_touches_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(
        (F.col("id") * 7919 % 500 * 2).cast("int").alias("specieskey"), F.lit(1).alias("orderkey"), F.lit(2000).alias("year"),
        (F.col("id") % 1700 / 10 - 85).alias("lat"), (F.col("id") % 3600 / 10 - 180).alias("lng"), F.lit(1).cast("long").alias("count"))
    path = f"{tmp_path}/points"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_keyed(rows, path, "specieskey", "lat", "lng")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = [f.metadata.row_group(k).column(f.schema_arrow.get_field_index("specieskey"))
              for name in os.listdir(path) if name.endswith(".parquet")
              for f in [pq.ParquetFile(f"{path}/{name}")] for k in range(f.metadata.num_row_groups)]
    holding = [g for g in groups if g.statistics.min <= 300 <= g.statistics.max]
    assert len(groups) >= 4 and len(holding) <= 2
    assert filters.of_species(tables.read_points(spark, path), 300).count() == rows.where("specieskey = 300").count() > 0
    absent = filters.of_species(tables.read_points(spark, path), 301)  # inside the range of some group: the filter says no
    assert absent.count() == 0
    scanned = absent._jdf.queryExecution().executedPlan().toString()
    assert "specieskey" in scanned.split("PushedFilters")[1]


def test_a_rerun_of_one_zoom_keeps_the_others(spark, tmp_path):
    def documents(z, text):
        return [(k, z, 0, 0, text) for k in range(3)]

    schema, path = "specieskey int, z int, x long, y long, json string", f"{tmp_path}/tiles"
    tables.write_tiles(spark.createDataFrame(documents(0, "a") + documents(1, "a"), schema), path)
    tables.write_tiles(spark.createDataFrame(documents(1, "b"), schema), path, keep_other_zooms=True)
    assert {(r.z, r.json) for r in tables.read_tiles(spark, path).collect()} == {(0, "a"), (1, "b")}
    broken = spark.createDataFrame(documents(1, "c"), schema).withColumn(
        "json", F.when(F.col("specieskey") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="lost"):
        tables.write_tiles(broken, path, keep_other_zooms=True)
    assert {(r.z, r.json) for r in tables.read_tiles(spark, path).collect()} == {(0, "a"), (1, "b")}
    tables.write_tiles(spark.createDataFrame(documents(1, "d"), schema), path)
    assert {(r.z, r.json) for r in tables.read_tiles(spark, path).collect()} == {(1, "d")}


def _scratch(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    return {name for name in os.listdir(base) if name.startswith("sharedrift-")} if os.path.isdir(base) else set()


def test_scratch_goes_when_its_block_ends(spark, tmp_path):
    before = _scratch(spark)
    with tables.Scratch(spark):
        catalogue.mllib_mse(spark, SMALL).write.parquet(f"{tmp_path}/mse")
        with tables.Scratch(spark):
            catalogue.tile_table_round_trip(spark, SMALL).write.parquet(f"{tmp_path}/tiles")
            assert len(_scratch(spark) - before) == 2
        assert len(_scratch(spark) - before) == 1
    assert _scratch(spark) == before
    assert spark.read.parquet(f"{tmp_path}/mse").count() == 1
    with pytest.raises(ZeroDivisionError), tables.Scratch(spark):
        tables.written_once(spark.range(3))
        1 / 0
    assert _scratch(spark) == before


def test_a_table_is_discarded_when_what_was_made_of_it_is_written(spark):
    before = _scratch(spark)
    first = tables.written_once(spark.range(5))
    second = tables.written_once(first.selectExpr("id + 1 AS id"))
    tables.discard(first)
    assert len(_scratch(spark) - before) == 1 and second.count() == 5
    tables.discard(second)
    assert _scratch(spark) == before


def test_a_local_folder_is_refused_on_a_cluster(spark, monkeypatch):
    cluster = SimpleNamespace(
        conf=spark.conf, _jvm=spark._jvm, _jsparkSession=spark._jsparkSession, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="local to each machine"):
        tables.shared_folder(cluster)


def test_a_mounted_folder_is_accepted_on_a_cluster(spark, monkeypatch, tmp_path):
    """Its path looks like one of the local disk; what the executors write there tells."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    before = _scratch(spark)
    table = tables.written_once(spark.range(5))
    assert table.count() == 5 and len(_scratch(spark) - before) == 1  # nothing stays of the trial
    catalogue.points_compacted(spark, SMALL).write.parquet(f"{tmp_path}/points")
    assert same_rows(spark.read.parquet(f"{tmp_path}/points"), catalogue.species_point_year_exact(spark, SMALL))
    tables.discard(table)


@pytest.mark.parametrize("name", (
    "group_keyed_read",
    "job_grid",
    "job_tile_documents",
    "job_wide_records",
    "mllib_mse",
    "points_compacted",
    "snapshot_orc_round_trip",
    "species_keyed_read",
))
def test_a_query_that_writes_scratch_ends_on_a_cluster(spark, monkeypatch, tmp_path, name):
    """The first of its application, so the trial is its own; its rows are those of a local master."""
    catalogue.QUERIES[name](spark, SMALL).write.parquet(f"{tmp_path}/local")
    monkeypatch.setattr(tables, "_tried", set(), raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    catalogue.QUERIES[name](spark, SMALL).write.parquet(f"{tmp_path}/cluster")
    local, cluster = (spark.read.parquet(f"{tmp_path}/{at}") for at in ("local", "cluster"))
    assert not local.isEmpty() and same_rows(local, cluster)


def test_a_folder_that_loses_rows_is_refused_on_a_cluster(spark, monkeypatch):
    """An executor that writes to its own disk: its files are not among those read."""
    class Some:
        def __getattr__(self, name):
            return getattr(spark, name)

        def range(self, *parts):
            return spark.range(*parts).where("id <> 3")

    monkeypatch.setattr(tables, "_tried", set())
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    before = _scratch(spark)
    with pytest.raises(ValueError, match="local to each machine"):
        tables.shared_folder(Some())
    assert _scratch(spark) == before


def test_names_of_points(spark):
    rows = [(1, 10, 10, "a"), (1, 10, 10, "a"), (1, 10, 11, "b"), (1, 10, 11, "b"), (1, 20, 20, "c"), (1, 30, None, "d"), (1, 30, None, "d")]
    clean = spark.createDataFrame(
        [(*r, 2000, 1.0, 2.0) for r in rows],
        "orderkey int, specieskey int, taxonkey int, scientificname string, year int, decimallatitude double, decimallongitude double")
    points = counts.named_points(clean)
    found = names.names_of_points(points).collect()
    assert [(r.scientificname, r.specieskey, r.records) for r in found] == [("a", 10, 2)]
    assert same_rows(names.names_of_points(points), names.species_names(clean))
    # the pyramid counts rows of places and names, the grid observations
    cells = tiles.tile_pyramid(points).where("z = 3").groupBy("specieskey").agg(F.sum("n_points"), F.sum("n_obs")).collect()
    assert sorted(map(tuple, cells)) == [(10, 2, 4), (20, 1, 1), (30, 1, 2)]
    assert tiles.grid_of_points(points).agg(F.sum("count")).first()[0] == len(rows)
