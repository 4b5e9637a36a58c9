"""Stored tables: readers and writers for the library's outputs."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharedrift import schemas
from sharedrift.functions import features


# Columnar ---------------------------------------------------------------------------------------------------------

def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.POINTS)


def write_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None, **options) -> None:
    """Write Parquet; range-sorted by ``sort_by`` if given, so a later read by key skips files by their min and max.

    A key holding many rows is spread over several files by sorting on further columns.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").options(**options).parquet(path)


def write_keyed(df: DataFrame, path: str, key: str, *then: str) -> None:
    """A table that is read by one key: sorted by it, with a Bloom filter of it in every row group.

    Files and row groups without the key are skipped, by their range of keys or else by the filter.
    """
    write_parquet(df, path, [key, *then], **{f"parquet.bloom.filter.enabled#{key}": "true"})


def write_orc(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").orc(path)


def save_table(df: DataFrame, name: str, path: str, fmt: str = "orc") -> None:
    """Create a catalog table from the rows, stored at ``path``."""
    df.write.mode("overwrite").format(fmt).option("path", path).saveAsTable(name)


def read_orc(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).orc(path)


def compact(df: DataFrame, path: str) -> None:
    """As few files as their size allows: one for a small export, even-sized ones for a large result.

    The rebalance hint lets adaptive execution merge small partitions and split large ones at the write.
    """
    df.hint("rebalance").write.mode("overwrite").parquet(path)


def write_by_zoom(df: DataFrame, path: str, *key: str, keep_other_zooms: bool = False) -> None:
    """One folder per zoom, rows ordered by ``key`` within files, so a tile is read from few files.

    The key should be unique: the single tile of zoom 0 is then cut into as many files as its size asks for.  With
    ``keep_other_zooms`` only the zooms that the rows have are replaced: their new files are written aside and exchanged
    when all tasks are done, so a job that fails leaves the table as it was.
    """
    order = ["z", *key]
    how = "dynamic" if keep_other_zooms else "static"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "partitionOverwriteMode", how).partitionBy("z").parquet(path)


def write_tiles(documents: DataFrame, path: str, keep_other_zooms: bool = False) -> None:
    """Tile documents keyed by (z, species, x, y)."""
    write_by_zoom(documents, path, "specieskey", "x", "y", keep_other_zooms=keep_other_zooms)


def read_tiles(spark: SparkSession, path: str, with_groups: bool = False) -> DataFrame:
    return read_parquet(spark, path, schemas.TILE_JSON_WITH_GROUPS if with_groups else schemas.TILE_JSON)


# Tab-delimited exchange -------------------------------------------------------------------------------------------

def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-delimited text without header, quoting or escapes; maps must be JSON text already."""
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that do not fit the declared types are an error."""
    return (
        spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "")
        .option("mode", "FAILFAST").csv(path)
    )


def feature_text(maps: DataFrame, keys: list[str], lng: Column, lat: Column, counts: Column) -> DataFrame:
    """Rows for exchange: keys, ``POINT(lng lat)``, year counts as JSON."""
    return maps.select(
        *keys, features.wkt_point(lng, lat).alias("geom"), features.map_to_json(counts).alias("yearcounts"))


def features_from_text(rows: DataFrame) -> DataFrame:
    """Decode exchange rows: ``geom`` to longitude and latitude, ``yearcounts`` to a map."""
    return rows.withColumns({
        "longitude": features.wkt_x(F.col("geom")),
        "latitude": features.wkt_y(F.col("geom")),
        "year_counts": features.json_to_year_counts(F.col("yearcounts")),
    }).drop("geom", "yearcounts")


# Relational database ----------------------------------------------------------------------------------------------

def jdbc_options(url: str, query_or_table: str, key: str, low: int, high: int, partitions: int) -> dict[str, str]:
    return {
        "url": url, "dbtable": query_or_table, "partitionColumn": key, "lowerBound": str(low),
        "upperBound": str(high), "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A database table read in parallel ranges of ``key``; a filter on the result is pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, low, high, partitions)).load()


# Shared scratch ---------------------------------------------------------------------------------------------------

_scopes: list["Scratch"] = []
_tried: set[tuple[str, str]] = set()  # application and folder
NOT_SHARED = "is local to each machine or cannot be written; spark.checkpoint.dir must name a folder that all share"


class Scratch:
    """The scratch folders made inside a ``with`` block; they are deleted at its end, when their results are written.

    Folders made outside any block are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[str] = []

    def __enter__(self) -> "Scratch":
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)
        for path in self.folders:
            _delete(self.spark, path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _delete(spark: SparkSession, folder: str) -> None:
    at, files = _file_system(spark, folder)
    files.delete(at, True)


def _try_shared(spark: SparkSession, base: str) -> None:
    """Raise unless a small table that every executor writes to is read back whole."""
    folder = f"{base}/sharedrift-{uuid.uuid4().hex}"
    try:
        trial = (spark.sparkContext.applicationId, base)
        if trial in _tried:
            return
        parts = max(2, 2 * spark.sparkContext.defaultParallelism)
        spark.range(0, parts, 1, parts).write.parquet(folder)
        found = spark.read.schema("id long").parquet(folder).count()
    except Exception as error:
        raise ValueError(f"{base} {NOT_SHARED}") from error
    finally:
        _delete(spark, folder)
    if found != parts:
        raise ValueError(f"{base} {NOT_SHARED}")
    _tried.add(trial)


def shared_folder(spark: SparkSession) -> str:
    """A path for one table in a fresh folder on storage that the driver and all executors share: below the folder
    ``spark.checkpoint.dir`` names, else below the session's warehouse.  The folder belongs to the innermost ``Scratch``,
    else to the application.

    On a cluster a path of the local file system may be a mounted folder that all share, or each machine's own disk.  One
    trial for each application tells: rows that the executors write there must be what is read back.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    folder = f"{base}/sharedrift-{uuid.uuid4().hex}"
    at, files = _file_system(spark, folder)
    if files.getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        _try_shared(spark, base)
    files.mkdirs(at)
    if _scopes:
        _scopes[-1].folders.append(folder)
    else:
        files.deleteOnExit(at)  # only of what exists
    return f"{folder}/table"


def written_once(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: a result used several times is computed once, and
    a lost executor costs a re-read.  ``discard`` deletes it earlier than its scope does."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def discard(*written: DataFrame) -> None:
    """Delete tables of ``written_once`` that nothing reads any more: whatever was made of them is itself written."""
    for df in written:
        _delete(df.sparkSession, df._scratch_path.removesuffix("/table"))
