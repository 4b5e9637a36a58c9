"""Explicit schemas of every stored table."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_INT, _LONG, _DOUBLE, _TEXT, _FLAG = (
    T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(),
)

OCCURRENCE = _struct(
    recordid=_LONG, kingdomkey=_INT, phylumkey=_INT, classkey=_INT, orderkey=_INT, familykey=_INT, genuskey=_INT,
    specieskey=_INT, taxonkey=_INT, decimallatitude=_DOUBLE, decimallongitude=_DOUBLE, hasgeospatialissues=_FLAG,
    year=_INT, month=_INT, day=_INT, basisofrecord=_TEXT, datasetkey=_TEXT, publishingorgkey=_TEXT,
    countrycode=_TEXT, scientificname=_TEXT,
)

# species x year x exact coordinate
POINTS = _struct(orderkey=_INT, specieskey=_INT, year=_INT, lat=_DOUBLE, lng=_DOUBLE, count=_LONG)

# the same per name; ``accepted`` counts the observations whose name is the species' accepted one
NAMED_POINTS = _struct(
    orderkey=_INT, specieskey=_INT, scientificname=_TEXT, year=_INT, lat=_DOUBLE, lng=_DOUBLE, count=_LONG, accepted=_LONG,
)

# species x year x place rounded to 0.01 degree; the rounded place is held as integer hundredths
SPECIES_POINT_YEAR = _struct(
    orderkey=_INT, specieskey=_INT, lat_e2=_INT, lng_e2=_INT, year=_INT, n=_LONG,
)
GROUP_POINT_YEAR = _struct(orderkey=_INT, lat_e2=_INT, lng_e2=_INT, year=_INT, n=_LONG)

GRID = _struct(specieskey=_INT, year=_INT, x=_LONG, y=_LONG, count=_LONG)
CELL_SLOPE = _struct(specieskey=_INT, x=_LONG, y=_LONG, x1=_LONG, y1=_LONG, slope=_DOUBLE)

# tab-delimited exchange files
SPECIES_FEATURE_TEXT = _struct(specieskey=_INT, geom=_TEXT, yearcounts=_TEXT)
GROUP_FEATURE_TEXT = _struct(orderkey=_INT, geom=_TEXT, yearcounts=_TEXT)
NAMES = _struct(specieskey=_INT, scientificname=_TEXT)
WIDE_RECORD_TEXT = _struct(specieskey=_INT, geom=_TEXT, year=_INT, speciescount=_LONG, ordercount=_LONG)
TILE_JSON = _struct(specieskey=_INT, z=_INT, x=_LONG, y=_LONG, json=_TEXT)
TILE_JSON_WITH_GROUPS = _struct(specieskey=_INT, z=_INT, x=_LONG, y=_LONG, is_group=_FLAG, json=_TEXT)

BOX_REQUEST = _struct(
    request_id=_LONG, orderkey=_INT, specieskey=_INT, lat_a=_DOUBLE, lng_a=_DOUBLE, lat_b=_DOUBLE, lng_b=_DOUBLE,
    min_year=_INT, max_year=_INT,
)

# the star-schema test tables an occurrence table can be derived from (columns used)
STAR = {
    "lineitem": _struct(
        l_orderkey=_LONG, l_partkey=_LONG, l_suppkey=_LONG, l_linenumber=_INT, l_returnflag=_TEXT,
        l_shipdate=T.TimestampNTZType()),
    "orders": _struct(o_orderkey=_LONG, o_custkey=_LONG, o_orderstatus=_TEXT, o_orderpriority=_TEXT),
    "supplier": _struct(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT),
    "nation": _struct(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
}
