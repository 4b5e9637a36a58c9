"""Text forms of places and year counts: WKT points, JSON maps, concatenated lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def wkt_point(lng: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lng.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


_WKT_POINT = r"^POINT\((\S+) (\S+)\)$"


def wkt_x(geom: Column) -> Column:
    return F.regexp_extract(geom, _WKT_POINT, 1).cast("double")


def wkt_y(geom: Column) -> Column:
    return F.regexp_extract(geom, _WKT_POINT, 2).cast("double")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use several times.

    A generator of one row is a border for the optimizer: it does not write the expressions out again at every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def sorted_map(key: str, value: str, where: Column | None = None) -> Column:
    """Aggregate: key -> value in key order, of the rows that a condition holds for.

    Only for keys bounded by design and unique per group (years; cells of one tile): the input is always already
    reduced to one row per key, so the collected list is small however many observations stand behind it.
    """
    entry = F.struct(F.col(key), F.col(value))
    return F.map_from_entries(F.sort_array(F.collect_list(entry if where is None else F.when(where, entry))))


def sorted_map_of_maps(key: str, value: str) -> Column:
    """As ``sorted_map`` for values without an order of their own."""
    def by_key(a: Column, b: Column) -> Column:
        return F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)

    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))), by_key))


def map_to_json(counts: Column) -> Column:
    return F.to_json(counts)


def json_to_year_counts(text: Column) -> Column:
    """Decode a JSON year map; malformed text is an error."""
    decoded = F.from_json(text, "map<string,bigint>", {"mode": "FAILFAST"})
    return F.transform_keys(decoded, lambda year, _: year.cast("int"))


def years_between(counts: Column, min_year: int, max_year: int) -> Column:
    """The map's entries within the years, both ends inclusive."""
    return F.map_filter(counts, lambda year, _: year.between(min_year, max_year))


def joined_entries(*parts: str, between: str = ",") -> Column:
    """Aggregate: the parts of each row joined by ``between``, rows in order of the first part, joined by commas."""
    entry = F.concat_ws(between, *[F.col(p).cast("string") for p in parts])
    ordered = F.sort_array(F.collect_list(F.struct(F.col(parts[0]).alias("at"), entry.alias("text"))))
    return F.array_join(F.transform(ordered, lambda e: e["text"]), ",")
