"""Readers of text observations, and sinks. All parsing is column expressions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.functions.scalars import METRES_PER_DBAR, finite

# fixed values: fill numbers of buoy files, and of float files in positions and pressure
BUOY_FILLS, FLOAT_FILLS = (99.0, 999.0, 9999.0), (99999.0, 9999.0, 999.0)
#: Columns of buoy files by their header.
BUOY_NAMES = {"WDIR": "wdir", "WD": "wdir", "WSPD": "wspd", "GST": "gst", "WVHT": "hs", "DPD": "dpd", "APD": "apd", "MWD": "mwd", "PRES": "pres", "BAR": "pres", "ATMP": "atmp", "WTMP": "wtmp", "DEWP": "dewp", "VIS": "vis"}


def station_of(file: Column) -> Column:
    """The first run of five digits of a file's name, else the name without its ending."""
    name = F.regexp_extract(file, "([^/]+)$", 1)
    digits = F.regexp_extract(name, "([0-9]{5})", 1)
    return F.when(digits != "", digits).otherwise(F.regexp_replace(name, "\\.[^.]*$", ""))


def read_buoys(spark: SparkSession, path: str, stations: DataFrame | None = None) -> DataFrame:
    """(station, ts, wdir, wspd, ...) of buoy text files; with stations (station, lon, lat) their positions too.

    Each file's first line names its columns, the first five being the time; a second line of units is skipped, as are rows
    shorter than the header and those without a valid time. Years of two digits are 1970 to 2069. Fill numbers are NULL."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), "\\s+").alias("f"), F.col("value").alias("line"))
    head = lines.where(F.ltrim("line").startswith("#YY") | F.ltrim("line").startswith("YY")).groupBy("file").agg(F.min(F.regexp_replace("line", "#", "")).alias("h")).withColumn("h", F.split(F.trim("h"), "\\s+"))
    rows = lines.where(~F.ltrim("line").startswith("#") & F.trim("line").rlike("^[0-9]")).join(F.broadcast(head), "file").where(F.size("f") >= F.size("h"))  # a header a file
    number = lambda k: F.get("f", F.lit(k)).try_cast("int")
    year = F.when(number(0) < 70, number(0) + 2000).when(number(0) < 100, number(0) + 1900).otherwise(number(0))
    has_minute = F.get("h", F.lit(4)).isin("mm")
    stamp = F.format_string("%04d-%02d-%02d %02d:%02d:00", year, number(1), number(2), number(3), F.when(has_minute, number(4)).otherwise(0))
    rows = rows.withColumn("ts", stamp.try_cast("timestamp_ntz")).where("ts IS NOT NULL").withColumn("station", station_of(F.col("file")))

    def column(name: str) -> Column:
        place = F.least(*[F.nullif(F.array_position("h", k), F.lit(0)) for k, v in BUOY_NAMES.items() if v == name], F.lit(None).cast("long"))
        x = finite(F.try_element_at("f", place.cast("int")).try_cast("double"))
        return F.when(~x.isin(*BUOY_FILLS), x).alias(name)

    out = rows.select("station", "ts", *[column(n) for n in dict.fromkeys(BUOY_NAMES.values())])
    return out if stations is None else out.join(F.broadcast(stations.select("station", "lon", "lat")), "station", "left")


def read_floats(spark: SparkSession, path: str, bbox: tuple | None = None, dates: tuple | None = None, pressures: tuple | None = None) -> DataFrame:
    """(float_id, time, lon, lat, pressure, temperature, depth) of delimited float files (commas, tabs or blanks, a header).

    Fill numbers of position and pressure are NULL; the ranges are closed, and a row outside one or without its value goes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    is_head = F.lower("line").rlike("(^|[,\\t ])(lat|latitude)([,\\t ]|$)")
    head = lines.where(is_head).groupBy("file").agg(F.min(F.lower("line")).alias("h")).withColumn("h", F.split("h", "[,\\t ]+"))
    rows = lines.where(~is_head).withColumn("f", F.split("line", "[,\\t ]+")).join(F.broadcast(head), "file")

    def column(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("f", F.nullif(F.array_position("h", n), F.lit(0)).cast("int")) for n in names])

    known = lambda x: F.when(~F.abs(x).isin(*FLOAT_FILLS), x)
    number = lambda *names: finite(column(*names).try_cast("double"))
    out = rows.select(column("float_id", "id", "float").alias("float_id"), column("time", "date").try_cast("timestamp_ntz").alias("time"), known(number("lon", "longitude")).alias("lon"), known(number("lat", "latitude")).alias("lat"), known(number("pressure", "pres")).alias("pressure"), number("temperature", "temp").alias("temperature"))
    out = out.withColumn("depth", F.col("pressure") * METRES_PER_DBAR)
    if bbox:
        out = out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    if dates:
        out = out.where(F.col("time").between(F.lit(dates[0]).cast("timestamp_ntz"), F.lit(dates[1]).cast("timestamp_ntz")))
    return out.where(F.col("pressure").between(*pressures)) if pressures else out


def quality_masked(value: Column, flag: Column) -> Column:
    """value where the flag is 1 or 2."""
    return F.when(flag.try_cast("int").isin(1, 2), value)


def expand_ragged(lengths: DataFrame, samples: DataFrame, order: str, length: str, place: str) -> DataFrame:
    """samples, numbered by place from 0 without gaps, with the columns of their row of lengths (in `order`).

    Rows are found by an equi-join on blocks of places. Raises if the lengths don't add up to the samples."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row a trajectory
    spans = lengths.withColumn("a__", F.coalesce(F.sum(length).over(w), F.lit(0))).where(F.col(length) > 0)
    total = samples.count(), lengths.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    if total[0] != total[1]:
        raise ValueError(f"{total[0]} samples, but lengths for {total[1]}")
    block = 4096
    spans = spans.withColumn("block__", F.explode(F.sequence(F.floor(F.col("a__") / block), F.floor((F.col("a__") + F.col(length) - 1) / block))))
    met = samples.withColumn("block__", F.floor(F.col(place) / block)).join(spans, "block__")
    return met.where((F.col(place) >= F.col("a__")) & (F.col(place) < F.col("a__") + F.col(length))).drop("block__", "a__")


def write_events(events: DataFrame, path: str) -> None:
    """A CSV of events with six decimals in every real column."""
    reals = {c for c, kind in events.dtypes if kind in ("double", "float")}
    events.select(*[F.format_string("%.6f", c).alias(c) if c in reals else F.col(c) for c in events.columns]).write.option("header", True).csv(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_gem(tables: DataFrame, path: str) -> None:
    tables.write.parquet(path)


def read_gem(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
