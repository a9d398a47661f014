"""Array files of the classic format (versions 1, 2 and 5) as long tables: a row a cell, its coordinates beside it.

Files come through Spark's binary reader, one partition or more of whole files, so any path that Spark can open will do; a
file has to be under 2 GB, that reader's bound. Coordinates are spread over the cells by the names of their dimensions
within the file, so no join is needed. A glob reads all its files; `file` tells them apart.
"""

from __future__ import annotations

import math
import re
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.functions.scalars import finite
from halocline.operators.vertical import sigma_to_z

# fixed values: the format's tags and types
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Cells of one Arrow batch.
BATCH = 65_536
#: Names of the index columns by the number of a variable's dimensions.
AXES = {0: (), 1: ("i",), 2: ("j", "i"), 3: ("t", "j", "i"), 4: ("t", "k", "j", "i")}
# fixed values: lengths of the units of time, in microseconds
STEPS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "sec": 10**6, "s": 10**6, "minute": 60 * 10**6, "min": 60 * 10**6, "hour": 3600 * 10**6, "hr": 3600 * 10**6, "h": 3600 * 10**6, "day": 86400 * 10**6, "d": 86400 * 10**6}


class ArrayFile:
    """dims {name: length}, attributes and variables {name: (dims, attributes, values)} of a file's bytes; values are views."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not an array file of the classic format")
        self.data, self.at, self.version = data, 4, data[3]
        records = self._number()
        dims = self._list(lambda: (self._name(), self._number()))
        self.attributes = dict(self._list(self._attribute))
        made = self._list(self._variable)
        rolling = [v for v in made if v[1] and dims[v[1][0]][1] == 0]
        widths = {v[0]: math.prod(dims[d][1] for d in v[1][1:]) * np.dtype(KINDS[v[3]]).itemsize for v in rolling}
        # A lone record variable is stored without padding.
        step = sum(widths.values()) if len(rolling) == 1 else sum(-(-w // 4) * 4 for w in widths.values())
        unknown = (1 << (64 if self.version == 5 else 32)) - 1
        if records == unknown and rolling:  # written as a stream: as many as the file holds
            records = (len(data) - min(v[4] for v in rolling)) // step if step else 0
        self.dims = {name: length or records for name, length in dims}
        self.variables = {}
        for name, ids, attributes, kind, begin in made:
            names = tuple(dims[d][0] for d in ids)
            shape, dtype = tuple(self.dims[d] for d in names), np.dtype(KINDS[kind])
            strides = [dtype.itemsize * math.prod(shape[k + 1 :]) for k in range(len(shape))]
            if name in widths:
                strides[0] = step
            values = np.ndarray(shape, dtype, data, begin, strides) if math.prod(shape) else np.empty(shape, dtype)
            self.variables[name] = (names, attributes, values)

    def _take(self, form: str) -> int:
        (x,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return x

    def _number(self) -> int:
        return self._take(">Q" if self.version == 5 else ">I")

    def _bytes(self, n: int) -> bytes:
        found = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return found

    def _name(self) -> str:
        return self._bytes(self._number()).decode()

    def _list(self, one) -> list:
        self._take(">I")
        return [one() for _ in range(self._number())]

    def _attribute(self) -> tuple:
        name, kind = self._name(), KINDS[self._take(">I")]
        n = self._number()
        raw = self._bytes(n * np.dtype(kind).itemsize)
        return name, raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()

    def _variable(self) -> tuple:
        name = self._name()
        ids = [self._number() for _ in range(self._number())]
        attributes = dict(self._list(self._attribute))
        kind = self._take(">I")
        self._number()  # the size, which large variables can't tell
        return name, ids, attributes, kind, self._take(">I" if self.version == 1 else ">Q")

    def find(self, names: tuple[str, ...]) -> str | None:
        return next((n for n in names if n in self.variables), None)

    def numbers(self, name: str, part: tuple = ()) -> np.ndarray:
        """Doubles with NaN for fills, scaled and offset; characters are read as digits."""
        _, attributes, values = self.variables[name]
        raw = values[part]
        if raw.dtype.kind == "S":
            digit = np.char.isdigit(raw)
            return np.where(digit, np.where(digit, raw, b"0").astype(float), np.nan)
        out = raw.astype(float)
        for fill in (attributes.get("_FillValue"), attributes.get("missing_value")):
            if isinstance(fill, list) and fill:
                out[raw == np.array(fill[0]).astype(raw.dtype)] = np.nan
        scale, offset = attributes.get("scale_factor"), attributes.get("add_offset")
        return out * (scale[0] if scale else 1) + (offset[0] if offset else 0)

    def micros(self, name: str, part: tuple = ()) -> np.ndarray:
        """Microseconds since 1970 (NaN where missing) of a time with units such as `days since 1950-01-01`."""
        units = str(self.variables[name][1].get("units", ""))
        found = re.match(r"\s*([A-Za-z]+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})[T ]*(?:(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?", units)
        if not found or found[1].lower() not in STEPS:
            raise ValueError(f"{name} has no units of time: {units!r}")
        year, month, day, hour, minute, second = (int(x or 0) for x in found.groups()[1:])
        base = np.datetime64(f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}", "us").astype(np.int64)
        return np.round(self.numbers(name, part) * STEPS[found[1].lower()]) + base


def read_arrays(spark: SparkSession, path: str, values: dict[str, tuple], coords: dict[str, tuple] | None = None, times: dict[str, tuple] | None = None, optional: tuple[str, ...] = (), axes: dict[int, tuple] | None = None, surface: tuple[str, ...] = ()) -> DataFrame:
    """(file, the indices t, k, j, i from 0, a column for each of values, coords and times) of the files at path.

    Each column names the variables it may be read from; the first that a file has counts. The first of `values` gives the
    cells; the others, coords and times need only a part of its dimensions. A column of values that a file lacks is an error
    unless it is in `optional`; coords and times that it lacks are NULL, as are fills. Times are decoded by their units, and
    times without any are an error. Files of other dimensions may stand beside each other; indices they lack are 0.
    Of a column in `surface`, dimensions that the cells lack are taken at 0; elsewhere such a dimension is an error."""
    coords, times, axes = coords or {}, times or {}, axes or AXES
    names = list(dict.fromkeys(a for n in sorted(axes, reverse=True) for a in axes[n]))
    lead = next(iter(values))
    schema = ", ".join(["file string"] + [f"{a} long" for a in names] + [f"`{c}` double" for c in [*values, *coords]] + [f"`{c}` timestamp_ntz" for c in times])

    def cells(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _cells(batch.column(0)[row].as_py(), ArrayFile(batch.column(1)[row].as_py()))

    def _cells(file: str, arrays: ArrayFile):
        found = {c: arrays.find(wanted) for c, wanted in [*values.items(), *coords.items(), *times.items()]}
        lost = [c for c in values if found[c] is None and c not in optional]
        if lost:
            raise ValueError(f"{file} has none of {[values[c] for c in lost]}")
        if found[lead] is None:
            return
        dims = arrays.variables[found[lead]][0]
        shape = tuple(arrays.dims[d] for d in dims)
        whole = {}  # coordinates with fewer dimensions are read once
        for start in range(0, math.prod(shape), BATCH):
            flat = np.arange(start, min(start + BATCH, math.prod(shape)))
            place = dict(zip(dims, np.unravel_index(flat, shape) if shape else (), strict=True))
            columns = [pa.repeat(file, len(flat))]
            at = dict(zip(axes[len(dims)], place.values(), strict=True))
            columns += [pa.array(at.get(a, np.zeros(len(flat), int)), pa.int64()) for a in names]
            for c in [*values, *coords, *times]:
                name, kind = found[c], pa.timestamp("us") if c in times else pa.float64()
                if name is None:
                    columns.append(pa.nulls(len(flat), kind))
                    continue
                own = arrays.variables[name][0]
                if c not in surface and any(arrays.dims[d] > 1 for d in own if d not in dims):
                    raise ValueError(f"{file}: {name} has dimensions {own}, {found[lead]} has {dims}")
                read = arrays.micros if c in times else arrays.numbers
                part = tuple(place.get(d, np.zeros(len(flat), int)) for d in own)
                if len(own) < len(dims):
                    x = (whole.setdefault(name, read(name)) if own else read(name).reshape(()))[part]
                else:
                    x = read(name, part)
                x = np.broadcast_to(x, len(flat))
                good = np.isfinite(x)
                columns.append(pa.array(np.where(good, x, 0).astype(np.int64), pa.int64(), mask=~good).cast(kind) if c in times else pa.array(x, kind, mask=~good))
            yield pa.RecordBatch.from_arrays(columns, names=["file", *names, *values, *coords, *times])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, schema)


def within(df: DataFrame, bbox: tuple | None = None, dates: tuple | None = None, pressures: tuple | None = None) -> DataFrame:
    """Rows in closed ranges: bbox (west, south, east, north), dates of `time`, `pressure`. A row without the value goes."""
    tests = []
    if bbox:
        tests += [F.col("lon").between(bbox[0], bbox[2]), F.col("lat").between(bbox[1], bbox[3])]
    if dates:
        tests.append(F.col("time").between(F.lit(dates[0]).cast("timestamp_ntz"), F.lit(dates[1]).cast("timestamp_ntz")))
    if pressures:
        tests.append(F.col("pressure").between(*pressures))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


# fixed values: the names that models and products give their variables
LON, LAT, TIME = ("lon", "longitude", "LONGITUDE"), ("lat", "latitude", "LATITUDE"), ("time", "TIME")
SIGMA = {"ssh": ("zeta",), "temperature": ("temp",), "salinity": ("salt",), "u": ("u",), "v": ("v",)}
SIGMA_COORDS = {"lon": ("lon_rho", "longitude", "nav_lon", "lon"), "lat": ("lat_rho", "latitude", "nav_lat", "lat"), "mask": ("mask_rho", "mask", "tmask"), "h": ("h", "depth", "bathy"), "sc": ("sc_r", "s_rho"), "cs": ("Cs_r", "Cs_at_rho_points"), "zeta": ("zeta",)}
SIGMA_TIMES = ("time", "ocean_time", "scrum_time")
LEVELS = {"ssh": ("zos", "sossheig", "ssh", "SSH"), "temperature": ("thetao", "votemper", "temp", "TEMP"), "salinity": ("so", "vosaline", "salt", "SALT"), "u": ("uo", "vozocrtx", "u", "U"), "v": ("vo", "vomecrty", "v", "V")}
LEVELS_COORDS = {"lon": ("lon", "longitude", "nav_lon", "glamt"), "lat": ("lat", "latitude", "nav_lat", "gphit"), "mask": ("mask", "tmask", "mask_rho"), "depth": ("depth", "deptht", "depthw", "lev", "z")}
LEVELS_TIMES = ("time_counter", "time", "TIME")
PRODUCTS = {
    "altimetry_ssh": {"ssh": ("adt", "ssh", "zos", "sla")},
    "altimetry_sla": {"sla": ("sla", "sea_level_anomaly")},
    "altimetry_velocity": {"u": ("ugos", "ugosa", "u"), "v": ("vgos", "vgosa", "v")},
    "currents": {"u": ("u", "U", "uo"), "v": ("v", "V", "vo")},
    "sst": {"sst": ("analysed_sst", "sst", "SST")},
}
# fixed values: boxes (west, south, east, north)
REGIONS = {"yucatan": (-88.5, 19.5, -84.5, 23.5), "campeche": (-97.5, 16.5, -89.0, 22.5), "gom": (-98.0, 16.0, -80.0, 31.0)}


def sigma_field(spark: SparkSession, path: str, what: str, apply_mask: bool = True) -> DataFrame:
    """(file, t, k, j, i, value, time, lon, lat, mask, h, sc, cs, zeta) of a terrain-following model; value NULL on land.

    sc, cs and zeta are NULL where the file lacks them; velocities stand on their own points, without coordinates of rho points."""
    staggered = what in ("u", "v")
    coords = {} if staggered else {c: n for c, n in SIGMA_COORDS.items() if what != "ssh" or c not in ("sc", "cs", "zeta")}
    out = read_arrays(spark, path, {"value": SIGMA[what]}, coords, {"time": SIGMA_TIMES})
    return out.withColumn("value", F.when(F.coalesce(F.col("mask"), F.lit(1)) > 0, F.col("value"))) if apply_mask and not staggered else out


def sigma_depths(field: DataFrame, hc: float = 300.0, vtransform: int = 2) -> DataFrame:
    """`sigma_field` rows with z, the height of each cell (negative downwards); without zeta the surface is at 0."""
    return field.withColumn("z", sigma_to_z(F.col("h"), F.coalesce("zeta", F.lit(0.0)), F.col("sc"), F.col("cs"), hc, vtransform))


def level_field(spark: SparkSession, path: str, what: str, apply_mask: bool = True) -> DataFrame:
    """(file, t, k, j, i, value, time, lon, lat, mask, z) of a model on fixed depths; z is negative downwards."""
    out = read_arrays(spark, path, {"value": LEVELS[what]}, LEVELS_COORDS if what != "ssh" else {c: n for c, n in LEVELS_COORDS.items() if c != "depth"}, {"time": LEVELS_TIMES}, surface=("mask",))
    if apply_mask:
        out = out.withColumn("value", F.when(F.coalesce(F.col("mask"), F.lit(1)) > 0, F.col("value")))
    return out.withColumn("z", -F.abs("depth")).drop("depth") if what != "ssh" else out


def product(spark: SparkSession, path: str, kind: str, bbox: tuple | None = None, region: str | None = None) -> DataFrame:
    """(file, t, j, i, the product's values, lon, lat, time) of a gridded product of PRODUCTS, in a box or a named region."""
    if region is not None:
        bbox = REGIONS[region]
    return within(read_arrays(spark, path, PRODUCTS[kind], {"lon": LON, "lat": LAT}, {"time": TIME}).drop("k"), bbox)


def celsius(df: DataFrame, value: str = "sst") -> DataFrame:
    """value less 273.15 everywhere, if any of it is over 100."""
    hot = df.agg(F.coalesce(F.max(F.col(value)) > 100, F.lit(False)).alias("hot__"))
    return df.crossJoin(F.broadcast(hot)).withColumn(value, F.when(F.col("hot__"), F.col(value) - 273.15).otherwise(F.col(value))).drop("hot__")  # one row


def swath_points(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, ssh) of a swath's cells that have all three."""
    out = read_arrays(spark, path, {"ssh": ("ssh_karin_2", "ssh_karin", "ssha_karin", "ssh", "adt", "ssha")}, {"lon": ("longitude", "lon"), "lat": ("latitude", "lat")})
    return out.select("lon", "lat", "ssh").dropna()


def float_profiles(spark: SparkSession, path: str, good_qc: bool = True, bbox: tuple | None = None, dates: tuple | None = None) -> DataFrame:
    """(file, profile, level, lon, lat, time, pressure, temperature, salinity) of profiling floats, adjusted values first.

    With good_qc a value whose flag is neither 1 nor 2 is NULL. Cells with neither temperature nor salinity go."""
    values = {"temperature": ("TEMP_ADJUSTED", "TEMP", "temperature"), "salinity": ("PSAL_ADJUSTED", "PSAL", "salinity"), "pressure": ("PRES_ADJUSTED", "PRES", "pressure"), "tq": ("TEMP_QC", "TEMP_ADJUSTED_QC"), "sq": ("PSAL_QC", "PSAL_ADJUSTED_QC")}
    out = read_arrays(spark, path, values, {"lon": ("LONGITUDE", "longitude", "lon"), "lat": ("LATITUDE", "latitude", "lat")}, {"time": ("JULD", "TIME", "time")}, optional=("salinity", "pressure", "tq", "sq"), axes={1: ("profile",), 2: ("profile", "level")})
    has_flags = out.groupBy("file").agg((F.count("tq") > 0).alias("ft"), (F.count("sq") > 0).alias("fs"))
    if good_qc:
        out = out.join(F.broadcast(has_flags), "file")  # a row a file
        for value, flag, there in (("temperature", "tq", "ft"), ("salinity", "sq", "fs")):
            out = out.withColumn(value, F.when(~F.col(there) | F.col(flag).isin(1.0, 2.0), F.col(value)))
    out = within(out, bbox, dates).where("temperature IS NOT NULL OR salinity IS NOT NULL")
    return out.select("file", "profile", "level", "lon", "lat", "time", "pressure", "temperature", "salinity")


def station_series(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, t, k, values, depth, time) of a station: 'currents' (u, v), 'thermistors' (temperature), or 'echo' (tau)."""
    values = {"currents": {"u": ("u", "U", "UCUR", "eastward_sea_water_velocity"), "v": ("v", "V", "VCUR", "northward_sea_water_velocity")}, "thermistors": {"temperature": ("temperature", "TEMP", "temp", "T")}, "echo": {"tau": ("tau", "travel_time", "TRAVEL_TIME", "TAU")}}[kind]
    depth = {} if kind == "echo" else {"depth": ("depth", "DEPTH", "z")}
    return read_arrays(spark, path, values, depth, {"time": TIME}, axes={1: ("t",), 2: ("t", "k")})


def glider_path(spark: SparkSession, path: str, bbox: tuple | None = None, dates: tuple | None = None, pressures: tuple | None = None) -> DataFrame:
    """(file, i, lon, lat, pressure, temperature, salinity, profile, time) of a glider's samples in closed ranges."""
    values = {"lon": ("LONGITUDE", "longitude", "lon"), "lat": ("LATITUDE", "latitude", "lat"), "pressure": ("PRES", "PRES_ADJUSTED", "pressure", "DEPTH"), "temperature": ("TEMP", "TEMP_ADJUSTED", "temperature"), "salinity": ("PSAL", "PSAL_ADJUSTED", "salinity"), "profile": ("PROFILE_NUMBER", "profile_index", "dive_number")}
    return within(read_arrays(spark, path, values, {}, {"time": ("TIME", "time", "JULD")}, optional=("pressure", "temperature", "salinity", "profile"), axes={1: ("i",)}), bbox, dates, pressures)


def glider_profiles(samples: DataFrame) -> DataFrame:
    """(file, profile, time, lon, lat, n): each profile's first sample and its number of samples."""
    return samples.where(finite(F.col("profile")).isNotNull()).groupBy("file", "profile").agg(F.min_by("time", "i").alias("time"), F.min_by("lon", "i").alias("lon"), F.min_by("lat", "i").alias("lat"), F.count("*").alias("n"))
