"""Vertical and grid operators: stretched levels, depths of levels, interpolation along profiles, staggered points, planes.

Profiles are long tables: key columns, a depth or height, a value. A profile's levels are gathered into one sorted array (a
column has tens to thousands of levels), so target depths need no join and no row leaves its profile's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halocline.functions.scalars import METRES_PER_DBAR, finite, sound_speed


def stretching(spark: SparkSession, n: int, theta_s: float = 7.0, theta_b: float = 0.0, vstretching: int = 4) -> DataFrame:
    """(k, sc, cs) of n levels from the bottom up: Song and Haidvogel's (1), Shchepetkin's (4), else cs = sc."""
    sc, zero = -1 + (F.col("id") + 0.5) / n, F.lit(0.0)
    cs = sc
    if vstretching == 1 and theta_s > 0:
        half = F.tanh(zero + 0.5 * theta_s)
        cs = (1 - theta_b) * F.sinh(theta_s * sc) / F.sinh(zero + theta_s) + theta_b * (F.tanh(theta_s * (sc + 0.5)) - half) / (2 * half)
    elif vstretching == 4:
        cs = (1 - F.cosh(theta_s * sc)) / (F.cosh(zero + theta_s) - 1) if theta_s > 0 else -sc * sc
        if theta_b > 0:
            cs = (F.exp(theta_b * cs) - 1) / (1 - F.exp(zero - theta_b))
    return spark.range(n).select(F.col("id").cast("int").alias("k"), sc.alias("sc"), cs.alias("cs"))


def sigma_to_z(h: Column, zeta: Column, sc: Column, cs: Column, hc: float, vtransform: int = 2) -> Column:
    """Height of a level (negative downwards)."""
    if vtransform == 1:
        z0 = hc * sc + (h - hc) * cs
        return z0 + zeta * (1 + z0 / h)
    s = (hc * sc + h * cs) / (hc + h)
    return zeta * (1 + s) + h * s


def z_levels(columns: DataFrame, levels: DataFrame, hc: float, vtransform: int = 2) -> DataFrame:
    """columns (..., h, zeta) by levels (k, sc, cs), a bounded table: the rows of columns with k and z."""
    met = columns.crossJoin(F.broadcast(levels))
    return met.withColumn("z", sigma_to_z(F.col("h"), F.col("zeta"), F.col("sc"), F.col("cs"), hc, vtransform)).drop("sc", "cs")


def _gathered(df: DataFrame, keys: list[str], z: str, value: str, keep_missing: bool) -> DataFrame:
    rows = df.where(finite(F.col(z)).isNotNull() & (F.lit(keep_missing) | finite(F.col(value)).isNotNull()))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(finite(F.col(z)).alias("z"), finite(F.col(value)).alias("v")))).alias("p__"))


def interpolated(profile: Column, at: Column, outside: str = "null", flat: float = 0.0) -> Column:
    """The value at a depth of an ascending array of (z, v). outside: 'null', or 'clamp' to hold the ends.

    Levels nearer than `flat` weigh alike; a missing value on either side of the depth gives NULL."""
    low = F.filter(profile, lambda x: x["z"] <= at)
    k = F.greatest(F.least(F.size(low), F.size(profile) - 1), F.lit(1))
    a, b = F.get(profile, k - 1), F.get(profile, k)
    gap = b["z"] - a["z"]
    weight = F.when(gap <= flat, 0.5).otherwise((at - a["z"]) / F.when(gap > 0, gap))
    if outside == "clamp":
        weight = F.greatest(F.least(weight, F.lit(1.0)), F.lit(0.0))
    found = F.when(weight == 0, a["v"]).when(weight == 1, b["v"]).otherwise(a["v"] + weight * (b["v"] - a["v"]))
    if outside == "clamp":
        return F.when(F.size(profile) == 1, F.get(profile, F.lit(0))["v"]).otherwise(found)
    ends = F.array_min(F.transform(profile, lambda x: x["z"])), F.array_max(F.transform(profile, lambda x: x["z"]))
    return F.when((F.size(profile) >= 2) & (at >= ends[0]) & (at <= ends[1]), found)


def interp_depths(df: DataFrame, keys: list[str], z: str, value: str, depths: list[float], outside: str = "null", keep_missing: bool = False, flat: float = 1e-6) -> DataFrame:
    """(keys, depth, value) at fixed depths for every profile that has a level.

    keep_missing: a level without a value breaks the interpolation around it; else it is left out."""
    rows = _gathered(df, keys, z, value, keep_missing).withColumn("depth", F.explode(F.array(*[F.lit(float(d)) for d in depths])))
    return rows.select(*keys, "depth", interpolated(F.col("p__"), F.col("depth"), outside, flat).alias(value))


def project_to_depths(df: DataFrame, keys: list[str], z: str, value: str, depths: list[float], extrapolate: bool = False) -> DataFrame:
    """(keys, depth, value, n_instruments): instruments of one time on fixed depths; NULL under two valid ones."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(finite(F.col(z)).isNotNull() & finite(F.col(value)).isNotNull(), F.struct(finite(F.col(z)).alias("z"), finite(F.col(value)).alias("v"))))).alias("p__"))
    rows = rows.withColumn("depth", F.explode(F.array(*[F.lit(float(d)) for d in depths])))
    found = interpolated(F.col("p__"), F.col("depth"), "clamp" if extrapolate else "null")
    return rows.select(*keys, "depth", F.when(F.size("p__") >= 2, found).alias(value), F.size("p__").alias("n_instruments"))


def to_rho_points(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Means of neighbours along index (n points become n + 1), the ends repeated."""
    w = Window.partitionBy(*keys).orderBy(index)
    here = F.coalesce((F.lag(value).over(w) + F.col(value)) / 2, F.when(F.lag(index).over(w).isNull(), F.col(value)))
    rows = df.select(*keys, F.col(index), here.alias("a__"), F.lead(index).over(w).isNull().alias("last__"), F.col(value).alias("b__"))
    both = F.when(F.col("last__"), F.array(F.struct(F.col(index).alias("i"), F.col("a__").alias("v")), F.struct((F.col(index) + 1).alias("i"), F.col("b__").alias("v")))).otherwise(F.array(F.struct(F.col(index).alias("i"), F.col("a__").alias("v"))))
    return rows.withColumn("x__", F.explode(both)).select(*keys, F.col("x__.i").alias(index), F.col("x__.v").alias(value))


def masked(df: DataFrame, mask: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value, NULL where the mask is 0 or less; cells without a mask stay."""
    return df.join(mask.select(*keys, F.col("mask").alias("mask__")), keys, "left").withColumn(value, F.when(F.coalesce("mask__", F.lit(1)) > 0, F.col(value))).drop("mask__")


def surface(df: DataFrame, keys: list[str], level: str, top: str = "max") -> DataFrame:
    """The rows of every column's surface level: the largest (sigma) or smallest (depth) level."""
    best = F.max if top == "max" else F.min
    return df.withColumn("top__", best(level).over(Window.partitionBy(*keys))).where(F.col(level) == F.col("top__")).drop("top__")


def detrended_plane(df: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """value less the plane of least squares through each field; the sums are centred."""
    w = Window.partitionBy(*keys)
    n = df.withColumns({f"{c}__": F.col(c) - F.avg(F.when(finite(F.col(value)).isNotNull(), F.col(c))).over(w) for c in (x, y, value)})
    a, b, c = F.col(f"{x}__"), F.col(f"{y}__"), F.col(f"{value}__")
    held = lambda e: F.sum(F.when(c.isNotNull(), e)).over(w)
    n = n.withColumns({"xx__": held(a * a), "yy__": held(b * b), "xy__": held(a * b), "xv__": held(a * c), "yv__": held(b * c)})
    det = F.col("xx__") * F.col("yy__") - F.col("xy__") * F.col("xy__")
    sx = F.when(det != 0, (F.col("xv__") * F.col("yy__") - F.col("yv__") * F.col("xy__")) / det)
    sy = F.when(det != 0, (F.col("yv__") * F.col("xx__") - F.col("xv__") * F.col("xy__")) / det)
    return n.withColumn(value, c - sx * a - sy * b).select(*df.columns)


def travel_times(profiles: DataFrame, key: str, pressure: str, temperature: str, salinity: str) -> DataFrame:
    """(key, tau, levels): twice the sum of dz over the mean sound speed of adjacent levels, from three levels on."""
    rows = profiles.where(finite(F.col(pressure)).isNotNull() & finite(F.col(temperature)).isNotNull() & finite(F.col(salinity)).isNotNull())
    rows = rows.withColumn("c__", sound_speed(F.col(temperature), F.col(salinity), F.col(pressure))).withColumn("z__", F.col(pressure) * METRES_PER_DBAR)
    w = Window.partitionBy(key).orderBy(pressure)
    rows = rows.withColumn("t__", 2 * (F.col("z__") - F.lag("z__").over(w)) / ((F.col("c__") + F.lag("c__").over(w)) / 2))
    return rows.groupBy(key).agg(F.sum("t__").alias("tau"), F.count("*").alias("levels")).where("levels >= 3")


def gem_tables(profiles: DataFrame, key: str, pressure: str, temperature: str, salinity: str, depths: list[float], least: int = 4) -> DataFrame:
    """(depth, n, tables): for each depth the (tau, temperature, salinity) of its profiles in order of tau, from `least` on.

    A depth's table grows with the profiles: it is made to be looked up, not joined."""
    taus = travel_times(profiles, key, pressure, temperature, salinity).select(key, "tau")
    metres = profiles.withColumn("z__", F.col(pressure) * METRES_PER_DBAR)
    t, s = (interp_depths(metres, [key], "z__", c, depths) for c in (temperature, salinity))
    rows = t.join(s, [key, "depth"]).join(taus, key).where(F.col(temperature).isNotNull() & F.col(salinity).isNotNull())
    return rows.groupBy("depth").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("tau", F.col(temperature).alias("t"), F.col(salinity).alias("s")))).alias("tables")).where(F.col("n") >= least)


def gem_lookup(tables: DataFrame, taus: DataFrame) -> DataFrame:
    """(..., depth, t, s) of taus (..., tau): linear in tau, the ends held. tables is bounded by its depths."""
    met = taus.crossJoin(F.broadcast(tables.select("depth", "tables")))
    line = lambda c: interpolated(F.transform("tables", lambda x: F.struct(x["tau"].alias("z"), x[c].alias("v"))), F.col("tau"), "clamp")
    return met.select(*taus.columns, "depth", line("t").alias("t"), line("s").alias("s"))


def ssh_anomaly(df: DataFrame, key: str, order: list[str], tau: str, depth: float = 1000.0, method: str = "linear") -> DataFrame:
    """Sea surface anomaly -1500^2 tau' / 2 Z; tau' is tau less its line over the sample's number, or less its mean."""
    w = Window.partitionBy(key)
    rows = df.withColumn("i__", F.row_number().over(w.orderBy(*order)).cast("double"))
    rows = rows.withColumn("x__", F.col("i__") - F.avg("i__").over(w)).withColumn("y__", F.col(tau) - F.avg(tau).over(w))
    slope = F.lit(0.0) if method == "mean" else F.sum(F.col("x__") * F.col("y__")).over(w) / F.nullif(F.sum(F.col("x__") * F.col("x__")).over(w), F.lit(0.0))
    return rows.withColumn("ssh_anomaly", -(1500.0**2) * (F.col("y__") - F.coalesce(slope, F.lit(0.0)) * F.col("x__")) / (2 * depth)).drop("i__", "x__", "y__")
