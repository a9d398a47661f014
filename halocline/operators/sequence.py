"""Operators on ordered series. Every window is partitioned by the series and orders ties explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.scalars import EARTH_KM, finite, ratio


def _hours(a, b):
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9


def float_velocities(df: DataFrame, key: str, order: list[str], min_hours: float, max_hours: float) -> DataFrame:
    """Velocities (m/s) between consecutive fixes whose distance in time lies in [min_hours, max_hours]; a row at the later fix."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("lon0", F.lag("lon").over(w)).withColumn("lat0", F.lag("lat").over(w)).withColumn("dt", _hours(F.lag("ts").over(w), F.col("ts")))
    rows = rows.where(F.col("dt").between(min_hours, max_hours))
    metres = EARTH_KM * 1000
    u = metres * F.radians(F.col("lon") - F.col("lon0")) * F.cos(F.radians((F.col("lat") + F.col("lat0")) / 2)) / (F.col("dt") * 3600)
    v = metres * F.radians(F.col("lat") - F.col("lat0")) / (F.col("dt") * 3600)
    return rows.select(key, *order, F.round("dt", 6).alias("dt_hours"), F.round(u, 6).alias("u_ms"), F.round(v, 6).alias("v_ms"))


def progressive_vector(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running displacement (km) of a current u, v (m/s), from 0 at each series' first sample."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("seconds", F.coalesce(_hours(F.lag("ts").over(w), F.col("ts")) * 3600, F.lit(0.0)))
    rows = rows.withColumn("du", F.coalesce(F.lag("u").over(w), F.lit(0.0)) * F.col("seconds") / 1000).withColumn("dv", F.coalesce(F.lag("v").over(w), F.lit(0.0)) * F.col("seconds") / 1000)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(key, *order, F.round(F.sum("du").over(run), 4).alias("x_km"), F.round(F.sum("dv").over(run), 4).alias("y_km"))


def fill_gaps(df: DataFrame, key: str, order: list[str], value: str, max_gap: int | None = 10) -> DataFrame:
    """Interior missing samples, linear by index, where the known neighbours are at most max_gap apart; edges stay missing."""
    w = Window.partitionBy(key).orderBy(*order)
    x = finite(F.col(value))
    rows = df.withColumn("i", F.row_number().over(w)).withColumn("x", x)
    known = F.when(F.col("x").isNotNull(), F.struct("i", "x"))
    rows = rows.withColumn("p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = F.col("q.i") - F.col("p.i")
    line = F.col("p.x") + (F.col("q.x") - F.col("p.x")) * (F.col("i") - F.col("p.i")) / gap
    ok = gap <= max_gap if max_gap is not None else F.lit(True)
    return rows.select(key, *order, F.when(F.col("x").isNotNull(), F.col("x")).when(F.col("p").isNotNull() & F.col("q").isNotNull() & ok, line).alias("filled"))


def islands(df: DataFrame, key: str, order: list[str], flag: str, min_length: int) -> DataFrame:
    """Maximal runs of flagged samples of at least min_length: (key, start, stop, length), 1-based and inclusive."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("i", F.row_number().over(w)).where(F.col(flag))
    rows = rows.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    return rows.groupBy(key, "run").agg(F.min("i").alias("start"), F.max("i").alias("stop"), F.count("*").alias("length")).where(F.col("length") >= min_length).drop("run")


def block_average(df: DataFrame, key: str, order: list[str], value: str, factor: int) -> DataFrame:
    """Means of non-overlapping blocks of `factor` samples; an incomplete last block is dropped."""
    rows = df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / factor).cast("long"))
    return rows.groupBy(key, "block").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).where(F.col("n") == factor).drop("n")


def fixed_depth(df: DataFrame, key: str, depth: str, value: str, target: float) -> DataFrame:
    """Value at a target depth by linear interpolation between the levels around it; no row outside the levels."""
    w = Window.partitionBy(key).orderBy(depth)
    rows = df.where(finite(F.col(value)).isNotNull() & finite(F.col(depth)).isNotNull()).withColumn("d2", F.lead(depth).over(w)).withColumn("v2", F.lead(value).over(w))
    rows = rows.where((F.col(depth) <= target) & (F.col("d2") >= target))
    at = F.coalesce(ratio(F.lit(target) - F.col(depth), F.col("d2") - F.col(depth)), F.lit(0.5))
    found = rows.select(key, depth, (F.col(value) + at * (F.col("v2") - F.col(value))).alias("x"))
    return found.groupBy(key).agg(F.round(F.min_by("x", depth), 6).alias("value"))


def isotherm_depth(df: DataFrame, key: str, depth: str, value: str, target: float) -> DataFrame:
    """Depth of the first pair of adjacent levels that straddles the target value, linear; flat pairs: the middle."""
    w = Window.partitionBy(key).orderBy(depth)
    rows = df.withColumn("d2", F.lead(depth).over(w)).withColumn("v2", F.lead(value).over(w)).where((F.col(value) - target) * (F.col("v2") - target) <= 0)
    at = F.coalesce(ratio(F.lit(target) - F.col(value), F.col("v2") - F.col(value)), F.lit(0.5))
    return rows.select(key, depth, (F.col(depth) + at * (F.col("d2") - F.col(depth))).alias("x")).groupBy(key).agg(F.round(F.min_by("x", depth), 6).alias("isotherm_depth"))


def heat_content(df: DataFrame, key: str, depth: str, value: str, z1: float, z2: float) -> DataFrame:
    """Trapezoid of rho c_p T over the levels in [z1, z2] (J/m2); at least two levels."""
    rows = df.where(F.col(depth).between(z1, z2) & finite(F.col(value)).isNotNull())
    w = Window.partitionBy(key).orderBy(depth)
    rows = rows.withColumn("slab", (F.lead(depth).over(w) - F.col(depth)) * (F.lead(value).over(w) + F.col(value)) / 2)
    return rows.groupBy(key).agg(F.count("*").alias("levels"), F.sum("slab").alias("s")).where("levels >= 2").select(key, "levels", F.round(F.col("s") * 1025 * 3985 / 1e9, 6).alias("heat_gj"))


def wind_rose(df: DataFrame, u: str, v: str, sectors: int, edges: list[float], calm: float) -> DataFrame:
    """Share of samples by direction sector (centred on north, clockwise) and speed bin [lo, hi); calms only count in the total."""
    from halocline.functions.scalars import direction_from, speed

    # An array keeps the two numbers apart from what is made of them: they are parsed once a row.
    pair = df.select(F.explode(F.array(F.struct(finite(F.col(u)).alias("u"), finite(F.col(v)).alias("v")))).alias("w")).where("w.u IS NOT NULL AND w.v IS NOT NULL")
    rows = pair.select(F.explode(F.array(F.struct(speed(F.col("w.u"), F.col("w.v")).alias("s"), direction_from(F.col("w.u"), F.col("w.v")).alias("d")))).alias("x")).select("x.*")
    step = 360 / sectors
    sector = (F.floor((F.col("d") + step / 2) / step) % sectors).cast("int")
    level = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("s"))) - 1
    level = F.when((level >= 0) & (level < len(edges) - 1), level)
    bins = rows.groupBy(F.when(F.col("s") >= calm, sector).alias("sector"), F.when(F.col("s") >= calm, level).alias("level")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("total", F.sum("n").over(Window.partitionBy()))  # at most sectors times bins rows
    return bins.where("sector IS NOT NULL AND level IS NOT NULL").select("sector", "level", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def central_difference(df: DataFrame, key: str, order: list[str], x: str, y: str, name: str) -> DataFrame:
    """dy/dx: between the neighbours, one-sided at the ends; 0 for a single sample."""
    w = Window.partitionBy(key).orderBy(*order)
    y1, x1, y0, x0 = (F.coalesce(f(c).over(w), F.col(c)) for f in (F.lead, F.lag) for c in (y, x))
    return df.withColumn(name, F.when(x1 != x0, (y1 - y0) / (x1 - x0)).when(F.count("*").over(Window.partitionBy(key)) == 1, 0.0))


def unwrapped(df: DataFrame, key: str, order: list[str], phase: str, name: str) -> DataFrame:
    """The phase with whole turns added where it jumps by more than half a turn."""
    w = Window.partitionBy(key).orderBy(*order)
    jump = F.col(phase) - F.lag(phase).over(w)
    turn = F.coalesce(-F.floor((jump + F.pi()) / (2 * F.pi())), F.lit(0))
    rows = df.withColumn("turn__", F.when(F.abs(jump) > F.pi(), turn).otherwise(0))
    return rows.withColumn(name, F.col(phase) + 2 * F.pi() * F.sum("turn__").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("turn__")


def helmholtz_structure(df: DataFrame, key: str, r: str, dll: str, dtt: str) -> DataFrame:
    """Rotational and divergent structure functions: dtt + I and dll - I, I being the integral of (dtt - dll) / r from 0, its
    first half cell with the first value."""
    w = Window.partitionBy(key).orderBy(r)
    f = (F.col(dtt) - F.col(dll)) / F.col(r)
    rows = df.withColumn("f__", f)
    step = F.coalesce((F.col("f__") + F.lag("f__").over(w)) / 2 * (F.col(r) - F.lag(r).over(w)), F.col("f__") * F.col(r) / 2)
    rows = rows.withColumn("step__", step).withColumn("i__", F.sum("step__").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("drr", F.col(dtt) + F.col("i__")).withColumn("ddd", F.col(dll) - F.col("i__")).drop("f__", "step__", "i__")


def helmholtz_spectra(df: DataFrame, key: str, k: str, cu: str, cv: str) -> DataFrame:
    """ke_rot and ke_div (and e_wave = 2 ke_div, e_vortex = 2 ke_rot) of one-dimensional spectra of the velocity along and
    across the track, by Buehler, Callies and Ferrari's integrals over the logarithm of the wavenumber.

    D_psi(k) is the integral from k up of (sinh(x) cu + cosh(x) cv) ds' with x = s - s' and s = ln k, D_phi the same with cu
    and cv exchanged; ke = (D - dD/ds) / 2. As sinh and cosh are sums of k/k' and k'/k, running trapezoids from the end give
    both."""
    after = Window.partitionBy(key).orderBy(F.col(k).desc())
    running = after.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("l__", F.log(k))
    for name, e in (("up_u", F.col(cu) * F.col(k)), ("down_u", F.col(cu) / F.col(k)), ("up_v", F.col(cv) * F.col(k)), ("down_v", F.col(cv) / F.col(k))):
        rows = rows.withColumn("e__", e)
        rows = rows.withColumn("e__", F.coalesce((F.col("e__") + F.lag("e__").over(after)) / 2 * (F.lag("l__").over(after) - F.col("l__")), F.lit(0.0)))
        rows = rows.withColumn(f"{name}__", F.sum("e__").over(running)).drop("e__")
    sinh = lambda c: (F.col(f"down_{c}__") * F.col(k) - F.col(f"up_{c}__") / F.col(k)) / 2
    cosh = lambda c: (F.col(f"down_{c}__") * F.col(k) + F.col(f"up_{c}__") / F.col(k)) / 2
    rows = rows.withColumn("d_psi__", sinh("u") + cosh("v")).withColumn("d_phi__", cosh("u") + sinh("v"))
    rows = central_difference(central_difference(rows, key, [k], "l__", "d_psi__", "r_psi__"), key, [k], "l__", "d_phi__", "r_phi__")
    rot, div = (F.col("d_psi__") - F.col("r_psi__")) / 2, (F.col("d_phi__") - F.col("r_phi__")) / 2
    return rows.select(*df.columns, rot.alias("ke_rot"), div.alias("ke_div"), (2 * div).alias("e_wave"), (2 * rot).alias("e_vortex"))


def resample(df: DataFrame, key: str, t: str, value: str, dt: float | None = None) -> DataFrame:
    """(key, t, value) on a uniform grid from a series' first time, linear between samples; t is a number. Without dt the
    step is the median spacing. A series is gathered into one array."""
    rows = df.where(finite(F.col(t)).isNotNull() & finite(F.col(value)).isNotNull())
    series = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(finite(F.col(t)).alias("z"), finite(F.col(value)).alias("v")))).alias("p__"))
    # Every gap between two samples holds its own grid points, so no point looks through the series.
    if dt is None:
        step = rows.withColumn("gap__", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))).groupBy(key).agg(F.median("gap__").alias("dt__"))
        series = series.join(step, key).where("dt__ > 0")
    else:
        series = series.withColumn("dt__", F.lit(float(dt)))
    series = series.withColumn("t0__", F.get("p__", F.lit(0))["z"])
    gaps = series.where(F.size("p__") > 1).select(key, "dt__", "t0__", F.explode(F.transform(F.sequence(F.lit(0), F.size("p__") - 2), lambda i: F.struct(F.get("p__", i).alias("a"), F.get("p__", i + 1).alias("b"), (i == F.size("p__") - 2).alias("last")))).alias("g"))
    low = F.ceil((F.col("g.a.z") - F.col("t0__")) / F.col("dt__") - 1e-9)
    high = F.when(F.col("g.last"), F.floor((F.col("g.b.z") - F.col("t0__")) / F.col("dt__") + 1e-9)).otherwise(F.ceil((F.col("g.b.z") - F.col("t0__")) / F.col("dt__") - 1e-9) - 1)
    points = gaps.withColumn("lo__", low).withColumn("hi__", high).where("lo__ <= hi__").withColumn("n__", F.explode(F.sequence("lo__", "hi__")))
    at = F.col("t0__") + F.col("n__") * F.col("dt__")
    return points.select(key, at.alias(t), (F.col("g.a.v") + (at - F.col("g.a.z")) / (F.col("g.b.z") - F.col("g.a.z")) * (F.col("g.b.v") - F.col("g.a.v"))).alias(value))


def segments(df: DataFrame, key: str, order: list[str], length: int = 256, hop: int = 128) -> DataFrame:
    """The rows of df once for every sliding segment they are in (segment from 0, place from 0); a tail is dropped."""
    w = Window.partitionBy(key)
    rows = df.withColumn("i__", F.row_number().over(w.orderBy(*order)) - 1).withColumn("last__", F.floor((F.count("*").over(w) - length) / hop)).where("last__ >= 0")
    first = F.greatest(F.ceil((F.col("i__") - length + 1) / hop), F.lit(0))
    rows = rows.withColumn("a__", first).withColumn("b__", F.least(F.floor(F.col("i__") / hop), F.col("last__"))).where("a__ <= b__")
    return rows.withColumn("segment", F.explode(F.sequence("a__", "b__"))).withColumn("place", F.col("i__") - F.col("segment") * hop).drop("i__", "last__", "a__", "b__")


def held_ends(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Missing values linear by index between the known ones; before the first and after the last the nearest known one."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("i__", F.row_number().over(w))
    known = F.when(finite(F.col(value)).isNotNull(), F.struct(F.col("i__").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumn("p__", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("q__", F.first(known, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    line = F.when(F.col("q__.i") > F.col("p__.i"), F.col("p__.v") + (F.col("q__.v") - F.col("p__.v")) * (F.col("i__") - F.col("p__.i")) / (F.col("q__.i") - F.col("p__.i")))
    return rows.withColumn(value, F.coalesce(line, "p__.v", "q__.v")).drop("i__", "p__", "q__")


def vorticity(df: DataFrame, keys: list[str], i: str, j: str, lon: str, lat: str, u: str, v: str) -> DataFrame:
    """dv/dx - du/dy by central differences in metres, NULL on the border of the grid."""
    along, across = Window.partitionBy(*keys, j).orderBy(i), Window.partitionBy(*keys, i).orderBy(j)
    width = 111e3 * F.cos(F.radians(F.avg(lat).over(Window.partitionBy(*keys))))
    dv = (F.lead(v).over(along) - F.lag(v).over(along)) / ((F.lead(lon).over(along) - F.lag(lon).over(along)) * width)
    du = (F.lead(u).over(across) - F.lag(u).over(across)) / ((F.lead(lat).over(across) - F.lag(lat).over(across)) * 111e3)
    return df.withColumn("vorticity", dv - du)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of every stratum, in order of a hash of key."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("nr__", F.row_number().over(w)).where(F.col("nr__") <= n).drop("nr__")


def tangent_plane(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """x and y in km around a series' mean position."""
    w = Window.partitionBy(key)
    east = F.radians(F.col(lon) - F.avg(lon).over(w)) * F.cos(F.radians(F.avg(lat).over(w)))
    return df.withColumns({"x_km": 6371.0 * east, "y_km": 6371.0 * F.radians(F.col(lat) - F.avg(lat).over(w))})
