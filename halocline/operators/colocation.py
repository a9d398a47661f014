"""Model-to-observation joins: nearest in time, bilinear on a grid, pairs within a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.scalars import ratio


def nearest_in_time(obs: DataFrame, model: DataFrame, max_hours: float, key: list[str] | None = None, obs_ts: str = "ts", model_ts: str = "model_ts") -> DataFrame:
    """Each obs row with the nearest model time at most max_hours away (ties: the earlier), else NULL.

    Times are dealt to cells of max_hours. The model times of a cell and the two beside it stand in one array, so this is a
    left equi-join with one row at most on the right, whatever the length of the series; no row is numbered or joined back."""
    key = key or []
    width = int(max_hours * 3600 * 1e6)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = obs.withColumn("at__", micros(obs_ts)).withColumn("cell__", F.floor(F.col("at__") / width))
    right = model.select(*key, F.struct(micros(model_ts).alias("t"), F.col(model_ts).alias("ts")).alias("to__")).where("to__.t IS NOT NULL").distinct()
    right = right.withColumn("cell__", F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: F.floor(F.col("to__.t") / width) + x)))
    right = right.groupBy("cell__", *key).agg(F.collect_list("to__").alias("times__"))
    gap = lambda x: F.abs(F.col("at__") - x["t"])
    best = F.array_min(F.transform(F.filter("times__", lambda x: gap(x) <= width), lambda x: F.struct(gap(x).alias("gap"), x["t"].alias("t"), x["ts"].alias("ts"))))
    met = left.join(right, ["cell__", *key], "left").withColumn("best__", best)
    return met.select(*obs.columns, F.col("best__.ts").alias(model_ts), (F.col("best__.gap") / 3.6e9).alias("gap_hours"))


def _placed(points: DataFrame, lon0: float, lat0: float, dlon: float, dlat: float) -> DataFrame:
    return points.withColumn("x__", (F.col("lon") - lon0) / dlon).withColumn("y__", (F.col("lat") - lat0) / dlat)


def bilinear(points: DataFrame, grid: DataFrame, lon0: float, lat0: float, dlon: float, dlat: float, on: list[str] | None = None) -> DataFrame:
    """points (lon, lat, *on) with `value` interpolated from grid (i, j, v, *on); NULL outside the grid or beside a missing corner.

    The grid's nodes are gathered into cells of four corners, and points find their cell by one left equi-join."""
    on = on or []
    edge = grid.agg(F.max("i"), F.max("j")).first()
    last = [max(0, (e or 0) - 1) for e in edge]
    p = _placed(points, lon0, lat0, dlon, dlat)
    inside = (F.col("x__") >= 0) & (F.col("y__") >= 0) & (F.col("x__") <= (edge[0] or 0)) & (F.col("y__") <= (edge[1] or 0))
    p = p.withColumn("ci", F.when(inside, F.least(F.floor("x__"), F.lit(last[0])))).withColumn("cj", F.when(inside, F.least(F.floor("y__"), F.lit(last[1]))))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    cells = grid.select(*on, "i", "j", "v", F.explode(corners).alias("c")).select(*on, (F.col("i") - F.col("c.a")).alias("ci"), (F.col("j") - F.col("c.b")).alias("cj"), "c.a", "c.b", "v")
    cells = cells.groupBy(*on, "ci", "cj").agg(*[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("v"))).alias(f"v{a}{b}__") for a in (0, 1) for b in (0, 1)])
    fx, fy = F.col("x__") - F.col("ci"), F.col("y__") - F.col("cj")
    value = (1 - fx) * (1 - fy) * F.col("v00__") + (1 - fx) * fy * F.col("v01__") + fx * (1 - fy) * F.col("v10__") + fx * fy * F.col("v11__")
    return p.join(cells, ["ci", "cj", *on], "left").select(*points.columns, value.alias("value"))


def nearest_node(points: DataFrame, grid: DataFrame, lon0: float, lat0: float, dlon: float, dlat: float, on: list[str] | None = None) -> DataFrame:
    """points with the `value` of the nearest node of a regular grid; the edge is held, a tie goes to the lower index."""
    on = on or []
    edge = grid.agg(F.max("i"), F.max("j")).first()
    place = lambda c, most: F.greatest(F.least(F.ceil(F.col(c) - 0.5), F.lit(most or 0)), F.lit(0))
    p = _placed(points, lon0, lat0, dlon, dlat).withColumn("i", place("x__", edge[0])).withColumn("j", place("y__", edge[1]))
    return p.join(grid.select(*on, "i", "j", F.col("v").alias("value")), ["i", "j", *on], "left").select(*points.columns, "value")


def colocate(obs: DataFrame, grid: DataFrame, times: DataFrame, corner: tuple[float, float], step: tuple[float, float], max_hours: float = 12.0, method: str = "bilinear") -> DataFrame:
    """obs (ts, lon, lat, ...) with the model's `value` at the nearest time (model_ts) and place; NULL where either fails.

    times (t, model_ts) names the grid's times, one row each; grid is (t, i, j, v). A trajectory is a table of obs too. Columns
    of obs called t, model_ts, gap_hours or value give way to the model's."""
    obs = obs.drop("t", "model_ts", "gap_hours", "value")
    matched = nearest_in_time(obs, times, max_hours).join(F.broadcast(times.select("t", "model_ts")), "model_ts", "left")  # a row a model time
    space = bilinear if method == "bilinear" else nearest_node
    return space(matched, grid, *corner, *step, ["t"]).select(*obs.columns, "model_ts", "gap_hours", "value")


def mooring(grid: DataFrame, stations: DataFrame, corner: tuple[float, float], step: tuple[float, float], on: str = "t") -> DataFrame:
    """(stations' columns, t, value): the series at fixed places (lon, lat), a bounded table, for every time of the grid."""
    times = grid.select(on).distinct()
    return bilinear(times.join(F.broadcast(stations)), grid, *corner, *step, [on])


def section(u: DataFrame, v: DataFrame, stations: DataFrame, corner: tuple[float, float], step: tuple[float, float], angle: float, on: str = "t") -> DataFrame:
    """(stations' columns, t, u, v, along): u sin(angle) + v cos(angle) at the points of a section (lon, lat), angle in degrees."""
    names = [on, *stations.columns]
    both = mooring(u, stations, corner, step, on).withColumnRenamed("value", "u").join(mooring(v, stations, corner, step, on).withColumnRenamed("value", "v"), names)
    turn = F.radians(F.lit(float(angle)))
    return both.withColumn("along", F.col("u") * F.sin(turn) + F.col("v") * F.cos(turn))


def regrid(grid: DataFrame, lons: DataFrame, lats: DataFrame, corner: tuple[float, float], step: tuple[float, float], on: str = "t") -> DataFrame:
    """(t, lon, lat, value) on the mesh of two axes (lon) and (lat), bounded tables, for every time."""
    return mooring(grid, lons.crossJoin(lats), corner, step, on)


def curvilinear(points: DataFrame, nodes: DataFrame, max_km: float, nearest: int = 4, on: list[str] | None = None) -> DataFrame:
    """points (id, lon, lat, *on) with `value` of nodes (lon, lat, v, *on): the nearest node's, or the mean of the four nearest
    by inverse square of distance in the plane (lon cos(mean lat), lat); NULL where none is within max_km.

    Nodes are looked for in cells as wide as max_km, the point's own and the eight around it. Nodes without a value count
    for nothing. As published, one nearest node's distance is d 111 / cos(mean lat) km, that of several d 111."""
    on = on or []
    shrink = F.greatest(F.cos(F.radians(F.avg("lat"))), F.lit(0.01))
    cos = nodes.agg(shrink.alias("c")).first()[0] or 1.0
    width = max_km / 111 * (cos if nearest == 1 else 1.0)
    flat = lambda df, *c: df.select(*c, (F.col("lon") * cos).alias("x__"), F.col("lat").alias("y__"))
    cell = lambda c: F.floor(F.col(c) / width)
    right = flat(nodes.where("v IS NOT NULL"), *on, F.col("v").alias("v__")).withColumnsRenamed({"x__": "nx__", "y__": "ny__"}).withColumn("ci__", cell("nx__")).withColumn("cj__", cell("ny__"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = flat(points, "id", *on).withColumn("n__", F.explode(around)).withColumn("ci__", cell("x__") + F.col("n__.a")).withColumn("cj__", cell("y__") + F.col("n__.b"))
    met = left.join(right, ["ci__", "cj__", *on]).withColumn("d__", F.sqrt((F.col("x__") - F.col("nx__")) ** 2 + (F.col("y__") - F.col("ny__")) ** 2))
    near = met.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d__", "v__"))), 1, nearest).alias("near__")).where(F.get("near__", F.lit(0))["d__"] <= width)
    weight = lambda x: 1 / (x["d__"] + 1e-10) ** 2
    total = F.aggregate("near__", F.lit(0.0), lambda s, x: s + weight(x))
    value = F.aggregate("near__", F.lit(0.0), lambda s, x: s + weight(x) * x["v__"]) / total
    return points.join(near.select("id", value.alias("value")), "id", "left").select(*points.columns, "value")


def by_name(a: DataFrame, b: DataFrame, name: str, columns_a: list[str], columns_b: list[str], clock: str) -> DataFrame:
    """Series of equal name joined by time. Raises where no name is in both, or where one has two rows at a time."""
    for df in (a, b):
        if not df.groupBy(name, clock).count().where("count > 1").isEmpty():
            raise ValueError("a name stands twice at one time")
    joined = a.select(name, clock, *columns_a).join(b.select(name, clock, *columns_b), [name, clock])
    if a.select(name).join(b.select(name), name, "left_semi").isEmpty():
        raise ValueError("no name is in both")
    return joined


def above_level(ridges: DataFrame, levels: DataFrame, freq: str, amp: str) -> DataFrame:
    """ridges with `significant`: whether amp squared passes the level of the nearest frequency (the first of equals); levels
    (place, freq, level) is bounded. Missing numbers are not significant."""
    table = levels.agg(F.array_sort(F.collect_list(F.struct("place", F.col("freq").alias("f"), "level"))).alias("levels__"))
    near = F.array_min(F.transform("levels__", lambda x: F.struct(F.abs(x["f"] - F.col(freq)).alias("d"), x["place"].alias("place"), x["level"].alias("level"))))
    known = F.col(freq).isNotNull() & ~F.isnan(freq) & F.col(amp).isNotNull() & ~F.isnan(amp)
    return ridges.crossJoin(F.broadcast(table)).withColumn("significant", F.coalesce(known & (F.col(amp) * F.col(amp) > near["level"]), F.lit(False))).drop("levels__")


def mutual_nearest(a: DataFrame, b: DataFrame, on: list[str], x: str, most: float) -> DataFrame:
    """(on, id_a, id_b, gap): pairs of a (id, x) and b (id, x) that are each other's nearest within `most`; ties: the lower id.

    Pairs meet in cells as wide as `most`."""
    cell = F.floor(F.col(x) / most)
    left = a.select(*on, F.col("id").alias("id_a"), F.col(x).alias("xa__"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell__"))
    right = b.select(*on, F.col("id").alias("id_b"), F.col(x).alias("xb__"), cell.alias("cell__"))
    met = left.join(right, [*on, "cell__"]).withColumn("gap", F.abs(F.col("xa__") - F.col("xb__"))).where(F.col("gap") <= most)
    best = lambda mine, other: met.groupBy(*on, mine).agg(F.min(F.struct("gap", other)).alias("m")).select(*on, mine, F.col(f"m.{other}").alias(other), "m.gap")
    return best("id_a", "id_b").join(best("id_b", "id_a").drop("gap"), [*on, "id_a", "id_b"]).select(*on, "id_a", "id_b", "gap")


def structure_functions(points: DataFrame, r_max: float, width: float) -> DataFrame:
    """Longitudinal and transverse velocity structure functions of points (id, snapshot, x, y, u, v) by bins [r, r + width).

    Points are dealt to cells of r_max; a pair is met in the cell of its first point, which the second joins from the
    nine cells around it, so only pairs within reach are formed."""
    cell = lambda c: F.floor(F.col(c) / r_max)
    a = points.select("snapshot", cell("x").alias("cx"), cell("y").alias("cy"), *[F.col(c).alias(f"{c}1") for c in ("id", "x", "y", "u", "v")])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = points.withColumn("d", F.explode(around)).select("snapshot", (cell("x") + F.col("d.i")).alias("cx"), (cell("y") + F.col("d.j")).alias("cy"), *[F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "u", "v")])
    p = a.join(b, ["snapshot", "cx", "cy"]).where("id1 < id2")
    p = p.withColumn("dx", F.col("x2") - F.col("x1")).withColumn("dy", F.col("y2") - F.col("y1")).withColumn("r", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).where((F.col("r") > 0) & (F.col("r") < r_max))
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    along, across = (du * F.col("dx") + dv * F.col("dy")) / F.col("r"), (dv * F.col("dx") - du * F.col("dy")) / F.col("r")
    out = p.groupBy(F.floor(F.col("r") / width).cast("int").alias("bin")).agg(F.count("*").alias("npairs"), F.round(F.avg(along**2), 8).alias("dll"), F.round(F.avg(across**2), 8).alias("dtt"))
    return out.select(((F.col("bin") + 0.5) * width).alias("r"), "npairs", "dll", "dtt")


def group_count_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.groupBy(on).agg(F.count("*").alias("n_a")).join(b.groupBy(on).agg(F.count("*").alias("n_b")), on).withColumn("ratio", F.round(ratio(F.col("n_b").cast("double"), F.col("n_a").cast("double")), 6))


def island_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Best Jaccard overlap of each interval of a (key, id, start, stop) with those of b (key, start, stop); inclusive ends, 0 if none."""
    met = a.join(b.select(key, F.col("start").alias("s2"), F.col("stop").alias("e2")), key).where("s2 <= stop AND start <= e2")
    common = F.least("stop", "e2") - F.greatest("start", "s2") + 1
    met = met.withColumn("j", common / (F.greatest("stop", "e2") - F.least("start", "s2") + 1))
    best = met.groupBy(key, "id").agg(F.max("j").alias("overlap"))
    return a.join(best, [key, "id"], "left").withColumn("overlap", F.round(F.coalesce("overlap", F.lit(0.0)), 6))


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("nr__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nr__ = 1").drop("nr__")
