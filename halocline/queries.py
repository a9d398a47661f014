"""The registered queries of the engine, each over its whole table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions import scalars
from halocline.operators import colocation, metrics, sequence
from halocline.plans import proxies
from halocline.plans.proxies import with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


_METRICS = """round(avg(m - o), 6) AS bias, round(avg(abs(m - o)), 6) AS mae, round(sqrt(avg((m - o) ** 2)), 6) AS rmse,
    round(sqrt(greatest(avg((m - o) ** 2) - avg(m - o) ** 2, 0)), 6) AS rmse_unbiased, round(stddev_pop(o), 6) AS std_obs, round(stddev_pop(m), 6) AS std_model,
    round(covar_pop(o, m) / nullif(stddev_pop(o) * stddev_pop(m), 0), 6) AS correlation, round(sqrt(greatest(avg((m - o) ** 2) - avg(m - o) ** 2, 0)) / nullif(stddev_pop(o), 0), 6) AS scatter_index,
    round(1 - avg((m - o) ** 2) / nullif(var_pop(o), 0), 6) AS skill_score, round(1 - avg((m - o) ** 2) / nullif(var_pop(o), 0), 6) AS nse"""


@query(f"SELECT CAST(count(*) AS DOUBLE) AS n, {_METRICS} FROM (SELECT obs AS o, model AS m FROM v_pairs)")
def a1_compute_metrics(spark, sf_dir):
    return metrics.metrics(proxies.pairs(spark, sf_dir), "obs", "model")


@query("""WITH x AS (SELECT obs AS o, model AS m, weight AS w FROM v_pairs), y AS (SELECT *, sum(w * o) OVER () / sum(w) OVER () AS mo, sum(w * m) OVER () / sum(w) OVER () AS mm FROM x)
    SELECT round(sum(w * (m - o)) / sum(w), 6) AS bias, round(sqrt(sum(w * (m - o) ** 2) / sum(w)), 6) AS rmse, round(sqrt(sum(w * (o - mo) ** 2) / sum(w)), 4) AS std_obs, round(sum(w * (o - mo) * (m - mm)) / sqrt(sum(w * (o - mo) ** 2) * sum(w * (m - mm) ** 2)), 6) AS correlation FROM y""")
def a1_weighted_metrics(spark, sf_dir):
    return metrics.metrics(proxies.pairs(spark, sf_dir), "obs", "model", weight="weight").select("bias", "rmse", F.round("std_obs", 4).alias("std_obs"), "correlation")


@query("SELECT round(stddev_pop(obs), 6) AS std_ref, round(stddev_pop(model), 6) AS std_test, round(covar_pop(obs, model) / (stddev_pop(obs) * stddev_pop(model)), 6) AS correlation, round(sqrt(avg((model - obs) ** 2) - avg(model - obs) ** 2), 6) AS rms_diff FROM v_pairs")
def a2_taylor_stats(spark, sf_dir):
    return metrics.taylor_stats(proxies.pairs(spark, sf_dir), "obs", "model")


@query(f"SELECT grp, CAST(count(*) AS DOUBLE) AS n, {_METRICS} FROM (SELECT grp, obs AS o, model AS m FROM v_pairs) GROUP BY grp")
def a4_metrics_by_group(spark, sf_dir):
    return metrics.metrics(proxies.pairs(spark, sf_dir), "obs", "model", ["grp"])


_ELLIPSE = """SELECT series_id, round(sqrt(greatest((uu + vv) / 2 + disc, 0)), 4) AS semi_major, round(sqrt(greatest((uu + vv) / 2 - disc, 0)), 4) AS semi_minor, round(d - 180 * floor(d / 180), 2) AS inclination, round(eke, 6) AS eke, round(mke, 6) AS mke
    FROM (SELECT *, sqrt(greatest(((uu + vv) / 2) ** 2 - (uu * vv - uv ** 2), 0)) AS disc, 90 - degrees(atan2(2 * uv, uu - vv)) / 2 AS d
          FROM (SELECT series_id, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, 0.5e0 * (var_samp(u) + var_samp(v)) AS eke, 0.5e0 * (avg(u) ** 2 + avg(v) ** 2) AS mke FROM v_drift GROUP BY series_id))"""


@query(_ELLIPSE)
def a6_variance_ellipse(spark, sf_dir):
    return metrics.variance_ellipse(proxies.drifters(spark, sf_dir), "u", "v", ["series_id"])


@query("""SELECT series_id, round(sqrt(avg((0.05e0 * u) ** 2)), 6) AS u_rmse, round(avg(0.05e0 * u), 6) AS u_bias, round(sqrt(avg((0.1e0) ** 2)), 6) AS v_rmse, round(avg(v + 0.1e0 - v), 6) AS v_bias,
    round(avg(sqrt((1.05e0 * u) ** 2 + (v + 0.1e0) ** 2) - sqrt(u ** 2 + v ** 2)), 6) AS speed_bias FROM v_drift GROUP BY series_id""")
def a5_current_ellipse_metrics(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).withColumn("mu", F.col("u") * 1.05).withColumn("mv", F.col("v") + 0.1)
    return metrics.current_ellipse_metrics(d, ("u", "v"), ("mu", "mv"), ["series_id"]).select("series_id", "u_rmse", "u_bias", "v_rmse", "v_bias", "speed_bias")


def _ellipse_of(prefix: str) -> str:
    tr, det = f"({prefix}uu + {prefix}vv)", f"({prefix}uu * {prefix}vv - {prefix}uv ** 2)"
    disc, turn = f"sqrt(greatest(({tr} / 2) ** 2 - {det}, 0))", f"(90 - degrees(atan2(2 * {prefix}uv, {prefix}uu - {prefix}vv)) / 2)"
    return f"""round(sqrt(greatest({tr} / 2 + {disc}, 0)), 4) AS {prefix}_semi_major, round(sqrt(greatest({tr} / 2 - {disc}, 0)), 4) AS {prefix}_semi_minor,
    round({turn} - 180 * floor({turn} / 180), 2) AS {prefix}_inclination, round({prefix}eke, 6) AS {prefix}_eke, round({prefix}mke, 6) AS {prefix}_mke"""


def _moments_of(prefix: str, u: str, v: str) -> str:
    return f"var_pop({u}) AS {prefix}uu, var_pop({v}) AS {prefix}vv, covar_pop({u}, {v}) AS {prefix}uv, 0.5e0 * (var_samp({u}) + var_samp({v})) AS {prefix}eke, 0.5e0 * (avg({u}) ** 2 + avg({v}) ** 2) AS {prefix}mke"


def _errors_of(name: str, o: str, m: str) -> str:
    return f"round(sqrt(avg(({m} - {o}) ** 2)), 6) AS {name}_rmse, round(avg({m} - {o}), 6) AS {name}_bias, round(covar_pop({o}, {m}) / nullif(stddev_pop({o}) * stddev_pop({m}), 0), 6) AS {name}_correlation"


@query(f"""WITH x AS (SELECT series_id, u AS ou, v AS ov, u * 1.05e0 AS mu, v + 0.1e0 AS mv FROM v_drift), y AS (SELECT *, sqrt(ou * ou + ov * ov) AS os, sqrt(mu * mu + mv * mv) AS ms FROM x),
    z AS (SELECT series_id, {_moments_of("obs", "ou", "ov")}, {_moments_of("mod", "mu", "mv")}, {_errors_of("u", "ou", "mu")}, {_errors_of("v", "ov", "mv")}, {_errors_of("speed", "os", "ms")} FROM y GROUP BY series_id)
    SELECT series_id, {_ellipse_of("obs")}, {_ellipse_of("mod")}, u_rmse, u_bias, u_correlation, v_rmse, v_bias, v_correlation, speed_rmse, speed_bias, speed_correlation FROM z""")
def a5_current_ellipse_metrics_all(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).withColumn("mu", F.col("u") * 1.05).withColumn("mv", F.col("v") + 0.1)
    return metrics.current_ellipse_metrics(d, ("u", "v"), ("mu", "mv"), ["series_id"])


@query("SELECT series_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(var_samp(value), 6) AS var FROM v_drift GROUP BY series_id")
def a7_series_stats(spark, sf_dir):
    return metrics.series_stats(proxies.drifters(spark, sf_dir), "value", ["series_id"])


@query("SELECT series_id, round(var_samp(u), 6) AS uu, round(covar_samp(u, v), 6) AS uv, round(var_samp(v), 6) AS vv FROM v_drift GROUP BY series_id")
def a8_channel_covariance(spark, sf_dir):
    return proxies.drifters(spark, sf_dir).groupBy("series_id").agg(F.round(F.var_samp("u"), 6).alias("uu"), F.round(F.covar_samp("u", "v"), 6).alias("uv"), F.round(F.var_samp("v"), 6).alias("vv"))


@query("SELECT grp, round(sqrt(avg((model - obs) ** 2)), 6) AS rmse, round(covar_pop(obs, model) / (stddev_pop(obs) * stddev_pop(model)), 6) AS correlation, round(1 - avg((model - obs) ** 2) / var_samp(obs), 6) AS skill, round(avg(model - obs), 6) AS bias FROM v_pairs GROUP BY grp")
def a12_validate(spark, sf_dir):
    return metrics.validate(proxies.pairs(spark, sf_dir), "obs", "model", ["grp"])


@query("""SELECT profile, count(*) AS levels, round(sum(slab) * 1025 * 3985 / 1e9, 6) AS heat_gj
    FROM (SELECT profile, (lead(depth) OVER w - depth) * (lead(temp) OVER w + temp) / 2 AS slab FROM v_profile WHERE depth BETWEEN 50 AND 400 WINDOW w AS (PARTITION BY profile ORDER BY depth)) GROUP BY profile HAVING count(*) >= 2""")
def a14_heat_content(spark, sf_dir):
    return sequence.heat_content(proxies.profiles(spark, sf_dir), "profile", "depth", "temp", 50, 400)


@query("""WITH x AS (SELECT sqrt(u * u + v * v) AS s, degrees(atan2(-u, -v)) AS d0 FROM v_drift), y AS (SELECT s, d0 - 360 * floor(d0 / 360) AS d FROM x),
    z AS (SELECT CASE WHEN s >= 1 THEN CAST(floor((d + 11.25e0) / 22.5e0) AS INT) % 16 END AS sector, CASE WHEN s < 1 THEN NULL WHEN s < 20 THEN 0 WHEN s < 60 THEN 1 WHEN s < 150 THEN 2 WHEN s < 1000 THEN 3 END AS level FROM y)
    SELECT sector, level, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM z), 6) AS percent FROM z WHERE sector IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2""")
def a15_wind_rose(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    return sequence.wind_rose(d, "u", "v", 16, [0, 20, 60, 150, 1000], 1.0)


@query("""WITH x AS (SELECT least(CAST(floor(l / 20 * 100) AS INT), 99) AS bin, kind FROM v_ridges WHERE l >= 0), c AS (SELECT bin, count(*) FILTER (kind = 'data') AS nd, count(*) FILTER (kind = 'noise') AS nn FROM x GROUP BY bin),
    s AS (SELECT bin, CAST(sum(nd) OVER (ORDER BY bin DESC) AS BIGINT) AS data_above, CAST(sum(nn) OVER (ORDER BY bin DESC) AS BIGINT) AS noise_above FROM c)
    SELECT bin, data_above, noise_above, round((noise_above / 5.0e0) / nullif(data_above / 1.0e0, 0), 6) AS rho FROM s""")
def a19_density_ratio(spark, sf_dir):
    return metrics.density_ratio(proxies.ridges(spark, sf_dir).withColumnRenamed("l", "x"), 1, 5)


@query("""WITH x AS (SELECT id, kind, npoints, omega_bar AS o, least(CAST(floor(l * abs(xi_bar) ** 4 / 20 * 2000) AS INT), 1999) AS bin FROM v_ridges), e AS (SELECT min(o) - 0.25e0 AS low, (max(o) + 0.25e0 - (min(o) - 0.25e0)) / 999 AS step FROM x),
    b AS (SELECT k AS band, low + k * step AS centre FROM range(1000) r(k), e), c AS (SELECT band, bin, coalesce(sum(npoints) FILTER (kind = 'data'), 0) / 1.0e0 AS d, coalesce(sum(npoints) FILTER (kind = 'noise'), 0) / 5.0e0 AS n FROM b JOIN x ON centre >= o - 0.125e0 AND centre <= o + 0.125e0 GROUP BY band, bin),
    s AS (SELECT band, bin, sum(d) OVER w AS sd, sum(n) OVER w AS sn FROM c WINDOW w AS (PARTITION BY band ORDER BY bin DESC))
    SELECT id, round(CASE WHEN sd > 0 THEN sn / sd ELSE 'inf'::DOUBLE END, 6) AS rho FROM x CROSS JOIN e LEFT JOIN s ON s.bin = x.bin AND s.band = CAST(round_even((o - low) / step, 0) AS INT) WHERE kind = 'data'""")
def a19_density_ratio_significance(spark, sf_dir):
    return metrics.density_ratio_significance(proxies.ridges(spark, sf_dir), 1, 5).select("id", F.round("rho", 6).alias("rho"))


@query("SELECT kind, count(*) AS events, round(avg(l), 6) AS mean_l, round(median(l), 6) AS median_l, round(avg(CASE WHEN xi_bar > 0 THEN 1.0e0 ELSE 0 END), 6) AS positive_share, round(sum(xi_bar * npoints) / sum(npoints), 6) AS weighted_xi FROM v_ridges GROUP BY kind")
def a20_event_statistics(spark, sf_dir):
    r = proxies.ridges(spark, sf_dir)
    return r.groupBy("kind").agg(F.count("*").alias("events"), F.round(F.avg("l"), 6).alias("mean_l"), F.round(F.median("l"), 6).alias("median_l"), F.round(F.avg((F.col("xi_bar") > 0).cast("double")), 6).alias("positive_share"), F.round(F.sum(F.col("xi_bar") * F.col("npoints")) / F.sum("npoints"), 6).alias("weighted_xi"))


@query("SELECT event_id, lon, lat, value FROM v_drift WHERE lon BETWEEN -95 AND -85 AND lat BETWEEN 20 AND 25 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def p1_range_filter(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    return d.where(F.col("lon").between(-95, -85) & F.col("lat").between(20, 25) & F.expr("ts BETWEEN TIMESTAMP_NTZ '2024-01-05' AND TIMESTAMP_NTZ '2024-01-20'")).select("event_id", "lon", "lat", "value")


@query("SELECT profile, depth, round(depth * 1.019716e0, 6) AS metres FROM v_profile")
def p2_pressure_to_depth(spark, sf_dir):
    return proxies.profiles(spark, sf_dir).select("profile", "depth", F.round(scalars.pressure_to_depth(F.col("depth")), 6).alias("metres"))


@query("SELECT event_id, round(abs(2 * 7.2921e-5 * sin(radians(lat))) * 3600 / (2 * pi()), 9) AS f_cph FROM v_drift")
def p5_inertial_frequency(spark, sf_dir):
    return proxies.drifters(spark, sf_dir).select("event_id", F.round(scalars.inertial_frequency(F.col("lat")), 9).alias("f_cph"))


@query("SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round(u * 2 + v, 6) AS mixed FROM v_drift")
def p8_speed(spark, sf_dir):
    return proxies.drifters(spark, sf_dir).select("event_id", F.round(scalars.speed(F.col("u"), F.col("v")), 6).alias("speed"), F.round(F.col("u") * 2 + F.col("v"), 6).alias("mixed"))


@query("SELECT event_id, CASE WHEN t >= 360 THEN 0 ELSE t END AS towards FROM (SELECT event_id, round(d - 360 * floor(d / 360), 6) AS t FROM (SELECT event_id, degrees(atan2(u, v)) AS d FROM v_drift))")
def p9_direction(spark, sf_dir):
    towards = F.round(scalars.direction_towards(F.col("u"), F.col("v")), 6)
    return proxies.drifters(spark, sf_dir).select("event_id", F.when(towards >= 360, 0.0).otherwise(towards).alias("towards"))


@query("SELECT event_id, round(atan(0.05e0 * s * s), 6) AS theta, round(400 * (1 - cos(atan(0.05e0 * s * s))), 6) AS drop, round(400 * sin(atan(0.05e0 * s * s)), 6) AS excursion FROM (SELECT event_id, sqrt(u * u + v * v) AS s FROM v_drift)")
def p12_knockdown(spark, sf_dir):
    theta, drop, excursion = scalars.knockdown(scalars.speed(F.col("u"), F.col("v")), 0.05, 400.0)
    return proxies.drifters(spark, sf_dir).select("event_id", F.round(theta, 6).alias("theta"), F.round(drop, 6).alias("drop"), F.round(excursion, 6).alias("excursion"))


@query("SELECT CASE WHEN npoints < 10 THEN 'small' WHEN npoints < 50 THEN 'mesoscale' ELSE 'large' END AS regime, sign(xi_bar) AS sense, count(*) AS n FROM v_ridges GROUP BY 1, 2")
def p26_size_regime(spark, sf_dir):
    return proxies.ridges(spark, sf_dir).groupBy(scalars.size_regime(F.col("npoints")).alias("regime"), F.signum("xi_bar").cast("tinyint").alias("sense")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 12 HOUR AS model_ts FROM v_drift WHERE extract(day FROM ts) % 3 = 0),
    x AS (SELECT event_id, ts, model_ts, abs(epoch_us(ts) - epoch_us(model_ts)) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(model_ts)), model_ts) AS nr FROM v_drift, m WHERE abs(epoch_us(ts) - epoch_us(model_ts)) <= 12 * 3600000000)
    SELECT d.event_id, x.model_ts, round(x.gap / 3.6e9, 6) AS gap_hours FROM v_drift d LEFT JOIN x ON d.event_id = x.event_id AND x.nr = 1""")
def j1_nearest_in_time(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    model = d.where("day(ts) % 3 = 0").select((F.expr("CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) + INTERVAL 12 HOUR")).alias("model_ts")).distinct()
    return colocation.nearest_in_time(d, model, 12).select("event_id", "model_ts", F.round("gap_hours", 6).alias("gap_hours"))


@query("""WITH p AS (SELECT event_id, lon, lat, CAST(event_id % 30 AS BIGINT) AS t, lon + 98 AS x, lat - 18 AS y FROM v_drift), q AS (SELECT *, least(floor(x), 18) AS ci, least(floor(y), 13) AS cj FROM p WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 14),
    r AS (SELECT event_id, sum((CASE WHEN g.i = ci THEN 1 - (x - ci) ELSE x - ci END) * (CASE WHEN g.j = cj THEN 1 - (y - cj) ELSE y - cj END) * g.v) AS value FROM q JOIN v_grid g ON g.t = q.t AND g.i BETWEEN ci AND ci + 1 AND g.j BETWEEN cj AND cj + 1 GROUP BY event_id)
    SELECT p.event_id, round(r.value, 6) AS value FROM p LEFT JOIN r ON p.event_id = r.event_id""")
def j4_bilinear(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).select("event_id", "lon", "lat", (F.col("event_id") % 30).alias("t"))
    return colocation.bilinear(d, proxies.grid(spark), -98.0, 18.0, 1.0, 1.0, ["t"]).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT a.event_id AS a, b.event_id AS b, a.ts FROM v_drift a JOIN v_drift b ON a.ts = b.ts AND a.series_id % 2 = 0 AND b.series_id % 2 = 1")
def j11_align_by_time(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).select("event_id", "ts", "series_id")
    a, b = d.where("series_id % 2 = 0").select(F.col("event_id").alias("a"), "ts"), d.where("series_id % 2 = 1").select(F.col("event_id").alias("b"), "ts")
    return a.join(b, "ts").select("a", "b", "ts")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def j12_station_lookup(spark, sf_dir):
    return proxies.table(spark, sf_dir, "supplier").join(proxies.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT event_id, series_id FROM v_drift WHERE series_id IN (SELECT series_id FROM v_drift GROUP BY series_id HAVING max(value) > 200)")
def j13_semi_join(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    return d.join(d.groupBy("series_id").agg(F.max("value").alias("top")).where("top > 200"), "series_id", "left_semi").select("event_id", "series_id")


@query("SELECT a.series_id, n_a, n_b, round(n_b / n_a, 6) AS ratio FROM (SELECT series_id, count(*) AS n_a FROM v_drift GROUP BY 1) a JOIN (SELECT series_id, count(*) AS n_b FROM v_drift WHERE value > 50 GROUP BY 1) b ON a.series_id = b.series_id")
def j14_group_count_join(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    return colocation.group_count_join(d, d.where("value > 50"), "series_id")


@query("""WITH p AS (SELECT a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2, b.x - a.x AS dx, b.y - a.y AS dy FROM v_points a JOIN v_points b ON a.snapshot = b.snapshot AND a.id < b.id), q AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS r FROM p)
    SELECT (floor(r / 5) + 0.5e0) * 5 AS r, count(*) AS npairs, round(avg((((u2 - u1) * dx + (v2 - v1) * dy) / r) ** 2), 8) AS dll, round(avg((((v2 - v1) * dx - (u2 - u1) * dy) / r) ** 2), 8) AS dtt FROM q WHERE r > 0 AND r < 40 GROUP BY floor(r / 5)""")
def j15_structure_functions(spark, sf_dir):
    return colocation.structure_functions(proxies.points(spark, sf_dir), 40.0, 5.0)


_W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)"


@query(f"""WITH x AS (SELECT series_id, ts, event_id, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS dt FROM v_drift {_W})
    SELECT series_id, ts, event_id, round(dt, 6) AS dt_hours, round(6371000.0e0 * radians(lon - lon0) * cos(radians((lat + lat0) / 2)) / (dt * 3600), 6) AS u_ms, round(6371000.0e0 * radians(lat - lat0) / (dt * 3600), 6) AS v_ms FROM x WHERE dt BETWEEN 2 AND 96""")
def w1_float_velocities(spark, sf_dir):
    return sequence.float_velocities(proxies.drifters(spark, sf_dir), "series_id", ORDER, 2, 96)


@query(f"""WITH x AS (SELECT series_id, ts, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0) AS s, coalesce(lag(u) OVER w, 0) AS u0, coalesce(lag(v) OVER w, 0) AS v0 FROM v_drift {_W})
    SELECT series_id, ts, event_id, round(sum(u0 * s / 1000) OVER w, 4) AS x_km, round(sum(v0 * s / 1000) OVER w, 4) AS y_km FROM x WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w2_progressive_vector(spark, sf_dir):
    return sequence.progressive_vector(proxies.drifters(spark, sf_dir), "series_id", ORDER)


@query("""WITH x AS (SELECT profile, depth, temp, lead(depth) OVER w AS d2, lead(temp) OVER w AS t2 FROM v_profile WINDOW w AS (PARTITION BY profile ORDER BY depth)),
    y AS (SELECT profile, depth, depth + coalesce((20 - temp) / nullif(t2 - temp, 0), 0.5e0) * (d2 - depth) AS z FROM x WHERE (temp - 20) * (t2 - 20) <= 0)
    SELECT profile, round(arg_min(z, depth), 6) AS isotherm_depth FROM y GROUP BY profile""")
def w3_isotherm_depth(spark, sf_dir):
    return sequence.isotherm_depth(proxies.profiles(spark, sf_dir), "profile", "depth", "temp", 20.0)


@query(f"""WITH x AS (SELECT series_id, ts, event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN value END AS x, row_number() OVER w AS i FROM v_drift {_W}),
    y AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i) AS p, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i DESC) AS q FROM x)
    SELECT y.series_id, y.ts, y.event_id, CASE WHEN y.x IS NOT NULL THEN y.x WHEN y.q - y.p <= 3 THEN a.x + (b.x - a.x) * (y.i - y.p) / (y.q - y.p) END AS filled
    FROM y LEFT JOIN x a ON a.series_id = y.series_id AND a.i = y.p LEFT JOIN x b ON b.series_id = y.series_id AND b.i = y.q""")
def w9_fill_gaps(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).withColumn("value", F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 5 != 0), F.col("value")))
    return sequence.fill_gaps(d, "series_id", ORDER, "value", 3)


@query(f"""WITH x AS (SELECT series_id, value > 30 AS f, row_number() OVER w AS i FROM v_drift {_W}), y AS (SELECT series_id, i, i - row_number() OVER (PARTITION BY series_id ORDER BY i) AS run FROM x WHERE f)
    SELECT series_id, min(i) AS start, max(i) AS stop, count(*) AS length FROM y GROUP BY series_id, run HAVING count(*) >= 3""")
def w12_islands(spark, sf_dir):
    return sequence.islands(proxies.drifters(spark, sf_dir).withColumn("f", F.col("value") > 30), "series_id", ORDER, "f", 3)


@query(f"SELECT series_id, (i - 1) // 5 AS block, round(avg(value), 6) AS mean FROM (SELECT series_id, value, row_number() OVER w AS i FROM v_drift {_W}) GROUP BY 1, 2 HAVING count(*) = 5")
def w13_block_average(spark, sf_dir):
    return sequence.block_average(proxies.drifters(spark, sf_dir), "series_id", ORDER, "value", 5)


@query("""WITH x AS (SELECT profile, depth, temp, lead(depth) OVER w AS d2, lead(temp) OVER w AS t2 FROM v_profile WINDOW w AS (PARTITION BY profile ORDER BY depth))
    SELECT profile, round(arg_min(temp + (200 - depth) / (d2 - depth) * (t2 - temp), depth), 6) AS value FROM x WHERE depth <= 200 AND d2 >= 200 GROUP BY profile""")
def w15_fixed_depth(spark, sf_dir):
    return sequence.fixed_depth(proxies.profiles(spark, sf_dir), "profile", "depth", "temp", 200.0)


@query("SELECT series_id, event_id, value FROM (SELECT series_id, event_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, event_id) AS nr FROM v_drift) WHERE nr <= 5")
def w18_top_by_amplitude(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir)
    from pyspark.sql import Window

    return d.withColumn("nr", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("value").desc(), "event_id"))).where("nr <= 5").select("series_id", "event_id", "value")
