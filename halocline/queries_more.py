"""More registered queries, with the same in SQL: scalars, vertical operators, sequences, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions import scalars
from halocline.operators import colocation, sequence, spectral, statistics, vertical, wavelets
from halocline.plans import proxies
from halocline.queries import ORDER, query


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT profile, depth, round(depth / 1.019716e0, 6) AS dbar FROM v_profile")
def p3_depth_to_pressure(spark, sf_dir):
    return proxies.profiles(spark, sf_dir).select("profile", "depth", F.round(scalars.depth_to_pressure(F.col("depth")), 6).alias("dbar"))


@query("SELECT profile, depth, round(depth, 3) AS again FROM v_profile")
def p3_depth_pressure_inverse(spark, sf_dir):
    """Newton's steps undo the depth of a pressure at a latitude."""
    d = proxies.profiles(spark, sf_dir)
    return d.select("profile", "depth", F.round(scalars.depth_to_pressure(scalars.pressure_to_depth(F.col("depth"), F.lit(25.0)), F.lit(25.0)), 3).alias("again"))


@query("SELECT profile, depth, round(1449.2e0 + 4.6e0 * temp - 0.055e0 * temp ** 2 + 0.00029e0 * temp ** 3 + (1.34e0 - 0.01e0 * temp) * (36 - 35) + 0.016e0 * depth, 6) AS c FROM v_profile")
def p4_sound_speed(spark, sf_dir):
    return proxies.profiles(spark, sf_dir).select("profile", "depth", F.round(scalars.sound_speed(F.col("temp"), F.lit(36.0), F.col("depth")), 6).alias("c"))


@query("SELECT event_id, round(6371.0e0 * radians(lon - avg(lon) OVER w) * cos(radians(avg(lat) OVER w)), 6) AS x_km, round(6371.0e0 * radians(lat - avg(lat) OVER w), 6) AS y_km FROM v_drift WINDOW w AS (PARTITION BY series_id)")
def p6_tangent_plane(spark, sf_dir):
    return _r(sequence.tangent_plane(proxies.drifters(spark, sf_dir), "series_id", "lon", "lat").select("event_id", "x_km", "y_km"), "x_km", "y_km")


@query("SELECT id, round(0.5e0 - xi_bar, 6) AS f_eff FROM v_ridges")
def p25_effective_frequency(spark, sf_dir):
    return proxies.ridges(spark, sf_dir).select("id", F.round(scalars.effective_frequency(F.lit(0.5), F.col("xi_bar")), 6).alias("f_eff"))


@query("SELECT id, round(-(npoints / 7.0e0) / (2 * (1 + id % 5)), 6) AS at, round(l - (npoints / 7.0e0) ** 2 / (4 * (1 + id % 5)), 6) AS value FROM v_ridges")
def p20_parabola(spark, sf_dir):
    """The vertex of (1 + id % 5) t^2 + npoints / 7 t + l from its values at -1, 0.5 and 2."""
    r, a, b = proxies.ridges(spark, sf_dir), 1 + F.col("id") % 5, F.col("npoints") / 7.0
    t = tuple(F.lit(x) for x in (-1.0, 0.5, 2.0))
    at, value = scalars.parabola_vertex(t, tuple(a * x * x + b * x + F.col("l") for x in t))
    return r.select("id", F.round(at, 6).alias("at"), F.round(value, 6).alias("value"))


@query("""WITH x AS (SELECT id, l * sqrt(1 + abs(xi_bar)) AS a, CASE WHEN xi_bar < 0 THEN -1 ELSE 1 END * l * sqrt(1 - abs(xi_bar)) AS b, omega_bar AS th, npoints / 10.0e0 AS ph FROM v_ridges)
    SELECT id, round(a * cos(th) * cos(ph) - b * sin(th) * sin(ph), 6) AS xr, round(a * cos(th) * sin(ph) + b * sin(th) * cos(ph), 6) AS xi, round(a * sin(th) * cos(ph) + b * cos(th) * sin(ph), 6) AS yr, round(a * sin(th) * sin(ph) - b * cos(th) * cos(ph), 6) AS yi FROM x""")
def p21_ellipse_signal(spark, sf_dir):
    made = scalars.ellipse_signal(F.col("l"), F.col("xi_bar"), F.col("omega_bar"), F.col("npoints") / 10.0)
    return proxies.ridges(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for c, n in zip(made, ("xr", "xi", "yr", "yi"), strict=True)])


@query("""SELECT id, round((l + npoints) / 2 + sqrt((l - npoints) ** 2 / 4 + xi_bar ** 2 + omega_bar ** 2), 6) AS d1, round(greatest((l + npoints) / 2 - sqrt((l - npoints) ** 2 / 4 + xi_bar ** 2 + omega_bar ** 2), 0), 6) AS d2 FROM v_ridges""")
def p22_eigenvalues(spark, sf_dir):
    d1, d2 = scalars.hermitian_eigenvalues(F.col("l"), F.col("npoints"), F.col("xi_bar"), F.col("omega_bar"))
    return proxies.ridges(spark, sf_dir).select("id", F.round(d1, 6).alias("d1"), F.round(d2, 6).alias("d2"))


@query("SELECT event_id, round(radians(lat), 6) AS lat, round(radians(lon), 6) AS lon FROM v_drift")
def p23_sphere_position(spark, sf_dir):
    a, o = F.radians("lat"), F.radians("lon")
    lat, lon = scalars.sphere_position(6371 * F.cos(a) * F.cos(o), 6371 * F.cos(a) * F.sin(o), 6371 * F.sin(a))
    return proxies.drifters(spark, sf_dir).select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("SELECT id, TIMESTAMP '1970-01-01' + to_milliseconds(CAST(round((719529 + 15000 + npoints / 7.0e0 - 719529) * 86400000) AS BIGINT)) AS ts FROM v_ridges")
def p24_datenum(spark, sf_dir):
    return proxies.ridges(spark, sf_dir).select("id", scalars.datenum_to_timestamp(719529 + 15000 + F.col("npoints") / 7.0).alias("ts"))


@query("SELECT k, round(-1 + (k + 0.5e0) / 32, 9) AS sc, round((exp(0.4e0 * c) - 1) / (1 - exp(-0.4e0)), 9) AS cs FROM (SELECT k, (1 - cosh(7 * (-1 + (k + 0.5e0) / 32))) / (cosh(7.0e0) - 1) AS c FROM range(32) t(k))")
def g1_stretching(spark, sf_dir):
    return _r(vertical.stretching(spark, 32, 7.0, 0.4, 4), "sc", "cs", digits=9)


_COLUMNS = "SELECT c_custkey AS cell, 100 + abs(c_acctbal) / 5 AS h, (c_custkey % 21 - 10) / 10.0e0 AS zeta FROM customer"


def _columns(spark, sf_dir):
    c = proxies.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("cell"), (100 + F.abs("c_acctbal") / 5).alias("h"), ((F.col("c_custkey") % 21 - 10) / 10.0).alias("zeta"))


@query(f"""WITH c AS ({_COLUMNS}), s AS (SELECT k, -1 + (k + 0.5e0) / 10 AS sc FROM range(10) t(k)), x AS (SELECT *, (1 - cosh(7 * sc)) / (cosh(7.0e0) - 1) AS cs FROM s)
    SELECT cell, k, round(zeta * (1 + (300 * sc + h * cs) / (300 + h)) + h * (300 * sc + h * cs) / (300 + h), 5) AS z FROM c, x""")
def g2_sigma_to_z(spark, sf_dir):
    found = vertical.z_levels(_columns(spark, sf_dir), vertical.stretching(spark, 10), 300.0)
    return found.select("cell", "k", F.round("z", 5).alias("z"))


_BRACKET = "SELECT profile, depth, temp, lead(depth) OVER w AS d2, lead(temp) OVER w AS t2 FROM v_profile WINDOW w AS (PARTITION BY profile ORDER BY depth)"


@query(f"""WITH b AS ({_BRACKET}), t AS (SELECT unnest([100.0e0, 205, 333]) AS zt), p AS (SELECT DISTINCT profile FROM v_profile),
    m AS (SELECT profile, zt, arg_min(temp + (zt - depth) / (d2 - depth) * (t2 - temp), depth) AS v FROM b JOIN t ON depth <= zt AND d2 >= zt GROUP BY ALL)
    SELECT p.profile, t.zt AS depth, round(m.v, 6) AS temp FROM p CROSS JOIN t LEFT JOIN m ON m.profile = p.profile AND m.zt = t.zt""")
def g4_interp_depths(spark, sf_dir):
    return _r(vertical.interp_depths(proxies.profiles(spark, sf_dir), ["profile"], "depth", "temp", [100, 205, 333]), "temp")


@query(f"""WITH b AS ({_BRACKET}), t AS (SELECT unnest([100.0e0, 205, 333]) AS zt), e AS (SELECT profile, arg_min(temp, depth) AS t0, min(depth) AS z0, arg_max(temp, depth) AS t1, max(depth) AS z1, count(*) AS n FROM v_profile GROUP BY profile),
    m AS (SELECT profile, zt, arg_min(temp + (zt - depth) / (d2 - depth) * (t2 - temp), depth) AS v FROM b JOIN t ON depth <= zt AND d2 >= zt GROUP BY ALL)
    SELECT e.profile, t.zt AS depth, round(CASE WHEN n >= 2 THEN CASE WHEN t.zt < z0 THEN t0 WHEN t.zt > z1 THEN t1 ELSE m.v END END, 6) AS temp, n AS n_instruments FROM e CROSS JOIN t LEFT JOIN m ON m.profile = e.profile AND m.zt = t.zt""")
def w15_project_to_depths(spark, sf_dir):
    return _r(vertical.project_to_depths(proxies.profiles(spark, sf_dir), ["profile"], "depth", "temp", [100, 205, 333], True), "temp")


@query("""WITH g AS (SELECT t, j, i, v FROM v_grid), x AS (SELECT t, j, i, (v + lag(v) OVER w) / 2 AS m, v, lag(i) OVER w AS before, lead(i) OVER w AS after FROM g WINDOW w AS (PARTITION BY t, j ORDER BY i))
    SELECT t, j, i, round(coalesce(m, v), 6) AS v FROM x UNION ALL SELECT t, j, i + 1, round(v, 6) FROM x WHERE after IS NULL""")
def g6_to_rho_points(spark, sf_dir):
    return _r(vertical.to_rho_points(proxies.grid(spark), ["t", "j"], "i", "v"), "v")


@query("""WITH x AS (SELECT id, snapshot, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, u - avg(u) OVER w AS c FROM v_points WINDOW w AS (PARTITION BY snapshot)),
    s AS (SELECT snapshot, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM x GROUP BY snapshot)
    SELECT id, round(c - (ac * bb - bc * ab) / (aa * bb - ab * ab) * a - (bc * aa - ac * ab) / (aa * bb - ab * ab) * b, 6) AS u FROM x JOIN s USING (snapshot) WHERE aa * bb - ab * ab > 1e-6""")
def g16_detrended_plane(spark, sf_dir):
    return _r(vertical.detrended_plane(proxies.points(spark, sf_dir), ["snapshot"], "x", "y", "u").where("u IS NOT NULL").select("id", "u"), "u")


@query("""WITH x AS (SELECT profile, depth AS p, depth * 1.019716e0 AS z, 1449.2e0 + 4.6e0 * temp - 0.055e0 * temp ** 2 + 0.00029e0 * temp ** 3 + (1.34e0 - 0.01e0 * temp) + 0.016e0 * depth AS c FROM v_profile),
    y AS (SELECT profile, 2 * (z - lag(z) OVER w) / ((c + lag(c) OVER w) / 2) AS t FROM x WINDOW w AS (PARTITION BY profile ORDER BY p))
    SELECT profile, round(sum(t), 9) AS tau, count(*) AS levels FROM y GROUP BY profile HAVING count(*) >= 3""")
def g11_travel_times(spark, sf_dir):
    p = proxies.profiles(spark, sf_dir).withColumn("salt", F.lit(36.0))
    return _r(vertical.travel_times(p, "profile", "depth", "temp", "salt"), "tau", digits=9)


@query("""WITH x AS (SELECT event_id, series_id, value / 100 AS tau, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS i FROM v_drift), y AS (SELECT *, i - avg(i) OVER w AS a, tau - avg(tau) OVER w AS b FROM x WINDOW w AS (PARTITION BY series_id)),
    s AS (SELECT series_id, coalesce(sum(a * b) / nullif(sum(a * a), 0), 0) AS slope FROM y GROUP BY series_id) SELECT event_id, round(-(1500.0e0 ** 2) * (b - slope * a) / 2000, 4) AS ssh_anomaly FROM y JOIN s USING (series_id)""")
def g14_ssh_anomaly(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).withColumn("tau", F.col("value") / 100)
    return vertical.ssh_anomaly(d, "series_id", ORDER, "tau").select("event_id", F.round("ssh_anomaly", 4).alias("ssh_anomaly"))


@query("""WITH x AS (SELECT profile, depth, temp, coalesce(lead(temp) OVER w, temp) - coalesce(lag(temp) OVER w, temp) AS dt, coalesce(lead(depth) OVER w, depth) - coalesce(lag(depth) OVER w, depth) AS dz FROM v_profile WINDOW w AS (PARTITION BY profile ORDER BY depth))
    SELECT profile, depth, round(CASE WHEN dz = 0 THEN 0 ELSE dt / dz END, 6) AS slope FROM x""")
def w5_central_difference(spark, sf_dir):
    return _r(sequence.central_difference(proxies.profiles(spark, sf_dir), "profile", ["depth"], "depth", "temp", "slope").select("profile", "depth", "slope"), "slope")


@query("""WITH p AS (SELECT event_id, series_id, ts, (k * 2.7e0 - 6.2e0 * floor(k * 2.7e0 / 6.2e0)) - 3.1e0 AS ph FROM v_drift), x AS (SELECT *, ph - lag(ph) OVER w AS j FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)),
    y AS (SELECT *, CASE WHEN j > pi() THEN -1 WHEN j < -pi() THEN 1 ELSE 0 END AS n FROM x) SELECT event_id, round(ph + 2 * pi() * sum(n) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 5) AS phase FROM y""")
def w7_unwrapped(spark, sf_dir):
    x = F.col("k") * 2.7
    d = proxies.drifters(spark, sf_dir).withColumn("ph", x - 6.2 * F.floor(x / 6.2) - 3.1)
    return sequence.unwrapped(d, "series_id", ORDER, "ph", "phase").select("event_id", F.round("phase", 5).alias("phase"))


@query("""WITH s AS (SELECT t, j, v, lon, lat, i FROM v_grid), x AS (SELECT t, i, j, (lead(v * 2) OVER a - lag(v * 2) OVER a) / ((lead(lon) OVER a - lag(lon) OVER a) * 111e3 * cos(radians(m))) AS dv, (lead(v) OVER b - lag(v) OVER b) / ((lead(lat) OVER b - lag(lat) OVER b) * 111e3) AS du
      FROM (SELECT *, avg(lat) OVER (PARTITION BY t) AS m FROM s) WINDOW a AS (PARTITION BY t, j ORDER BY i), b AS (PARTITION BY t, i ORDER BY j)) SELECT t, i, j, round((dv - du) * 1e6, 6) AS vorticity FROM x""")
def w4_vorticity(spark, sf_dir):
    g = proxies.grid(spark).withColumn("w", F.col("v") * 2)
    return sequence.vorticity(g, ["t"], "i", "j", "lon", "lat", "v", "w").select("t", "i", "j", F.round(F.col("vorticity") * 1e6, 6).alias("vorticity"))


@query("""WITH b AS (SELECT snapshot, 1 + id % 7 AS r, avg(abs(u)) AS dll, avg(abs(u)) + avg(v) AS dtt FROM v_points GROUP BY 1, 2), f AS (SELECT *, (dtt - dll) / r AS f FROM b), x AS (SELECT *, coalesce((f + lag(f) OVER w) / 2 * (r - lag(r) OVER w), f * r / 2) AS s FROM f WINDOW w AS (PARTITION BY snapshot ORDER BY r)),
    y AS (SELECT *, sum(s) OVER (PARTITION BY snapshot ORDER BY r ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT snapshot, r, round(dtt + i, 6) AS drr, round(dll - i, 6) AS ddd FROM y""")
def w8_helmholtz_structure(spark, sf_dir):
    b = proxies.points(spark, sf_dir).groupBy("snapshot", (1 + F.col("id") % 7).alias("r")).agg(F.avg(F.abs("u")).alias("dll"), (F.avg(F.abs("u")) + F.avg("v")).alias("dtt"))
    return _r(sequence.helmholtz_structure(b, "snapshot", "r", "dll", "dtt").select("snapshot", "r", "drr", "ddd"), "drr", "ddd")


@query("""WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v_drift)
    SELECT event_id, s AS segment, i - 4 * s AS place FROM x JOIN range(5000) t(s) ON i >= 4 * s AND i <= 4 * s + 7 AND 4 * s + 8 <= n""")
def w14_segments(spark, sf_dir):
    return sequence.segments(proxies.drifters(spark, sf_dir), "series_id", ORDER, 8, 4).select("event_id", "segment", "place")


@query("SELECT snapshot, round(sum(u) * 250 / 1e6, 9) AS transport_sv FROM v_points GROUP BY snapshot")
def a13_transport(spark, sf_dir):
    return _r(statistics.transport(proxies.points(spark, sf_dir), "snapshot", "u", 250.0), "transport_sv", digits=9)


@query("SELECT kind, round(regr_slope(log10(l), log10(npoints)), 6) AS slope, count(*) AS n FROM v_ridges WHERE npoints BETWEEN 30 AND 200 GROUP BY kind")
def a16_spectral_slope(spark, sf_dir):
    return _r(statistics.spectral_slope(proxies.ridges(spark, sf_dir), ["kind"], "npoints", "l", (30, 200)), "slope")


@query("""WITH s AS (SELECT kind, npoints / 100.0e0 AS f, avg(l) AS p FROM v_ridges GROUP BY 1, 2), d AS (SELECT kind, list_sort(list(DISTINCT f)) AS fs FROM s GROUP BY kind), b AS (SELECT * FROM (VALUES ('low', 0.0e0, 0.5e0), ('high', 0.5e0, 1.5e0), ('none', 5.0e0, 6.0e0)) t(band, lo, hi))
    SELECT d.kind, b.band, round(coalesce((SELECT sum(p) FROM s WHERE s.kind = d.kind AND f BETWEEN lo AND hi), 0) * (fs[2] - fs[1]), 6) AS energy FROM d, b""")
def a17_band_energy(spark, sf_dir):
    s = proxies.ridges(spark, sf_dir).groupBy("kind", (F.col("npoints") / 100.0).alias("f")).agg(F.avg("l").alias("p"))
    return _r(statistics.band_energy(s, ["kind"], "f", "p", {"low": (0.0, 0.5), "high": (0.5, 1.5), "none": (5.0, 6.0)}), "energy")


@query("""WITH x AS (SELECT kind, l * sqrt(1 + abs(xi_bar)) AS a, CASE WHEN xi_bar < 0 THEN -1 ELSE 1 END * l * sqrt(1 - abs(xi_bar)) AS b, omega_bar AS th FROM v_ridges),
    m AS (SELECT kind, avg(a ** 2 * cos(th) ** 2 + b ** 2 * sin(th) ** 2) AS xx, avg(a ** 2 * sin(th) ** 2 + b ** 2 * cos(th) ** 2) AS yy, avg((a ** 2 - b ** 2) * sin(th) * cos(th)) AS re, avg(a * b) AS im FROM x GROUP BY kind),
    g AS (SELECT *, xx + yy AS s, sqrt((xx - yy) ** 2 / 4 + re ** 2 + im ** 2) AS gap, sqrt((xx - yy) ** 2 / 4 + re ** 2) AS rgap FROM m)
    SELECT kind, round(2 * gap / s, 6) AS p, round(2 * im / s, 6) AS alpha, round(2 * rgap / s, 6) AS beta, round(sqrt(s / 2), 6) AS kbar, round(sqrt(sqrt((s / 2 + rgap) * (s / 2 - rgap))), 6) AS rbar FROM g""")
def a21_ellipse_polarization(spark, sf_dir):
    return _r(statistics.ellipse_polarization(proxies.ridges(spark, sf_dir), ["kind"], F.col("l"), F.col("xi_bar"), F.col("omega_bar"), F.col("npoints") / 10.0), "p", "alpha", "beta", "kbar", "rbar")


@query("SELECT snapshot, CAST(floor(sqrt(x * x + y * y) / 10) AS INT) AS bin, count(*) AS n, round(avg(u), 6) AS mean, (floor(sqrt(x * x + y * y) / 10) + 0.5e0) * 10 AS k FROM v_points WHERE sqrt(x * x + y * y) < 80 GROUP BY ALL")
def a22_radial_bins(spark, sf_dir):
    return _r(statistics.radial_bins(proxies.points(spark, sf_dir), ["snapshot"], "x", "y", "u", 80.0, 8), "mean")


@query("SELECT kind, npoints AS freq, round(p, 6) AS power FROM (SELECT kind, npoints, avg(l) AS p, row_number() OVER (PARTITION BY kind ORDER BY avg(l) DESC, npoints) AS nr FROM v_ridges WHERE npoints BETWEEN 65 AND 135 GROUP BY 1, 2) WHERE nr = 1")
def w16_local_peak(spark, sf_dir):
    s = proxies.ridges(spark, sf_dir).groupBy("kind", F.col("npoints").alias("freq")).agg(F.avg("l").alias("power"))
    return _r(statistics.local_peak(s, ["kind"], "freq", "power", 100.0), "power")


@query("""WITH d AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v_drift WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), e AS (SELECT * FROM d WHERE n >= 4),
    k AS (SELECT DISTINCT series_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT series_id, n FROM e))
    SELECT k.series_id, round(k.k * 1e0 / k.n, 6) AS freq, round((sum(x * cos(2 * pi() * k.k * i / k.n)) ** 2 + sum(x * sin(2 * pi() * k.k * i / k.n)) ** 2) / any_value(k.n), 4) AS power FROM k JOIN e ON e.series_id = k.series_id GROUP BY k.series_id, k.k, k.n""")
def f16_periodogram(spark, sf_dir):
    """The rotary periodogram of a real series: both senses hold the same power."""
    import numpy as np

    def kernel(x):
        if len(x) < 4:
            return {"freq": [], "power": []}
        found = spectral.rotary_periodogram(x, np.zeros(len(x)), 1.0)
        return {"freq": found["freq"].round(6), "power": found["s_ccw"].round(4)}

    return spectral.by_series(proxies.drifters(spark, sf_dir), "series_id", ORDER, ["value"], kernel, "freq double, power double")


@query("""WITH d AS (SELECT series_id, event_id, value * 1.0471975511965976e0 AS y, row_number() OVER w AS i FROM v_drift WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), s AS (SELECT series_id, regr_slope(y, i) AS a, regr_intercept(y, i) AS b FROM d GROUP BY series_id HAVING count(*) >= 3)
    SELECT series_id, CAST(i AS DOUBLE) AS i, round(y - a * i - b, 4) AS residual FROM d JOIN s USING (series_id)""")
def f17_detrend(spark, sf_dir):
    import numpy as np

    def kernel(y):
        if len(y) < 3:
            return {"i": [], "residual": []}
        return {"i": np.arange(1.0, len(y) + 1), "residual": spectral.detrended(y)[0].round(4)}

    d = proxies.drifters(spark, sf_dir).withColumn("y", F.col("value") * 1.0471975511965976)
    return spectral.by_series(d, "series_id", ORDER, ["y"], kernel, "i double, residual double")


@query()
def f8_rotary_spectrum(spark, sf_dir):
    names = ["freq", "s_ccw", "s_cw", "ci_ccw_lo", "ci_ccw_hi", "ci_cw_lo", "ci_cw_hi", "rotary_coef", "f_ccw", "f_cw"]
    kernel = lambda u, v: spectral.rotary_spectrum(u, v, 1.0, 2.0) if len(u) >= 16 else {n: [] for n in names}
    return spectral.by_series(proxies.drifters(spark, sf_dir), "series_id", ORDER, ["u", "v"], kernel, ", ".join(f"{n} double" for n in names))


@query()
def f6_multitaper(spark, sf_dir):
    names = ["freq", "power", "ftest_p", "jackknife_var"]
    kernel = lambda x: spectral.multitaper(x, 1.0, 2.0) if len(x) >= 16 else {n: [] for n in names}
    return spectral.by_series(proxies.drifters(spark, sf_dir), "series_id", ORDER, ["value"], kernel, ", ".join(f"{n} double" for n in names))


@query()
def r11_rotary_ridges(spark, sf_dir):
    names = ["start", "stop", "npoints", "l", "omega", "kappa", "sense", "xi_bar"]

    def kernel(u, v):
        return wavelets.rotary_ridges(u, v, wavelets.frequency_grid(3.0, 2.0, len(u), widths=1.0)) if len(u) >= 16 else {n: [] for n in names}

    return spectral.by_series(proxies.drifters(spark, sf_dir), "series_id", ORDER, ["u", "v"], kernel, ", ".join(f"{n} double" for n in names))


@query("SELECT a.event_id AS a, b.event_id AS b, date_trunc('hour', a.ts) AS hour FROM v_drift a JOIN v_drift b ON date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.series_id % 2 = 0 AND b.series_id % 2 = 1")
def j11_align_by_hour(spark, sf_dir):
    """Two sets of series on a clock of hours; the exact clock of `j11_align_by_time` has no common times in the test tables."""
    d = proxies.drifters(spark, sf_dir).select("event_id", "series_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    a, b = d.where("series_id % 2 = 0").select(F.col("event_id").alias("a"), "hour"), d.where("series_id % 2 = 1").select(F.col("event_id").alias("b"), "hour")
    return a.join(b, "hour").select("a", "b", "hour")


@query("""WITH x AS (SELECT event_id, CAST(event_id % 30 AS BIGINT) AS t, CAST(greatest(least(ceil(lon * 1.3e0 + 29.7e0 + 98 - 0.5e0), 19), 0) AS BIGINT) AS i, CAST(greatest(least(ceil(lat - 18 - 0.5e0), 14), 0) AS BIGINT) AS j FROM v_drift)
    SELECT event_id, g.v AS value FROM x LEFT JOIN v_grid g ON g.t = x.t AND g.i = x.i AND g.j = x.j""")
def j4_nearest_node(spark, sf_dir):
    """Some points lie outside the grid, where its edge is held."""
    d = proxies.drifters(spark, sf_dir).select("event_id", (F.col("lon") * 1.3 + 29.7).alias("lon"), "lat", (F.col("event_id") % 30).alias("t"))
    return colocation.nearest_node(d, proxies.grid(spark), -98.0, 18.0, 1.0, 1.0, ["t"]).select("event_id", "value")


@query("""WITH p AS (SELECT event_id, CAST(event_id % 30 AS BIGINT) AS t, lon * 1.3e0 + 29.7e0 + 98 AS x, lat - 18 AS y FROM v_drift), q AS (SELECT *, least(floor(x), 18) AS ci, least(floor(y), 13) AS cj FROM p WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 14),
    g AS (SELECT * FROM v_grid WHERE (i + 3 * j + t) % 17 <> 0),
    r AS (SELECT event_id, sum((CASE WHEN g.i = ci THEN 1 - (x - ci) ELSE x - ci END) * (CASE WHEN g.j = cj THEN 1 - (y - cj) ELSE y - cj END) * g.v) AS value FROM q JOIN g ON g.t = q.t AND g.i BETWEEN ci AND ci + 1 AND g.j BETWEEN cj AND cj + 1 GROUP BY event_id HAVING count(*) = 4)
    SELECT p.event_id, round(r.value, 6) AS value FROM p LEFT JOIN r ON p.event_id = r.event_id""")
def j4_bilinear_gaps(spark, sf_dir):
    """Points outside the grid and beside missing corners have no value."""
    d = proxies.drifters(spark, sf_dir).select("event_id", (F.col("lon") * 1.3 + 29.7).alias("lon"), "lat", (F.col("event_id") % 30).alias("t"))
    grid = proxies.grid(spark).where("(i + 3 * j + t) % 17 <> 0")
    return _r(colocation.bilinear(d, grid, -98.0, 18.0, 1.0, 1.0, ["t"]).select("event_id", "value"), "value")


@query("""WITH d AS (SELECT event_id, ts, lon + 98 AS x, lat - 18 AS y FROM v_drift), m AS (SELECT t, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(t AS INT)) AS model_ts FROM range(30) r(t)),
    n AS (SELECT event_id, t, model_ts, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(model_ts)), model_ts) AS nr FROM d, m WHERE abs(epoch_us(ts) - epoch_us(model_ts)) <= 6 * 3600000000),
    q AS (SELECT d.event_id, n.t, n.model_ts, x, y, least(floor(x), 18) AS ci, least(floor(y), 13) AS cj FROM d LEFT JOIN n ON n.event_id = d.event_id AND nr = 1),
    r AS (SELECT event_id, sum((CASE WHEN g.i = ci THEN 1 - (x - ci) ELSE x - ci END) * (CASE WHEN g.j = cj THEN 1 - (y - cj) ELSE y - cj END) * g.v) AS value FROM q JOIN v_grid g ON g.t = q.t AND g.i BETWEEN ci AND ci + 1 AND g.j BETWEEN cj AND cj + 1 WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 14 GROUP BY event_id)
    SELECT q.event_id, q.model_ts, round(r.value, 6) AS value FROM q LEFT JOIN r ON r.event_id = q.event_id""")
def j2_colocate(spark, sf_dir):
    times = spark.range(30).select(F.col("id").alias("t"), F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(CAST(id AS INT))").alias("model_ts"))
    found = colocation.colocate(proxies.drifters(spark, sf_dir), proxies.grid(spark), times, (-98.0, 18.0), (1.0, 1.0), 6.0)
    return _r(found.select("event_id", "model_ts", "value"), "value")


_CORNERS = "sum((CASE WHEN g.i = ci THEN 1 - (x - ci) ELSE x - ci END) * (CASE WHEN g.j = cj THEN 1 - (y - cj) ELSE y - cj END) * g.v)"


@query(f"""WITH s AS (SELECT n_nationkey AS station, n_nationkey * 0.7e0 AS x, n_nationkey * 0.5e0 AS y FROM nation), q AS (SELECT *, least(floor(x), 18) AS ci, least(floor(y), 13) AS cj FROM s)
    SELECT station, g.t, round({_CORNERS} * sin(radians(30)) - {_CORNERS} * 2 * cos(radians(30)), 6) AS along FROM q JOIN v_grid g ON g.i BETWEEN ci AND ci + 1 AND g.j BETWEEN cj AND cj + 1 GROUP BY station, g.t""")
def j8_section(spark, sf_dir):
    s = proxies.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station"), (F.col("n_nationkey") * 0.7 - 98).alias("lon"), (F.col("n_nationkey") * 0.5 + 18).alias("lat"))
    grid = proxies.grid(spark)
    return _r(colocation.section(grid, grid.withColumn("v", -2 * F.col("v")), s, (-98.0, 18.0), (1.0, 1.0), 30.0).select("station", "t", "along"), "along")


@query("""WITH a AS (SELECT i * 0.9e0 + 0.2e0 AS x, j * 1.1e0 + 0.3e0 AS y FROM range(20) p(i), range(12) q(j)), b AS (SELECT *, least(floor(x), 18) AS ci, least(floor(y), 13) AS cj FROM a)
    SELECT g.t, round(x - 98, 6) AS lon, round(y + 18, 6) AS lat, round(sum((CASE WHEN g.i = ci THEN 1 - (x - ci) ELSE x - ci END) * (CASE WHEN g.j = cj THEN 1 - (y - cj) ELSE y - cj END) * g.v), 6) AS value FROM b JOIN v_grid g ON g.i BETWEEN ci AND ci + 1 AND g.j BETWEEN cj AND cj + 1 GROUP BY g.t, x, y""")
def j6_regrid(spark, sf_dir):
    lons, lats = spark.range(20).select((F.col("id") * 0.9 + 0.2 - 98).alias("lon")), spark.range(12).select((F.col("id") * 1.1 + 0.3 + 18).alias("lat"))
    return _r(colocation.regrid(proxies.grid(spark), lons, lats, (-98.0, 18.0), (1.0, 1.0)).select("t", "lon", "lat", "value"), "lon", "lat", "value")


@query("""WITH c AS (SELECT cos(radians(avg(lat))) AS c FROM v_grid), p AS (SELECT event_id AS id, CAST(event_id % 30 AS BIGINT) AS t, lon, lat FROM v_drift),
    d AS (SELECT p.id, g.v, sqrt(((p.lon - g.lon) * c) ** 2 + (p.lat - g.lat) ** 2) AS d FROM p JOIN v_grid g ON g.t = p.t, c WHERE abs(p.lat - g.lat) <= 3 AND abs(p.lon - g.lon) <= 3), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, v) AS nr, min(d) OVER (PARTITION BY id) AS least FROM d),
    r AS (SELECT id, sum(v / (d + 1e-10) ** 2) / sum(1 / (d + 1e-10) ** 2) AS value FROM n WHERE nr <= 4 AND least <= 166.5e0 / 111 GROUP BY id) SELECT p.id, round(r.value, 5) AS value FROM p LEFT JOIN r USING (id)""")
def j5_curvilinear(spark, sf_dir):
    d = proxies.drifters(spark, sf_dir).select(F.col("event_id").alias("id"), "lon", "lat", (F.col("event_id") % 30).alias("t"))
    return _r(colocation.curvilinear(d, proxies.grid(spark).select("t", "lon", "lat", "v"), 166.5, 4, ["t"]).select("id", "value"), "value", digits=5)


@query("""WITH f AS (SELECT k, 0.1e0 * 1.3e0 ** k AS f, 4.0e0 + k % 7 AS level FROM range(20) r(k)), x AS (SELECT id, level, row_number() OVER (PARTITION BY id ORDER BY abs(f - npoints / 50.0e0), k) AS nr, l FROM v_ridges, f) SELECT id, l * l > level AS significant FROM x WHERE nr = 1""")
def j16_above_level(spark, sf_dir):
    levels = spark.range(20).select(F.col("id").alias("place"), (0.1 * F.pow(F.lit(1.3), F.col("id"))).alias("freq"), (4.0 + F.col("id") % 7).alias("level"))
    r = proxies.ridges(spark, sf_dir).withColumn("freq", F.col("npoints") / 50.0)
    return colocation.above_level(r, levels, "freq", "l").select("id", "significant")


@query("""WITH a AS (SELECT id, snapshot, u * 100 + id / 1e4 AS x FROM v_points WHERE id % 2 = 0), b AS (SELECT id, snapshot, u * 100 + id / 1e4 AS x FROM v_points WHERE id % 2 = 1), p AS (SELECT a.snapshot, a.id AS id_a, b.id AS id_b, abs(a.x - b.x) AS gap FROM a JOIN b ON a.snapshot = b.snapshot AND abs(a.x - b.x) <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, id_a ORDER BY gap, id_b) AS ra, row_number() OVER (PARTITION BY snapshot, id_b ORDER BY gap, id_a) AS rb FROM p) SELECT snapshot, id_a, id_b, round(gap, 6) AS gap FROM r WHERE ra = 1 AND rb = 1""")
def j18_mutual_nearest(spark, sf_dir):
    p = proxies.points(spark, sf_dir).withColumn("x", F.col("u") * 100 + F.col("id") / 1e4)
    return _r(colocation.mutual_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["snapshot"], "x", 2.0), "gap")
