"""Operators without an SQL form against plain versions, and the readers on small files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import scalars, units
from halocline.operators import metrics, sequence, spectral, statistics, vertical, wavelets
from halocline.sources import text

RNG = np.random.default_rng(5)
N = 128
T = np.arange(N)
U, V = np.cos(2 * np.pi * 12 * T / N) + 0.1 * RNG.normal(size=N), np.sin(2 * np.pi * 12 * T / N) + 0.1 * RNG.normal(size=N)


def test_tapers_are_slepians():
    tapers, kept = spectral.slepian_tapers(64, 5, 3.0)
    lag = np.subtract.outer(np.arange(64), np.arange(64))
    values = np.linalg.eigvalsh(np.sinc(2 * 3 / 64 * lag) * 2 * 3 / 64)[::-1][:5]
    assert np.allclose(tapers @ tapers.T, np.eye(5), atol=1e-10) and np.allclose(kept, values, atol=1e-9)


def test_white_noise_has_its_variance():
    x = RNG.normal(size=512)
    found = spectral.multitaper(x, 0.5)
    assert found["power"].sum() * (found["freq"][1] - found["freq"][0]) == pytest.approx(x.var(), rel=0.15)
    assert (found["ftest_p"] < 0.01).mean() < 0.05
    k, p = spectral.welch(x, 0.5, 128)
    assert p.sum() * (k[1] - k[0]) == pytest.approx(x.var(), rel=0.2)


def test_rotary_spectrum_finds_the_sense():
    found = spectral.rotary_spectrum(U, V, 1.0)
    at = found["s_ccw"].argmax()
    assert found["freq"][at] == 12 / N and found["rotary_coef"][at] > 0.9 and found["f_ccw"][at] < 1e-6
    assert ((found["ci_ccw_lo"] <= found["s_ccw"]) & (found["s_ccw"] <= found["ci_ccw_hi"])).all()
    mirrored = spectral.rotary_spectrum(U, -V, 1.0)
    assert np.allclose(mirrored["s_cw"], found["s_ccw"])


def test_coherence_of_a_series_with_itself_and_with_noise():
    same = spectral.rotary_coherence(U, V, 2 * U, 2 * V, 1.0)
    assert np.allclose(same["coh_ccw"], 1) and np.allclose(same["phase_ccw"], 0, atol=1e-9)
    noise = spectral.cross_coherence(RNG.normal(size=N), RNG.normal(size=N), 1.0)
    assert (noise["coherence"] > noise["sig_level"]).mean() < 0.2 and noise["sig_level"][0] == pytest.approx(1 - 0.05 ** (1 / 6))


def test_polarization_is_that_of_the_eigenvectors():
    m = RNG.normal(size=(2, 2)) + 1j * RNG.normal(size=(2, 2))
    s = m @ m.conj().T
    found = spectral.polarization(s[0, 0].real, s[1, 1].real, s[0, 1])
    values = np.linalg.eigvalsh(s)
    assert (found["d2"], found["d1"]) == (pytest.approx(values[0]), pytest.approx(values[1])) and found["p"] == pytest.approx((values[1] - values[0]) / values.sum())


def test_filters_hilbert_and_surrogates():
    x = np.cos(2 * np.pi * 5 * T / N) + np.cos(2 * np.pi * 30 * T / N) + 3
    assert np.allclose(spectral.band_filter(x, 1.0, 4 / N, 6 / N), np.cos(2 * np.pi * 5 * T / N))
    assert np.allclose(spectral.band_filter(x, 1.0, high=0.1), np.cos(2 * np.pi * 5 * T / N) + 3)
    assert np.allclose(spectral.hilbert(x - 3), np.exp(2j * np.pi * 5 * T / N) + np.exp(2j * np.pi * 30 * T / N))
    noise = spectral.noise_spectrum(U, V, 1.0)
    assert noise["s_iso"].sum() == pytest.approx(noise["s"].sum()) and np.allclose(noise["s_iso"][1:], noise["s_iso"][1:][::-1])
    assert (spectral.noise_surrogate(U, V, 1.0, 3) == spectral.noise_surrogate(U, V, 1.0, 3)).all()


def test_fields_and_singular_values():
    y, x = np.mgrid[0:64, 0:64]
    wave = np.cos(2 * np.pi * (8 * x) / 64) + 0.3 * x
    found = spectral.isotropic_spectrum(wave, 1.0, 1.0, 32)
    assert abs(found["k"][np.nanargmax(found["p11"])] - 8 / 64) < 0.03
    assert np.nanmax(np.abs(spectral.isotropic_spectrum(wave, 1.0, 1.0, 32, wave)["coherence"] - 1)) < 1e-9
    w = RNG.normal(size=(3, 4, 5)) + 1j * RNG.normal(size=(3, 4, 5))
    found = spectral.multivariate_svd(w)
    assert np.allclose(found["trace"], (np.abs(w) ** 2).sum((1, 2)) / 20) and (found["d1"] >= found["d2"]).all()


def test_wavelets_of_a_cosine():
    x = 2 * np.cos(2 * np.pi * 16 * np.arange(256) / 256)
    grid = wavelets.frequency_grid(3.0, 8.0, 256)
    w = wavelets.transform(x, grid)
    found = wavelets.ridge_map(w, grid)
    assert (np.diff(grid) < 0).all() and found["amp"][128] == pytest.approx(2, rel=0.01) and found["freq"][128] == pytest.approx(2 * np.pi / 16, rel=0.05)
    assert wavelets.decoded(w, "freq")[128, found["place"][128] - 1] == pytest.approx(2 * np.pi / 16, rel=1e-3)
    assert np.allclose(wavelets.transform(x, grid, boundary="mirror").shape, w.shape)
    bank = wavelets.filter_bank(4096, 3.0, 8.0, grid)
    assert np.allclose(bank.max(0)[5:], 1, atol=1e-3)


def test_ridges_have_sense_and_length():
    t = np.arange(300)
    u, v = np.cos(0.4 * t), -np.sin(0.4 * t)
    found = wavelets.rotary_ridges(u, v, wavelets.frequency_grid(3.0, 8.0, 300), least=0.2)
    best = int(np.argmax(found["l"]))
    assert found["sense"][best] == -1 and found["omega"][best] == pytest.approx(0.4, rel=0.05) and found["xi_bar"][best] < -0.9 and found["l"][best] > 10
    joint = wavelets.moments(np.exp(0.4j * t), 2 * np.exp(0.4j * t))
    assert np.allclose(joint["freq"], 0.4) and np.allclose(joint["bandwidth"], 0, atol=1e-9)


def test_noise_is_rarely_significant():
    grid = wavelets.frequency_grid(3.0, 8.0, 128)
    x = RNG.normal(size=128)
    level = wavelets.significance(x, grid, 0.95, 60)
    found = wavelets.ridge_map(wavelets.transform(x, grid), grid)
    assert wavelets.significant(found["freq"], found["amp"], level, grid).mean() < 0.3
    assert not wavelets.significant(np.array([np.nan]), np.array([1e9]), level, grid)[0]


def test_series_go_through_the_kernels(spark):
    rows = [(s, i, float(U[i])) for s in ("a", "b") for i in range(N)]
    found = spectral.by_series(spark.createDataFrame(rows, "s string, i int, x double").repartition(3), "s", ["i"], ["x"], lambda x: {"freq": spectral.welch(x, 1.0, 64)[0], "power": spectral.welch(x, 1.0, 64)[1]}, "freq double, power double")
    want = spectral.welch(U, 1.0, 64)[1]
    assert [r.power for r in found.where("s = 'b'").orderBy("freq").collect()] == pytest.approx(want.tolist())


def test_helmholtz_spectra_of_pure_parts(spark):
    """Power laws have closed forms: ke_rot + ke_div is half the sum of both spectra."""
    k = np.exp(np.linspace(0, 9, 900))
    rows = [(1, float(x), float(x**-3.0), float(3 * x**-3.0)) for x in k]  # rotational: cv = -d(k cu)/dk + ... = 3 cu
    found = sequence.helmholtz_spectra(spark.createDataFrame(rows, "g int, k double, cu double, cv double"), "g", "k", "cu", "cv").orderBy("k").collect()
    inner = found[100:500]
    assert all(r.ke_rot + r.ke_div == pytest.approx((r.cu + r.cv) / 2, rel=0.01) for r in inner)
    assert all(abs(r.ke_div) < 0.02 * r.ke_rot and r.e_vortex == 2 * r.ke_rot for r in inner)


def test_resampled_series(spark):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 2.5, 40.0), ("a", 3.5, None), ("a", 4.0, 10.0), ("b", 1.0, 1.0), ("c", 0.0, None)]
    df = spark.createDataFrame(rows, "s string, t double, x double")
    found = {(r.s, round(r.t, 6)): r.x for r in sequence.resample(df, "s", "t", "x", 0.5).collect()}
    assert found == {("a", float(t)): pytest.approx(float(x)) for t, x in zip(np.arange(0, 4.1, 0.5), np.interp(np.arange(0, 4.1, 0.5), [0, 1, 2.5, 4], [0, 10, 40, 10]), strict=True)}
    assert [r.t for r in sequence.resample(df, "s", "t", "x").where("s = 'a'").orderBy("t").collect()] == [0.0, 1.5, 3.0]
    held = sequence.held_ends(df, "s", ["t"], "x").where("s = 'a'").orderBy("t").collect()
    assert [r.x for r in held] == [0.0, 10.0, 40.0, 25.0, 10.0] and sequence.held_ends(df, "s", ["t"], "x").where("s = 'c'").first().x is None


def test_gem_round_trip(spark, tmp_path):
    rows = [(p, float(z), 20.0 - z / 100 + p, 35.0 + p / 10) for p in range(6) for z in (0, 100, 300, 700)]
    tables = vertical.gem_tables(spark.createDataFrame(rows, "p int, z double, t double, s double"), "p", "z", "t", "s", [50, 200, 900])
    text.write_gem(tables, f"file://{tmp_path}/gem")
    tables = text.read_gem(spark, f"file://{tmp_path}/gem")
    assert [r.depth for r in tables.orderBy("depth").collect()] == [50.0, 200.0]
    taus = vertical.travel_times(spark.createDataFrame(rows, "p int, z double, t double, s double"), "p", "z", "t", "s").where("p = 3").select("tau")
    found = vertical.gem_lookup(tables, taus).orderBy("depth").first()
    assert found.t == pytest.approx(20 - 50 / 1.019716 / 100 + 3, abs=1e-6) and found.s == pytest.approx(35.3)
    assert vertical.gem_lookup(tables, spark.createDataFrame([(1e9,), (-1e9,)], "tau double")).where("t IS NULL").count() == 0


def test_masks_surfaces_and_missing_levels(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (2, 1, None)], "c int, k int, v double")
    mask = spark.createDataFrame([(1, 1), (2, 0)], "c int, mask int")
    assert [(r.c, r.v) for r in vertical.surface(vertical.masked(cells, mask, ["c"], "v"), ["c"], "k").orderBy("c").collect()] == [(1, 2.0), (2, None)]
    levels = spark.createDataFrame([(1, 0.0, 5.0), (1, 10.0, None), (1, 20.0, 7.0), (2, 0.0, 5.0), (2, 0.0, 7.0)], "p int, z double, v double")
    assert [r.v for r in vertical.interp_depths(levels, ["p"], "z", "v", [5.0], keep_missing=True).where("p = 1").collect()] == [None]
    assert vertical.interp_depths(levels, ["p"], "z", "v", [5.0]).where("p = 1").first().v == pytest.approx(5.5)
    assert vertical.interp_depths(levels, ["p"], "z", "v", [0.0]).where("p = 2").first().v == pytest.approx(6.0)  # equal depths weigh alike


def test_bootstrap_interval_holds_the_estimate(spark):
    o = RNG.normal(size=400)
    rows = [(i, float(x), float(x + 0.5 + 0.2 * RNG.normal())) for i, x in enumerate(o)]
    found = {r.metric: r for r in statistics.bootstrap(spark.createDataFrame(rows, "id long, o double, m double"), "o", "m", "id", 100).collect()}
    assert found["bias"].lo < 0.5 < found["bias"].hi and found["bias"].hi - found["bias"].lo < 0.1 and found["rmse"].lo > 0.4


def test_weighted_metrics_far_from_zero(spark):
    rows = [(1e8 + x, 1e8 + x * 1.5, 1.0) for x in (0.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "o double, m double, w double")
    a, b = metrics.metrics(df, "o", "m").first(), metrics.metrics(df, "o", "m", weight="w").first()
    assert b.std_obs == pytest.approx(a.std_obs, abs=1e-5) and b.correlation == pytest.approx(1, abs=1e-5) and b.nse == pytest.approx(a.nse, abs=1e-5)


def test_ellipse_fit(spark):
    a, b, t = 2 + 1j, 0.5 - 0.3j, np.arange(50)
    z = a * np.exp(1j * t) + b * np.exp(-1j * t)
    rows = [("s", int(k), float(x.real), float(x.imag)) for k, x in enumerate(z)]
    r = statistics.ellipse_fit(spark.createDataFrame(rows, "s string, t int, u double, v double"), ["s"], ["t"], "u", "v").first()
    assert complex(r.a_re, r.a_im) == pytest.approx(a) and complex(r.b_re, r.b_im) == pytest.approx(b) and r.semi_major == pytest.approx(abs(a) + abs(b))


def test_units(spark):
    df = units.with_unit(spark.createDataFrame([("s", 1, 150.0), ("s", 2, 50.0)], "s string, t int, x double"), "x", "cm/s")
    assert [r.x for r in units.convert(df, "x", "m/s").orderBy("t").collect()] == [1.5, 0.5] and units.unit_of(units.scaled(df, "x", 2.0), "x") == "cm/s"
    other = units.convert(df, "x", "m/s")
    total = units.combine(df, other, ["s", "t"], "x")
    assert [r.x for r in total.orderBy("t").collect()] == [300.0, 100.0] and units.unit_of(total, "x") == "cm/s" and units.unit_of(units.strip_units(df, "x"), "x") is None
    with pytest.raises(ValueError):
        units.convert(df, "x", "degC")
    with pytest.raises(Exception, match="different times"):
        units.combine(df, other.where("t = 1"), ["s", "t"], "x", -1).collect()
    kelvin = units.convert(units.with_unit(df, "x", "degC"), "x", "K")
    assert kelvin.orderBy("t").first().x == pytest.approx(423.15)
    assert units.lookup("m s-1", "1") == "m/s" and units.lookup("furlong", "1") == "1"


def test_bands_and_sample(spark):
    low, high = scalars.frequency_band("inertial", 30.0)
    assert (low + high) / 2 == pytest.approx(1 / 23.93, rel=1e-3)
    with pytest.raises(ValueError):
        scalars.frequency_band("nothing")
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    once, again = (sorted(r.id for r in sequence.stratified_sample(df, ["g"], "id", 4, 1).collect()) for _ in range(2))
    assert once == again and len(once) == 12


def test_buoy_files(spark, tmp_path):
    (tmp_path / "42001h99.txt").write_text("YY MM DD hh WD WSPD WVHT\n99 01 02 03 120 5.5 99.0\n99 13 02 03 120 5.5 1.0\n05 01 02 03 999 6.5\n05 01 02 04 999 6.5 2.0\n")
    (tmp_path / "other.txt").write_text("#YY MM DD hh mm WDIR WSPD GST WVHT\n#yr mo dy hr mn degT m/s m/s m\n2020 01 02 03 30 100 7.0 9.0 1.5\n")
    stations = spark.createDataFrame([("42001", -89.6, 25.9)], "station string, lon double, lat double")
    rows = text.read_buoys(spark, f"file://{tmp_path}", stations).orderBy("ts").collect()
    assert [(r.station, r.ts, r.wdir, r.wspd, r.hs, r.lon) for r in rows] == [("42001", dt.datetime(1999, 1, 2, 3), 120.0, 5.5, None, -89.6), ("42001", dt.datetime(2005, 1, 2, 4), None, 6.5, 2.0, -89.6), ("other", dt.datetime(2020, 1, 2, 3, 30), 100.0, 7.0, 1.5, None)]


def test_float_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("float_id,time,lon,lat,pressure,temperature\nf1,2001-01-01T00:00:00,-90,25,100,9999\nf1,2001-01-02T00:00:00,99999,25,200,5\n")
    (tmp_path / "b.csv").write_text("lat\tlon\tid\n26\t-91\tf2\n")
    rows = text.read_floats(spark, f"file://{tmp_path}").orderBy("float_id", "time").collect()
    assert [(r.float_id, r.lon, r.pressure, r.temperature) for r in rows] == [("f1", -90.0, 100.0, 9999.0), ("f1", None, 200.0, 5.0), ("f2", -91.0, None, None)]
    assert text.read_floats(spark, f"file://{tmp_path}", bbox=(-92, 24, -89, 25.5)).count() == 1
    assert text.read_floats(spark, f"file://{tmp_path}", dates=("2001-01-02", "2001-01-03"), pressures=(150, 250)).count() == 1


def test_ragged_arrays_and_events(spark, tmp_path):
    lengths = spark.createDataFrame([(1, 3, "x"), (2, 0, "y"), (3, 5000, "z")], "traj int, n int, name string")
    samples = spark.range(5003).withColumnRenamed("id", "place")
    found = text.expand_ragged(lengths, samples, "traj", "n", "place").groupBy("name").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n"))
    assert {r.name: (r.a, r.b, r.n) for r in found.collect()} == {"x": (0, 2, 3), "z": (3, 5002, 5000)}
    with pytest.raises(ValueError):
        text.expand_ragged(lengths, samples.limit(10), "traj", "n", "place")
    text.write_events(spark.createDataFrame([(1, 0.1234567)], "id int, x double"), f"file://{tmp_path}/events")
    assert text.read_events(spark, f"file://{tmp_path}/events", "id int, x double").first().x == 0.123457
    flags = spark.createDataFrame([(1.0, "1"), (2.0, "4"), (3.0, "A"), (4.0, None)], "v double, q string")
    assert [r[0] for r in flags.select(text.quality_masked(flags.v, flags.q)).collect()] == [1.0, None, None, None]
