"""Bootstrap intervals, slopes and bands of spectra, radial bins, transports, polarization moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.scalars import ellipse_signal, finite, hermitian_eigenvalues
from halocline.operators.metrics import metrics


def bootstrap(df: DataFrame, obs: str, model: str, key: str, n_boot: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(key_, mean, lo, hi) of every metric over `n_boot` resamples of all pairs.

    Each pair enters a resample a Poisson(1) number of times, by a hash of its id, the resample and the seed: the usual stand-in
    for drawing n of n where rows lie on many machines, and the same at every run. Rows are counted, not copied."""
    rows = df.select(F.col(key).alias("id__"), finite(F.col(obs)).alias(obs), finite(F.col(model)).alias(model)).where(F.col(obs).isNotNull() & F.col(model).isNotNull())
    drawn = rows.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "boot", "id__"), F.lit(1 << 30)) / float(1 << 30)
    levels, at, chance = [], 0.0, 0.36787944117144233
    for k in range(12):
        at += chance
        chance /= k + 1
        levels.append(at)
    times = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= u))
    found = metrics(drawn.withColumn("times__", times.cast("double")).where("times__ > 0"), obs, model, ["boot"], weight="times__")
    names = [c for c in found.columns if c not in ("boot", "n")]
    long = found.select("boot", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in names])).alias("m")).select("m.*").where("x IS NOT NULL")
    ends = (1 - confidence) / 2
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(ends)).alias("lo"), F.percentile("x", F.lit(1 - ends)).alias("hi"))


def spectral_slope(df: DataFrame, by: list[str], k: str, power: str, band: tuple[float, float] | None = None) -> DataFrame:
    """(by, slope, n) of the line of least squares through log10 power over log10 k; NULL under three points."""
    rows = df.where((F.col(k) > 0) & (F.col(power) > 0))
    if band:
        rows = rows.where(F.col(k).between(*band))
    x, y = F.log10(k), F.log10(power)
    return rows.groupBy(*by).agg(F.when(F.count("*") >= 3, F.regr_slope(y, x)).alias("slope"), F.count("*").alias("n"))


def band_energy(df: DataFrame, by: list[str], freq: str, power: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(by, band, energy): power times the first frequency step, over [lo, hi]; 0 where a band has no frequency."""
    low = F.array_sort(F.collect_set(freq))
    step = F.get(low, F.lit(1)) - F.get(low, F.lit(0))
    sums = [F.coalesce(F.sum(F.when(F.col(freq).between(*edge), F.col(power))), F.lit(0.0)).alias(name) for name, edge in bands.items()]
    found = df.groupBy(*by).agg(step.alias("df__"), *sums)
    pairs = F.array(*[F.struct(F.lit(n).alias("band"), (F.col(n) * F.col("df__")).alias("energy")) for n in bands])
    return found.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*")


def radial_bins(df: DataFrame, by: list[str], kx: str, ky: str, value: str, top: float, bins: int) -> DataFrame:
    """(by, bin, k, n, mean) over rings [lo, hi) of width top / bins; what lies on or beyond the top is left out."""
    place = F.floor(F.sqrt(F.col(kx) * F.col(kx) + F.col(ky) * F.col(ky)) / (top / bins)).cast("int")
    found = df.withColumn("bin", place).where(F.col("bin") < bins).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return found.withColumn("k", (F.col("bin") + 0.5) * (top / bins))


def transport(df: DataFrame, time: str, velocity: str, cell_area: float) -> DataFrame:
    """Sverdrups by time; missing cells carry nothing."""
    return df.groupBy(time).agg((F.coalesce(F.sum(finite(F.col(velocity))), F.lit(0.0)) * cell_area / 1e6).alias("transport_sv"))


def ellipse_polarization(df: DataFrame, by: list[str], kappa: Column, lam: Column, theta: Column, phi: Column) -> DataFrame:
    """(by, p, alpha, beta, kbar, rbar) of the time-mean second moments of an ellipse's signal."""
    xr, xi, yr, yi = ellipse_signal(kappa, lam, theta, phi)
    rows = df.select(*by, xr.alias("xr"), xi.alias("xi"), yr.alias("yr"), yi.alias("yi"))
    m = rows.groupBy(*by).agg(F.expr("avg(xr * xr + xi * xi)").alias("sxx"), F.expr("avg(yr * yr + yi * yi)").alias("syy"), F.expr("avg(xr * yr + xi * yi)").alias("re"), F.expr("avg(xi * yr - xr * yi)").alias("im"))
    d1, d2 = hermitian_eigenvalues(F.col("sxx"), F.col("syy"), F.col("re"), F.col("im"))
    r1, r2 = hermitian_eigenvalues(F.col("sxx"), F.col("syy"), F.col("re"), F.lit(0.0))
    whole = F.nullif(F.col("sxx") + F.col("syy"), F.lit(0.0))
    return m.select(*by, ((d1 - d2) / whole).alias("p"), (2 * F.col("im") / whole).alias("alpha"), ((r1 - r2) / whole).alias("beta"), F.sqrt((r1 + r2) / 2).alias("kbar"), F.sqrt(F.sqrt(r1 * r2)).alias("rbar"))


def ellipse_fit(df: DataFrame, by: list[str], order: list[str], u: str, v: str) -> DataFrame:
    """(by, a_re, a_im, b_re, b_im, semi_major, semi_minor) of u + iv = a e^(it) + b e^(-it), t = 0, 1, ..., by least squares."""
    from pyspark.sql import Window

    t = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = df.select(*by, F.col(u).alias("u"), F.col(v).alias("v"), t.cast("double").alias("t"))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.expr("sum(cos(2 * t))").alias("c2"), F.expr("sum(sin(2 * t))").alias("s2"), F.expr("sum(u * cos(t) + v * sin(t))").alias("pr"), F.expr("sum(v * cos(t) - u * sin(t))").alias("pi"), F.expr("sum(u * cos(t) - v * sin(t))").alias("qr"), F.expr("sum(v * cos(t) + u * sin(t))").alias("qi"))
    det = F.expr("n * n - c2 * c2 - s2 * s2")
    # normal equations: n a + (c2 - i s2) b = p, (c2 + i s2) a + n b = q
    s = s.withColumn("det", F.when(det > 1e-10, det))
    s = s.select(*by, F.expr("(n * pr - (c2 * qr + s2 * qi)) / det").alias("a_re"), F.expr("(n * pi - (c2 * qi - s2 * qr)) / det").alias("a_im"), F.expr("(n * qr - (c2 * pr - s2 * pi)) / det").alias("b_re"), F.expr("(n * qi - (c2 * pi + s2 * pr)) / det").alias("b_im"))
    a, b = F.sqrt(F.expr("a_re * a_re + a_im * a_im")), F.sqrt(F.expr("b_re * b_re + b_im * b_im"))
    return s.withColumn("semi_major", a + b).withColumn("semi_minor", F.abs(a - b))


def local_peak(df: DataFrame, by: list[str], freq: str, power: str, near: float, width: float = 0.35) -> DataFrame:
    """(by, freq, power) of the strongest frequency within near (1 -+ width); ties go to the lower."""
    rows = df.where(F.col(freq).between(near * (1 - width), near * (1 + width)))
    return rows.groupBy(*by).agg(F.max(F.struct(F.col(power).alias("p"), (-F.col(freq)).alias("f"))).alias("m")).select(*by, (-F.col("m.f")).alias(freq), F.col("m.p").alias(power))
