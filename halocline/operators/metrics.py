"""Validation statistics as single-pass aggregations: sums of moments, shifted by a constant, are combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.scalars import finite, ratio, speed

NAMES = ("n", "bias", "mae", "rmse", "rmse_unbiased", "std_obs", "std_model", "correlation", "scatter_index", "skill_score", "nse")


def _mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def metrics(df: DataFrame, obs: str, model: str, by: list[str] | None = None, weight: str | None = None, prefix: str = "") -> DataFrame:
    """One row (a group): the eleven metrics over rows where both values are finite; all NULL with fewer than two.

    Moments are taken about the group's statistics by Spark's own variance and covariance, so large means lose nothing; with
    weights they are taken about the means of all rows."""
    by = by or []
    rows = df.select(*by, finite(F.col(obs)).alias("o"), finite(F.col(model)).alias("m"), (finite(F.col(weight)) if weight else F.lit(1.0)).alias("w"))
    rows = rows.withColumn("ok", F.col("o").isNotNull() & F.col("m").isNotNull() & F.col("w").isNotNull())
    rows = rows.select(*by, *[F.when(F.col("ok"), F.col(c)).alias(c) for c in "omw"])
    o, m, w = F.col("o"), F.col("m"), F.col("w")
    d = m - o
    if weight:
        # Sums of squares far from zero lose their digits: the values are taken about the means of all rows, a single row.
        centre = rows.agg(F.coalesce(F.avg("o"), F.lit(0.0)).alias("o0__"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("m0__"))
        rows = rows.crossJoin(F.broadcast(centre)).withColumn("d", d).withColumn("o", F.col("o") - F.col("o0__")).withColumn("m", F.col("m") - F.col("m0__"))
        d = F.col("d")
        base = rows.groupBy(*by).agg(F.count("o").alias("n"), _mean(d, w).alias("bias"), _mean(F.abs(d), w).alias("mae"), _mean(d * d, w).alias("mse"), _mean(o, w).alias("mo"), _mean(m, w).alias("mm"), _mean(o * o, w).alias("oo"), _mean(m * m, w).alias("m2"), _mean(o * m, w).alias("om"), F.sum(d * d).alias("sse"), F.sum(o * o).alias("so2"), F.sum(o).alias("so"))
        base = base.withColumn("vo", F.greatest(F.col("oo") - F.col("mo") ** 2, F.lit(0.0))).withColumn("vm", F.greatest(F.col("m2") - F.col("mm") ** 2, F.lit(0.0))).withColumn("cov", F.col("om") - F.col("mo") * F.col("mm")).withColumn("sst", F.col("so2") - 2 * F.col("mo") * F.col("so") + F.col("n") * F.col("mo") ** 2)
    else:
        base = rows.groupBy(*by).agg(F.count("o").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.var_pop("o").alias("vo"), F.var_pop("m").alias("vm"), F.covar_pop("o", "m").alias("cov"))
        base = base.withColumn("sse", F.col("mse") * F.col("n")).withColumn("sst", F.col("vo") * F.col("n"))
    unbiased = F.sqrt(F.greatest(F.col("mse") - F.col("bias") ** 2, F.lit(0.0)))
    made = {
        "n": F.col("n").cast("double"), "bias": F.col("bias"), "mae": F.col("mae"), "rmse": F.sqrt("mse"), "rmse_unbiased": unbiased, "std_obs": F.sqrt("vo"), "std_model": F.sqrt("vm"),
        "correlation": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("cov"), F.sqrt("vo") * F.sqrt("vm")))), "scatter_index": ratio(unbiased, F.sqrt("vo")), "skill_score": 1 - ratio(F.col("mse"), F.col("vo")), "nse": 1 - ratio(F.col("sse"), F.col("sst")),
    }
    # greatest and least pass over NULL, so an undefined correlation is masked again
    made["correlation"] = F.when((F.col("vo") > 0) & (F.col("vm") > 0), made["correlation"])
    return base.select(*by, *[F.when(F.col("n") >= 2, F.round(made[k], 6) if k != "n" else made[k]).alias(prefix + k) for k in NAMES])


def taylor_stats(df: DataFrame, obs: str, model: str, by: list[str] | None = None) -> DataFrame:
    names = {"std_obs": "std_ref", "std_model": "std_test", "correlation": "correlation", "rmse_unbiased": "rms_diff"}
    return metrics(df, obs, model, by).select(*(by or []), *[F.col(a).alias(b) for a, b in names.items()])


def _axes(p: str) -> dict[str, Column]:
    tr, det = F.col(f"{p}uu") + F.col(f"{p}vv"), F.col(f"{p}uu") * F.col(f"{p}vv") - F.col(f"{p}uv") ** 2
    disc = F.sqrt(F.greatest((tr / 2) ** 2 - det, F.lit(0.0)))
    degrees = 90 - F.degrees(F.atan2(2 * F.col(f"{p}uv"), F.col(f"{p}uu") - F.col(f"{p}vv")) / 2)
    return {"semi_major": F.sqrt(F.greatest(tr / 2 + disc, F.lit(0.0))), "semi_minor": F.sqrt(F.greatest(tr / 2 - disc, F.lit(0.0))), "inclination": degrees - 180 * F.floor(degrees / 180)}


def variance_ellipse(df: DataFrame, u: str, v: str, by: list[str] | None = None) -> DataFrame:
    """Axes, inclination and kinetic energies of finite (u, v) pairs, a row a group."""
    by = by or []
    both = finite(F.col(u)).isNotNull() & finite(F.col(v)).isNotNull()
    rows = df.select(*by, F.when(both, F.col(u)).alias("u"), F.when(both, F.col(v)).alias("v"))
    base = rows.groupBy(*by).agg(F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("uv"), (0.5 * (F.var_samp("u") + F.var_samp("v"))).alias("eke"), (0.5 * (F.avg("u") ** 2 + F.avg("v") ** 2)).alias("mke"))
    axes = _axes("")
    return base.select(*by, F.round(axes["semi_major"], 4).alias("semi_major"), F.round(axes["semi_minor"], 4).alias("semi_minor"), F.round(axes["inclination"], 2).alias("inclination"), F.round("eke", 6).alias("eke"), F.round("mke", 6).alias("mke"))


def current_ellipse_metrics(df: DataFrame, obs: tuple[str, str], model: tuple[str, str], by: list[str]) -> DataFrame:
    """Ellipses of both currents and the metrics of u, v and speed, over rows where all four are finite."""
    names = [*obs, *model]
    ok = F.lit(True)
    for c in names:
        ok = ok & finite(F.col(c)).isNotNull()
    rows = df.where(ok).select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip(names, ("ou", "ov", "mu", "mv"), strict=True)])
    rows = rows.withColumn("os", speed(F.col("ou"), F.col("ov"))).withColumn("ms", speed(F.col("mu"), F.col("mv")))
    out = None
    for p, (a, b) in {"obs": ("ou", "ov"), "mod": ("mu", "mv")}.items():
        e = variance_ellipse(rows, a, b, by).select(*by, *[F.col(c).alias(f"{p}_{c}") for c in ("semi_major", "semi_minor", "inclination", "eke", "mke")])
        out = e if out is None else out.join(e, by)
    for p, (a, b) in {"u": ("ou", "mu"), "v": ("ov", "mv"), "speed": ("os", "ms")}.items():
        out = out.join(metrics(rows, a, b, by).select(*by, F.col("rmse").alias(f"{p}_rmse"), F.col("bias").alias(f"{p}_bias"), F.col("correlation").alias(f"{p}_correlation")), by)
    return out


def series_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    x = finite(F.col(value))
    return df.groupBy(*by).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.round(F.var_samp(x), 6).alias("var"))


def validate(df: DataFrame, obs: str, model: str, by: list[str]) -> DataFrame:
    """(rmse, correlation, skill, bias) a series; skill refers to the sample variance of obs."""
    o, m = finite(F.col(obs)), finite(F.col(model))
    rows = df.select(*by, o.alias("o"), m.alias("m")).where("o IS NOT NULL AND m IS NOT NULL")
    d = F.col("m") - F.col("o")
    base = rows.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(d).alias("bias"), F.var_samp("o").alias("ref"), F.covar_pop("o", "m").alias("cov"), F.stddev_pop("o").alias("so"), F.stddev_pop("m").alias("sm"))
    return base.select(*by, F.round(F.sqrt("mse"), 6).alias("rmse"), F.round(ratio(F.col("cov"), F.col("so") * F.col("sm")), 6).alias("correlation"), F.round(1 - ratio(F.col("mse"), F.col("ref")), 6).alias("skill"), F.round("bias", 6).alias("bias"))


def density_ratio(df: DataFrame, n_data: int, n_noise: int, bins: int = 100, x_max: float = 20.0) -> DataFrame:
    """Survival counts of x by kind ('data', 'noise') over uniform bins, and the ratio of their rates; bins are few, rows many."""
    bin_of = F.least(F.floor(F.col("x") / x_max * bins), F.lit(bins - 1)).cast("int")
    counts = df.where((F.col("x") >= 0) & F.col("x").isNotNull()).withColumn("bin", bin_of).groupBy("bin").agg(F.sum((F.col("kind") == "data").cast("long")).alias("nd"), F.sum((F.col("kind") == "noise").cast("long")).alias("nn"))
    from pyspark.sql import Window

    w = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bin
    out = counts.select("bin", F.sum("nd").over(w).alias("data_above"), F.sum("nn").over(w).alias("noise_above"))
    return out.select("bin", "data_above", "noise_above", F.round(ratio(F.col("noise_above") / n_noise, F.col("data_above") / n_data), 6).alias("rho"))


def density_ratio_significance(df: DataFrame, n_data: float, n_noise: float, alpha: float = 4, delta_omega: float = 0.25, n_bands: int = 1000, n_bins: int = 2000, x_max: float = 20.0) -> DataFrame:
    """The data ridges of df (l, xi_bar, omega_bar, npoints, kind), with rho: the noise's ridge points a sample over the data's.

    Points are counted from the ridge's X = L |xi_bar|^alpha on, in the band nearest to its omega_bar; a ridge is in every
    band whose centre lies within delta_omega / 2. Infinite where no data is counted, NULL where X or omega_bar is undefined."""
    from pyspark.sql import Window

    is_data = F.col("kind") == "data"
    rows = df.withColumn("x", finite(F.col("l")) * F.pow(F.abs(finite(F.col("xi_bar"))), F.lit(float(alpha)))).withColumn("omega", finite(F.col("omega_bar"))).where(F.col("kind").isin("data", "noise"))
    valid = F.col("x").isNotNull() & F.col("omega").isNotNull()
    edges = rows.where(valid).agg((F.min("omega") - delta_omega).alias("low"), (F.max("omega") + delta_omega).alias("high"))
    step = (F.col("high") - F.col("low")) / (n_bands - 1) if n_bands > 1 else F.lit(1.0)
    rows = rows.crossJoin(F.broadcast(edges)).withColumn("step", step)  # one row
    at = lambda shift: (F.col("omega") + shift - F.col("low")) / F.col("step")
    clamped = lambda k, n: F.greatest(F.lit(0), F.least(k, F.lit(n - 1))).cast("int")
    rows = rows.withColumn("bin", F.when(valid, clamped(F.floor(F.col("x") / x_max * n_bins), n_bins)))
    rows = rows.withColumn("band", F.when(valid, clamped(F.rint(at(0)), n_bands)))
    rows = rows.withColumn("first", F.greatest(F.lit(0), F.ceil(at(-delta_omega / 2))).cast("int")).withColumn("last", F.least(F.lit(n_bands - 1), F.floor(at(delta_omega / 2))).cast("int"))
    # Ridges of the same bands and bin are summed before they are spread over the bands.
    points = finite(F.col("npoints"))
    spans = rows.where(valid & (F.col("first") <= F.col("last"))).groupBy("first", "last", "bin").agg(F.sum(F.when(is_data, points).otherwise(0.0)).alias("d"), F.sum(F.when(is_data, 0.0).otherwise(points)).alias("n"))
    cells = spans.select(F.explode(F.sequence("first", "last")).alias("band"), "bin", "d", "n")
    wanted = rows.where(is_data & valid).select("band", "bin", F.lit(0.0).alias("d"), F.lit(0.0).alias("n")).distinct()  # a cell for each that is asked for
    cells = cells.union(wanted).groupBy("band", "bin").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    w = Window.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n_bins rows at most
    above = cells.select("band", "bin", F.sum("d").over(w).alias("sd"), F.sum("n").over(w).alias("sn"))
    rho = F.when(F.col("sd") > 0, (F.col("sn") / n_noise) / (F.col("sd") / n_data)).when(F.col("band").isNotNull(), F.lit(float("inf")))
    return rows.where(is_data).join(above, ["band", "bin"], "left").withColumn("rho", rho).select(*df.columns, "rho")
