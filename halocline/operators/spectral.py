"""Spectral kernels of one series or field in numpy, and the grouped Arrow map that runs them for every series.

A kernel takes the samples of one series in order; series are groups, so a group must fit a task. Frequencies are in cycles
per unit of dt and positive; power is per cycle per unit.
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_series(df: DataFrame, key: str, order: list[str], columns: list[str], kernel, schema: str) -> DataFrame:
    """kernel(*columns in order) -> dict of arrays, for every series; schema is that of the arrays."""
    names, kind = [x.split()[0] for x in schema.split(", ")], df.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(order, kind="stable")
        found = pd.DataFrame(kernel(*(rows[c].to_numpy(float) for c in columns)), columns=names)
        found.insert(0, key, group[key].iloc[0])
        return found

    return df.select(key, *dict.fromkeys([*order, *columns])).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def detrended(x: np.ndarray, order: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residual, trend, coefficients from the highest power) of a polynomial over 1 .. n."""
    t = np.arange(1, len(x) + 1.0)
    powers = np.vander(t, order + 1)
    parts = [np.linalg.lstsq(powers, y, rcond=None)[0] for y in ((x.real, x.imag) if np.iscomplexobj(x) else (x,))]
    coefficients = parts[0] + 1j * parts[1] if len(parts) == 2 else parts[0]
    return x - powers @ coefficients, powers @ coefficients, coefficients


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))


def welch(x: np.ndarray, dx: float, segment: int = 256, linear: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(wavenumber > 0, power): means over half-overlapping segments, each detrended and under a symmetric Hann window."""
    n = min(len(x), segment)
    starts = np.arange(0, len(x) - n + 1, max(1, n // 2))
    window = hann(n)
    power = np.zeros(n // 2 + 1)
    for a in starts:
        part = x[a : a + n]
        part = detrended(part)[0] if linear else part - part.mean()
        power += np.abs(np.fft.rfft(part * window)) ** 2
    power = power * dx / (window**2).sum() / len(starts)
    power[1:-1] *= 2
    return np.linspace(0, 0.5 / dx, n // 2 + 1)[1:], power[1:]


@functools.lru_cache(maxsize=32)
def slepian_tapers(n: int, count: int, bandwidth: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(tapers as rows, their concentrations): eigenvectors of Slepian's tridiagonal matrix, of unit energy."""
    t = np.arange(n)
    main = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / n)
    off = t[1:] * (n - t[1:]) / 2
    low, high = main.min() - 2 * off.max(initial=0), main.max() + 2 * off.max(initial=0)

    def below(x: np.ndarray) -> np.ndarray:
        """How many eigenvalues are less than each x: sign changes of the Sturm sequence."""
        q, found = main[0] - x, (main[0] - x < 0).astype(int)
        for k in range(1, n):
            q = main[k] - x - off[k - 1] ** 2 / np.where(np.abs(q) < 1e-300, 1e-300, q)
            found = found + (q < 0)
        return found

    a, b, wanted = np.full(count, low), np.full(count, high), n - np.arange(count)
    for _ in range(70):
        middle = (a + b) / 2
        more = below(middle) >= wanted
        a, b = np.where(more, a, middle), np.where(more, middle, b)
    tapers = np.empty((count, n))
    for j, value in enumerate((a + b) / 2):
        v = np.random.default_rng(j).normal(size=n)
        for _ in range(4):
            v = _tridiagonal_solve(main - value + 1e-12 * (abs(value) + 1), off, v)
            v -= tapers[:j].T @ (tapers[:j] @ v)
            v /= np.linalg.norm(v)
        first = v.sum() if j % 2 == 0 else (v * (n - 1 - 2 * t)).sum()
        tapers[j] = v if first >= 0 else -v
    lag = np.arange(-(n - 1), n)
    kernel = 2 * bandwidth / n * np.sinc(2 * bandwidth / n * lag)
    size = 4 * n
    moved = np.fft.irfft(np.fft.rfft(tapers, size) * np.fft.rfft(kernel, size), size)[:, n - 1 : 2 * n - 1]
    return tapers, (moved * tapers).sum(1)


def _tridiagonal_solve(main: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
    c, d = np.empty(len(main)), np.empty(len(main))
    c[0], d[0] = (off[0] if len(off) else 0) / main[0], right[0] / main[0]
    for k in range(1, len(main)):
        whole = main[k] - off[k - 1] * c[k - 1]
        whole = whole if abs(whole) > 1e-300 else 1e-300
        c[k] = off[k] / whole if k < len(off) else 0
        d[k] = (right[k] - off[k - 1] * d[k - 1]) / whole
    for k in range(len(main) - 2, -1, -1):
        d[k] -= c[k] * d[k + 1]
    return d


def _tapered(x: np.ndarray, nw: float, count: int | None, linear: bool) -> tuple[np.ndarray, np.ndarray]:
    """(spectra of the tapered series as rows, the tapers)."""
    count = count or int(2 * np.floor(nw)) - 1
    tapers, _ = slepian_tapers(len(x), count, nw)
    x = detrended(x)[0] if linear else x - x.mean()
    return np.fft.fft(tapers * x), tapers


def multitaper(x: np.ndarray, dt: float, nw: float = 4.0, count: int | None = None, linear: bool = True) -> dict[str, np.ndarray]:
    """freq, power (adaptive weights), ftest_p, jackknife variance of the log power; one-sided."""
    n = len(x)
    spectra, tapers = _tapered(x, nw, count, linear)
    k = len(tapers)
    eigen = slepian_tapers(n, k, nw)[1]
    half = slice(1, n // 2 + 1)
    each = np.abs(spectra[:, half]) ** 2 * dt
    variance = (x - x.mean()).var() * dt
    power = each[:2].mean(0)
    for _ in range(20):  # Thomson's weights: what leaks in is taken to be white
        weight = (power / np.maximum(eigen[:, None] * power + (1 - eigen[:, None]) * variance, 1e-300)) ** 2 * eigen[:, None]
        power = (weight * each).sum(0) / np.maximum(weight.sum(0), 1e-300)
    alone = np.log(np.maximum((each.sum(0) - each) / (k - 1), 1e-300)) if k > 1 else np.zeros_like(each)
    scale = np.full(power.shape, 2.0)
    if n % 2 == 0:
        scale[-1] = 1
    return {"freq": np.fft.rfftfreq(n, dt)[half], "power": power * scale, "ftest_p": harmonic_p(spectra[:, half], tapers), "jackknife_var": (k - 1) / k * ((alone - alone.mean(0)) ** 2).sum(0)}


def harmonic_p(spectra: np.ndarray, tapers: np.ndarray) -> np.ndarray:
    """Thomson's test for a line at each frequency: the chance of so large an F without one."""
    sums, k = tapers.sum(1), len(tapers)
    line = (sums[:, None] * spectra).sum(0) / (sums**2).sum()
    rest = (np.abs(spectra - sums[:, None] * line) ** 2).sum(0)
    f = (k - 1) * np.abs(line) ** 2 * (sums**2).sum() / np.maximum(rest, 1e-300)
    return (1 + f / max(1, k - 1)) ** -(k - 1.0)


def _both_senses(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the frequencies k / n and -k / n, k = 1 .. n // 2."""
    k = np.arange(1, n // 2 + 1)
    return k, (n - k) % n


def log_jackknife(each: np.ndarray, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) around the mean over rows, from the spread of the logs with one row left out."""
    k, mean = len(each), each.mean(0)
    alone = np.log(np.maximum((each.sum(0) - each) / max(1, k - 1), 1e-300))
    wide = NormalDist().inv_cdf(0.5 + confidence / 2) * np.sqrt((k - 1) / k * ((alone - alone.mean(0)) ** 2).sum(0))
    return mean * np.exp(-wide), mean * np.exp(wide)


def rotary_spectrum(u: np.ndarray, v: np.ndarray, dt: float, nw: float = 4.0, count: int | None = None, linear: bool = True, confidence: float = 0.95) -> dict[str, np.ndarray]:
    """freq, s_ccw, s_cw with their intervals, rotary coefficient (ccw - cw) / (ccw + cw) and line tests of both senses."""
    spectra, tapers = _tapered(u + 1j * v, nw, count, linear)
    ccw, cw = _both_senses(len(u))
    each = np.abs(spectra) ** 2 * dt
    a, b = each[:, ccw], each[:, cw]
    p, q = a.mean(0), b.mean(0)
    (al, ah), (bl, bh) = log_jackknife(a, confidence), log_jackknife(b, confidence)
    return {"freq": ccw / (len(u) * dt), "s_ccw": p, "s_cw": q, "ci_ccw_lo": al, "ci_ccw_hi": ah, "ci_cw_lo": bl, "ci_cw_hi": bh, "rotary_coef": (p - q) / np.where(p + q > 0, p + q, np.nan), "f_ccw": harmonic_p(spectra[:, ccw], tapers), "f_cw": harmonic_p(spectra[:, cw], tapers)}


def _coherence(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cross = (a * b.conj()).mean(0)
    whole = (np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0)
    return np.abs(cross) ** 2 / np.where(whole > 0, whole, np.nan), np.angle(cross), cross


def rotary_coherence(u1, v1, u2, v2, dt: float, nw: float = 4.0, count: int | None = None, confidence: float = 0.95) -> dict[str, np.ndarray]:
    """freq, squared coherence and phase of each sense, and the level that independent series stay under."""
    a, tapers = _tapered(u1 + 1j * v1, nw, count, True)
    b, _ = _tapered(u2 + 1j * v2, nw, count, True)
    ccw, cw = _both_senses(len(u1))
    (cp, pp, _), (cm, pm, _) = _coherence(a[:, ccw], b[:, ccw]), _coherence(a[:, cw], b[:, cw])
    return {"freq": ccw / (len(u1) * dt), "coh_ccw": cp, "coh_cw": cm, "phase_ccw": pp, "phase_cw": pm, "sig_level": np.full(len(ccw), significance_level(len(tapers), confidence))}


def significance_level(k: int, confidence: float = 0.95) -> float:
    return 1 - (1 - confidence) ** (1 / max(1, k - 1))


def cross_coherence(x, y, dt: float, nw: float = 4.0, count: int | None = None, confidence: float = 0.95) -> dict[str, np.ndarray]:
    a, tapers = _tapered(x, nw, count, True)
    b, _ = _tapered(y, nw, count, True)
    half = slice(1, len(x) // 2 + 1)
    c, phase, cross = _coherence(a[:, half], b[:, half])
    return {"freq": np.fft.rfftfreq(len(x), dt)[half], "coherence": c, "phase": phase, "cross_re": cross.real * dt, "cross_im": cross.imag * dt, "sig_level": np.full(len(c), significance_level(len(tapers), confidence))}


def polarization(sxx, syy, sxy) -> dict[str, np.ndarray]:
    """Closed forms of a Hermitian 2 x 2 matrix: its eigenvalues, orientation, ellipticity and degrees of polarization."""
    trace, gap = sxx + syy, np.sqrt(np.maximum((sxx - syy) ** 2 + 4 * np.abs(sxy) ** 2, 0))
    alpha, beta = (sxx - syy) / trace, 2 * sxy / trace
    return {"d1": (trace + gap) / 2, "d2": (trace - gap) / 2, "theta": np.arctan2(beta.real, alpha) / 2, "nu": np.arctan2(beta.imag, np.hypot(alpha, beta.real)) / 2, "p": gap / trace, "alpha": alpha, "beta_re": beta.real, "beta_im": beta.imag}


def ellipse_polarization(u, v, dt: float, nw: float = 4.0, count: int | None = None) -> dict[str, np.ndarray]:
    a, _ = _tapered(u, nw, count, True)
    b, _ = _tapered(v, nw, count, True)
    half = slice(1, len(u) // 2 + 1)
    a, b = a[:, half], b[:, half]
    found = polarization((np.abs(a) ** 2).mean(0) * dt, (np.abs(b) ** 2).mean(0) * dt, (a * b.conj()).mean(0) * dt)
    return {"freq": np.fft.rfftfreq(len(u), dt)[half]} | found


def rotary_periodogram(u, v, dt: float) -> dict[str, np.ndarray]:
    power = np.abs(np.fft.fft(u + 1j * v - (u + 1j * v).mean())) ** 2 * dt / len(u)
    ccw, cw = _both_senses(len(u))
    return {"freq": ccw / (len(u) * dt), "s_ccw": power[ccw], "s_cw": power[cw]}


def band_filter(x: np.ndarray, dt: float, low: float = 0.0, high: float = np.inf) -> np.ndarray:
    """The parts with low <= |f| <= high."""
    f = np.abs(np.fft.fftfreq(len(x), dt))
    out = np.fft.ifft(np.where((f >= low) & (f <= high), np.fft.fft(x), 0))
    return out if np.iscomplexobj(x) else out.real


def hilbert(x: np.ndarray) -> np.ndarray:
    """The analytic signal; its real part is x."""
    n = len(x)
    step = np.zeros(n)
    step[0] = 1
    step[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        step[n // 2] = 1
    return x + 1j * np.fft.ifft(np.fft.fft(x) * step).imag


def noise_spectrum(u, v, dt: float, nw: float = 4.0) -> dict[str, np.ndarray]:
    """Two-sided power s of u + iv, and the isotropic s_iso = c min(s(f), s(-f)) of the same sum."""
    spectra, _ = _tapered(u + 1j * v, nw, None, False)
    s = (np.abs(spectra) ** 2).mean(0) * dt / len(u)
    both = np.minimum(s, s[(-np.arange(len(s))) % len(s)])
    return {"freq": np.fft.fftfreq(len(u), dt), "s": s, "s_iso": both * s.sum() / max(both.sum(), 1e-300)}


def noise_surrogate(u, v, dt: float, seed: int) -> np.ndarray:
    """A complex series of the isotropic spectrum with the mean of u + iv."""
    s, rng = noise_spectrum(u, v, dt)["s_iso"], np.random.default_rng(seed)
    z = (rng.normal(size=len(u)) + 1j * rng.normal(size=len(u))) / np.sqrt(2)
    return np.fft.ifft(np.sqrt(s / dt) * z) * len(u) + (u + 1j * v).mean()


def multivariate_svd(spectra: np.ndarray) -> dict[str, np.ndarray]:
    """Of (band, taper, channel): the two leading singular values of each band over sqrt(tapers * channels), and the trace."""
    scaled = spectra / np.sqrt(spectra.shape[1] * spectra.shape[2])
    d = np.linalg.svd(scaled, compute_uv=False)
    return {"d1": d[:, 0], "d2": d[:, 1] if d.shape[1] > 1 else np.zeros(len(d)), "trace": (d**2).sum(1)}


def isotropic_spectrum(field: np.ndarray, dx: float, dy: float, bins: int | None = None, other: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Radial means of the spectrum of a field (rows y) without its plane, under a Hann window; with another field the
    cross-spectrum's coherence and phase. Missing cells take the mean; the corner beyond the largest K is left out."""
    ny, nx = field.shape
    x, y = np.meshgrid(np.arange(nx), np.arange(ny))
    design, window = np.stack([np.ones(nx * ny), x.ravel(), y.ravel()], 1), np.outer(hann(ny), hann(nx))
    window = window / np.sqrt((window**2).mean())

    def transform(f: np.ndarray) -> np.ndarray:
        f = np.where(np.isfinite(f), f, np.nanmean(f)).ravel()
        return np.fft.fft2((f - design @ np.linalg.lstsq(design, f, rcond=None)[0]).reshape(ny, nx) * window)

    a = transform(field)
    b = a if other is None else transform(other)
    k = np.hypot(*np.meshgrid(np.fft.fftfreq(nx, dx), np.fft.fftfreq(ny, dy)))
    bins = bins or min(nx, ny) // 2
    edge = k.max() / bins
    at = np.floor(k / edge).astype(int).ravel()
    inside, scale = at < bins, dx * dy / (nx * ny)
    count = np.bincount(at[inside], minlength=bins)
    mean = lambda z: np.bincount(at[inside], z.ravel()[inside], bins) / np.where(count > 0, count, np.nan) * scale
    cross = a * b.conj()
    paa, pbb, pab = mean(np.abs(a) ** 2), mean(np.abs(b) ** 2), mean(cross.real) + 1j * mean(cross.imag)
    return {"k": (np.arange(bins) + 0.5) * edge, "p11": paa, "p22": pbb, "coherence": np.abs(pab) ** 2 / (paa * pbb), "phase": np.angle(pab), "p12": pab.real}
