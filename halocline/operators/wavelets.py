"""Generalised Morse wavelets: transforms, ridges and moments of one series in numpy.

Frequencies are in radians per sample, descending. A transform is (sample, frequency).
"""

from __future__ import annotations

import functools
import math

import numpy as np


def peak_frequency(gamma: float, beta: float) -> float:
    return (beta / gamma) ** (1 / gamma) if beta else math.log(2) ** (1 / gamma)


def duration(gamma: float, beta: float) -> float:
    return math.sqrt(beta * gamma)


def properties(gamma: float, beta: float) -> tuple[float, float, float]:
    """(duration P, skewness, kurtosis) of the wavelet's demodulate."""
    p = duration(gamma, beta)
    return p, (gamma - 3) / p, 3 - ((gamma - 3) / p) ** 2 - 2 / p**2


def amplitude(gamma: float, beta: float, norm: str = "bandpass") -> float:
    """The factor that makes the peak (bandpass) or the energy one."""
    if norm == "energy":
        r = (2 * beta + 1) / gamma
        return math.exp(0.5 * (math.log(2 * math.pi * gamma) + r * math.log(2) - math.lgamma(r)))
    return (gamma * math.e / beta) ** (beta / gamma) if beta else 1.0


def log_shape(omega: np.ndarray, gamma: float, beta: float) -> np.ndarray:
    """log of omega^beta exp(-omega^gamma)."""
    with np.errstate(divide="ignore"):
        return beta * np.log(omega) - omega**gamma


def highest(gamma: float, beta: float, eta: float) -> float:
    """The first of 10,000 frequencies in [0.01, pi] whose wavelet at Nyquist is at least eta of its peak."""
    peak = peak_frequency(gamma, beta)
    trial = np.linspace(0.01, np.pi, 10_000)
    enough = log_shape(np.pi * peak / trial, gamma, beta) >= log_shape(np.array(peak), gamma, beta) + math.log(eta)
    return float(trial[np.argmax(enough)]) if enough.any() else math.pi


def frequency_grid(gamma: float, beta: float, n: int, density: int = 4, eta: float = 0.1, widths: float = 5.0, high: float | None = None, low: float | None = None) -> np.ndarray:
    """Descending, with the ratio 1 + 1 / (density P); the lowest has `widths` wavelets in n samples."""
    p = duration(gamma, beta)
    top = min(high if high is not None else highest(gamma, beta, eta), math.pi)
    bottom = max(low if low is not None else 2 * math.sqrt(2) * p * widths / n, 2 * math.pi / n)
    if bottom >= top:
        return np.array([top])
    ratio = 1 + 1 / (density * p)
    return top / ratio ** np.arange(max(1, int(math.log(top / bottom) / math.log(ratio))) + 1)


@functools.lru_cache(maxsize=16)
def _bank(n: int, gamma: float, beta: float, grid: tuple[float, ...], norm: str) -> np.ndarray:
    fact = np.array(grid)[None, :] / peak_frequency(gamma, beta)
    omega = 2 * np.pi * np.arange(n)[:, None] / n / fact
    out = np.where(omega > 0, amplitude(gamma, beta, norm) * np.exp(log_shape(np.maximum(omega, 1e-300), gamma, beta)), 0.0)
    out[0] *= 0.5
    return out * np.sqrt(1 / fact) if norm == "energy" else out


def filter_bank(n: int, gamma: float, beta: float, grid: np.ndarray, norm: str = "bandpass") -> np.ndarray:
    """(frequency of the FFT, wavelet)."""
    return _bank(n, gamma, beta, tuple(np.asarray(grid, float)), norm)


def transform(x: np.ndarray, grid: np.ndarray, gamma: float = 3.0, beta: float = 8.0, boundary: str = "zeros", detrend: bool = True, norm: str = "bandpass") -> np.ndarray:
    """(sample, frequency); a real series counts twice, as its negative frequencies are left out."""
    n = len(x)
    if detrend:
        t = np.arange(n) - (n - 1) / 2
        x = x - x.mean() - t * (t * x).sum() / max((t**2).sum(), 1e-300)
    padded = np.concatenate([x[::-1], x, x[::-1]]) if boundary == "mirror" else np.concatenate([x, np.zeros(2 ** math.ceil(math.log2(max(2, 2 * n - 1))) - n)])
    first = n if boundary == "mirror" else 0
    w = np.fft.ifft(np.fft.fft(padded)[:, None] * filter_bank(len(padded), gamma, beta, grid, norm), axis=0)[first : first + n]
    return w if np.iscomplexobj(x) else 2 * w


def rotary_transform(u: np.ndarray, v: np.ndarray, grid: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray]:
    """(counterclockwise, clockwise)."""
    w = (u + 1j * v) / math.sqrt(2)
    return transform(w, grid, **options), transform(w.conj(), grid, **options)


def central_difference(x: np.ndarray, dt: float = 1.0) -> np.ndarray:
    """Along the first axis, one-sided at the ends; 0 for one sample."""
    return np.gradient(x, dt, axis=0) if len(x) > 1 else np.zeros(x.shape)


def instantaneous_frequency(w: np.ndarray, dt: float = 1.0) -> np.ndarray:
    return central_difference(np.unwrap(np.angle(w), axis=0), dt)


def decoded(w: np.ndarray, kind: str, dt: float = 1.0) -> np.ndarray:
    """amp, phase, freq, bandwidth or curvature of a transform."""
    if kind == "amp":
        return np.abs(w)
    if kind == "phase":
        return np.angle(w)
    if kind == "freq":
        return instantaneous_frequency(w, dt)
    rate = central_difference(np.abs(w), dt)
    if kind == "bandwidth":
        return rate / np.maximum(np.abs(w), 1e-300)
    if kind == "curvature":
        return central_difference(rate, dt) / np.maximum(np.abs(w), 1e-300)
    raise ValueError(f"unknown kind {kind}")


def ridge_map(w: np.ndarray, grid: np.ndarray, least: float = 0.0) -> dict[str, np.ndarray]:
    """For every sample the strongest local maximum over frequency, ends included: its place (1-based; 0: none), frequency and amplitude."""
    a = np.abs(w)
    edge = np.full((len(a), 1), -1.0)
    top = (a >= np.concatenate([edge, a[:, :-1]], 1)) & (a >= np.concatenate([a[:, 1:], edge], 1)) & (a > least)
    at = np.where(top, a, -1).argmax(1)
    some = top.any(1)
    rows = np.arange(len(a))
    return {"place": np.where(some, at + 1, 0), "freq": np.where(some, np.asarray(grid)[at], np.nan), "amp": np.where(some, a[rows, at], np.nan)}


def moments(*channels: np.ndarray, dt: float = 1.0) -> dict[str, np.ndarray]:
    """Joint amplitude, frequency and bandwidth of analytic signals: power-weighted means over the channels."""
    x = np.stack(channels)
    power = np.abs(x) ** 2
    whole = np.maximum(power.sum(0), 1e-300)
    omega = np.stack([instantaneous_frequency(c, dt) for c in x])
    upsilon = np.stack([decoded(c, "bandwidth", dt) for c in x])
    joint = (power * omega).sum(0) / whole
    return {"amp": np.sqrt(power.mean(0)), "freq": joint, "bandwidth": np.sqrt((power * (upsilon**2 + (omega - joint) ** 2)).sum(0) / whole)}


def ridges(w: np.ndarray, grid: np.ndarray, least: float = 0.0, jump: float = 0.25, cycles: float = 1.5) -> list[dict]:
    """Chains of maxima over frequency that are each other's nearest at adjacent samples, from `cycles` cycles on.

    A link may change the logarithm of the frequency by `jump` at most; ties go to the chain that began first."""
    a, grid = np.abs(w), np.asarray(grid, float)
    open_, done = [], []
    for t in range(len(a)):
        inner = np.flatnonzero((a[t, 1:-1] > a[t, :-2]) & (a[t, 1:-1] >= a[t, 2:]) & (a[t, 1:-1] > least)) + 1
        gap = np.abs(np.log(grid[inner])[:, None] - np.log([grid[c["place"][-1]] for c in open_])[None, :]) if open_ and len(inner) else np.zeros((len(inner), len(open_)))
        linked = {}
        if gap.size:
            forward, back = gap.argmin(0), gap.argmin(1)
            linked = {int(forward[c]): c for c in range(len(open_)) if back[forward[c]] == c and gap[forward[c], c] <= jump}
        kept = []
        for i, p in enumerate(inner):
            chain = open_[linked[i]] if i in linked else {"start": t + 1, "place": [], "amp": []}
            chain["place"].append(int(p))
            chain["amp"].append(float(a[t, p]))
            kept.append(chain)
        ended = set(range(len(open_))) - set(linked.values())
        done += [open_[c] for c in sorted(ended)]
        open_ = sorted(kept, key=lambda c: c["start"])
    found = []
    for chain in done + open_:
        omega, amp = grid[chain["place"]], np.array(chain["amp"])
        length = omega.sum() / (2 * np.pi)
        if length >= cycles:
            found.append({"start": chain["start"], "stop": chain["start"] + len(amp) - 1, "npoints": len(amp), "l": length, "omega": (amp**2 * omega).sum() / (amp**2).sum(), "kappa": math.sqrt((amp**2).mean())})
    return sorted(found, key=lambda r: (r["start"], -r["omega"]))


def rotary_ridges(u: np.ndarray, v: np.ndarray, grid: np.ndarray, **options) -> dict[str, np.ndarray]:
    """A row a ridge of either sense: start, stop (1-based), npoints, length in cycles, frequency, amplitude, sense (1: counterclockwise), power-weighted circularity."""
    both = rotary_transform(u, v, grid)
    rows = []
    for sense, w, other in ((1, *both), (-1, *both[::-1])):
        for r in ridges(w, grid, **options):
            at = np.abs(np.asarray(grid) - r["omega"]).argmin()
            p, q = (np.abs(x[r["start"] - 1 : r["stop"], at]) ** 2 for x in (w, other))
            rows.append((r["start"], r["stop"], r["npoints"], r["l"], r["omega"], r["kappa"], sense, sense * float((p - q).sum() / max((p + q).sum(), 1e-300))))
    return dict(zip(("start", "stop", "npoints", "l", "omega", "kappa", "sense", "xi_bar"), map(list, zip(*sorted(rows), strict=True)), strict=True)) if rows else {n: [] for n in ("start", "stop", "npoints", "l", "omega", "kappa", "sense", "xi_bar")}


def significance(x: np.ndarray, grid: np.ndarray, confidence: float = 0.95, surrogates: int = 100, background: str = "red", seed: int = 0) -> np.ndarray:
    """For each frequency the quantile, over surrogates, of the largest power in time; red: an AR(1) of the series' own."""
    x = x - x.mean()
    alpha = float(np.clip((x[1:] * x[:-1]).sum() / max((x**2).sum(), 1e-300), 0, 0.95)) if background == "red" else 0.0
    noise = np.random.default_rng(seed).normal(size=(surrogates, len(x)))
    for t in range(1, len(x)):
        noise[:, t] = alpha * noise[:, t - 1] + math.sqrt(1 - alpha**2) * noise[:, t]
    noise *= x.std()
    return np.quantile([(np.abs(transform(s, grid)) ** 2).max(0) for s in noise], confidence, axis=0)


def significant(freq: np.ndarray, amp: np.ndarray, level: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Whether a ridge's power passes the level of the nearest frequency; missing: no."""
    at = np.abs(np.asarray(grid)[None, :] - np.where(np.isfinite(freq), freq, 0)[:, None]).argmin(1)
    return np.isfinite(freq) & np.isfinite(amp) & (amp**2 > level[at])
