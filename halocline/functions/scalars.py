"""Scalar functions on columns. Non-finite numbers count as missing and become NULL; results that are undefined are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the Earth's rotation rate (rad/s), its radius (km), metres of sea water in a decibar
OMEGA, EARTH_KM, METRES_PER_DBAR = 7.2921e-5, 6371.0, 1.019716


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def pressure_to_depth(pressure: Column, latitude: Column | None = None) -> Column:
    """Metres; with a latitude by UNESCO 1983, else by a constant factor."""
    p = finite(pressure)
    if latitude is None:
        return p * METRES_PER_DBAR
    x = F.pow(F.sin(F.radians(finite(latitude))), F.lit(2.0))
    gravity = 9.780318 * (1 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * p
    return (((-1.82e-15 * p + 2.279e-10) * p - 2.2512e-5) * p + 9.72659) * p / gravity


def inertial_frequency(latitude: Column) -> Column:
    """|f| in cycles per hour."""
    return F.abs(2 * OMEGA * F.sin(F.radians(finite(latitude)))) * 3600 / (2 * F.pi())


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(finite(u) * finite(u) + finite(v) * finite(v))


def _turn(degrees: Column) -> Column:
    """Into [0, 360); an angle too little below 0 to be told from 360 is 0."""
    turned = degrees - 360 * F.floor(degrees / 360)
    return F.when(turned >= 360, 0.0).otherwise(turned)


def _bearing(east: Column, north: Column) -> Column:
    """In [0, 360). F.atan2 takes -0.0 for 0.0, so the zero vector's angle is set apart, as in IEEE 754: 180 if north is -0.0, else 0."""
    still = F.when(F.pow(north, F.lit(-1.0)) < 0, 180.0).otherwise(0.0)
    return F.when((east == 0) & (north == 0), still).otherwise(_turn(F.degrees(F.atan2(east, north))))


def direction_towards(u: Column, v: Column) -> Column:
    """Degrees clockwise from north that the current flows to."""
    return _bearing(finite(u), finite(v))


def direction_from(u: Column, v: Column) -> Column:
    """Degrees clockwise from north that the wind comes from."""
    return _bearing(-finite(u), -finite(v))


def knockdown(speed: Column, k: float, length: float | None) -> tuple[Column, Column, Column]:
    """(theta, vertical drop, horizontal excursion) of a mooring line whose angle has tangent k U^2."""
    theta = F.atan(F.lit(k) * speed * speed)
    if k == 0 or length is None:
        return theta, F.lit(0.0), F.lit(0.0)
    return theta, length * (1 - F.cos(theta)), length * F.sin(theta)


def size_regime(radius: Column) -> Column:
    return F.when(radius < 10, "small").when(radius < 50, "mesoscale").when(radius >= 50, "large")


def depth_to_pressure(depth: Column, latitude: Column | None = None) -> Column:
    """Decibars; with a latitude by ten Newton steps on `pressure_to_depth`."""
    d = finite(depth)
    if latitude is None:
        return d / METRES_PER_DBAR

    def step(p: Column, _: Column) -> Column:
        here = pressure_to_depth(p, latitude)
        return p - (here - d) * 1e-4 / (pressure_to_depth(p + 1e-4, latitude) - here)

    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), d / METRES_PER_DBAR, step)


def sound_speed(temperature: Column, salinity: Column, pressure: Column) -> Column:
    """Metres a second, by the nine-term polynomial in degrees C, PSU and dbar."""
    t, s, p = finite(temperature), finite(salinity), finite(pressure)
    return 1449.2 + ((0.00029 * t - 0.055) * t + 4.6) * t + (1.34 - 0.01 * t) * (s - 35) + 0.016 * p


# fixed values: named bands in cycles per hour
BANDS = {"subtidal": (0.0, 1 / 36), "diurnal": (1 / 28, 1 / 20), "semidiurnal": (1 / 14, 1 / 11), "supertidal": (1 / 6, 0.5), "mesoscale": (1 / 720, 1 / 48), "submesoscale": (1 / 48, 1 / 6)}


def frequency_band(name: str, latitude: float = 25.0, width: float = 0.2) -> tuple[float, float]:
    """A named band in cycles per hour; the inertial one lies around |f| at the latitude."""
    if name == "inertial":
        f = 2 * OMEGA * abs(math.sin(math.radians(latitude))) * 3600 / (2 * math.pi)
        return f * (1 - width), f * (1 + width)
    if name not in BANDS:
        raise ValueError(f"unknown band {name}; there are {', '.join(BANDS)}")
    return BANDS[name]


def parabola_vertex(t: tuple[Column, Column, Column], x: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """(place, value) of the vertex of the parabola through three points; NULL where they lie on a line."""
    d1, d2 = ratio(x[1] - x[0], t[1] - t[0]), ratio(x[2] - x[1], t[2] - t[1])
    a = ratio(d2 - d1, t[2] - t[0])
    b = d1 - a * (t[0] + t[1])
    c = x[0] - a * t[0] * t[0] - b * t[0]
    at = ratio(-b, 2 * a)
    return at, c + b * at / 2


def parabola_value(t: tuple[Column, Column, Column], x: tuple[Column, Column, Column], at: Column) -> Column:
    """The parabola through three points at another place."""
    d1, d2 = ratio(x[1] - x[0], t[1] - t[0]), ratio(x[2] - x[1], t[2] - t[1])
    return x[0] + (at - t[0]) * (d1 + (at - t[1]) * ratio(d2 - d1, t[2] - t[0]))


def ellipse_signal(kappa: Column, lam: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column, Column]:
    """(Re x, Im x, Re y, Im y) of the analytic signal of an ellipse with RMS axis kappa and linearity lam."""
    a, b = kappa * F.sqrt(1 + F.abs(lam)), F.when(lam < 0, -1).otherwise(1) * kappa * F.sqrt(1 - F.abs(lam))
    c, s, cp, sp = F.cos(theta), F.sin(theta), F.cos(phi), F.sin(phi)
    return a * c * cp - b * s * sp, a * c * sp + b * s * cp, a * s * cp + b * c * sp, a * s * sp - b * c * cp


def hermitian_eigenvalues(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of [[a, c + i d], [c - i d, b]], the larger first; not below 0."""
    half, gap = (a + b) / 2, F.sqrt(F.greatest((a - b) * (a - b) / 4 + c * c + d * d, F.lit(0.0)))
    return F.greatest(half + gap, F.lit(0.0)), F.greatest(half - gap, F.lit(0.0))


def sphere_position(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in radians of a point on a sphere around the origin."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.asin(F.greatest(F.least(ratio(z, r), F.lit(1.0)), F.lit(-1.0))), F.atan2(y, x)


def datenum_to_timestamp(days: Column) -> Column:
    """A timestamp without zone from days since the year 0, to the millisecond."""
    millis = F.round((finite(days) - 719529) * 86_400_000).cast("long")
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def effective_frequency(f0: Column, vorticity: Column) -> Column:
    """Kunze's shift as a signed difference."""
    return finite(f0) - finite(vorticity)
