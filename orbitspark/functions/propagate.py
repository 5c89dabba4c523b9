"""Where an object stands in the sky: analytic propagation of mean elements, and the view from a point on the ground.

Objects with a period below 225 minutes go by the SGP4 model of Spacetrack Report No. 3 (drag, secular and periodic terms), on
many objects and times at once; slower ones by two-body motion with J2 drift, without the report's deep-space terms, which is
good to some tens of kilometres a day from the epoch. Numpy on Arrow batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .orbit import MU, RADIUS

J2, FLATTENING, TURN = 1.08262668e-3, 1 / 298.257223563, 2 * np.pi


#: The model's own gravity constants (WGS 72): sqrt(GM) in Earth radii and minutes, J2 / 2, -3 J4 / 8, -J3, Earth's radius in km, and the
#: density parameters s and (q - s)**4. Fixed values.
KE, K2, K4, A30, EARTH, S, QS4 = 0.0743669161, 5.413080e-4, 0.62098875e-6, 2.53881e-6, 6378.135, 1.01222928, 1.88027916e-9
#: From this period on, in minutes, an object is deep in space. Fixed value.
DEEP = 225.0
COLUMNS = ("norad_id", "epoch", "mean_motion", "eccentricity", "inclination", "ra_of_asc_node", "arg_of_pericenter", "mean_anomaly", "bstar")


def positions(e: pd.DataFrame, minutes: np.ndarray) -> np.ndarray:
    """Inertial km, (objects, times, 3). minutes: from each object's epoch, (objects, times). Without a bstar there is no drag."""
    near = (1440 / e["mean_motion"].to_numpy() < DEEP) & (e["eccentricity"].to_numpy() < 1)
    out = np.empty((*minutes.shape, 3))
    for mask, model in ((near, sgp4), (~near, two_body)):
        if mask.any():
            out[mask] = model(e[mask], minutes[mask])
    return out


def sgp4(e: pd.DataFrame, minutes: np.ndarray) -> np.ndarray:
    """Positions by the near-Earth model; lengths in Earth radii, times in minutes, until the end."""
    column = lambda c, unit: e[c].to_numpy(dtype=float)[:, None] * unit
    rad, t = np.pi / 180, minutes
    n0, e0, i0 = column("mean_motion", TURN / 1440), column("eccentricity", 1.0), column("inclination", rad)
    node0, arg0, mean0 = (column(c, rad) for c in ("ra_of_asc_node", "arg_of_pericenter", "mean_anomaly"))
    drag = np.nan_to_num(column("bstar", 1.0)) if "bstar" in e else np.zeros_like(n0)
    th, sin_i = np.cos(i0), np.sin(i0)
    b2 = 1 - e0**2
    # mean motion and axis without the model's own J2 term
    bulge = 1.5 * K2 * (3 * th**2 - 1) / b2**1.5
    a = (KE / n0) ** (2 / 3)
    d = bulge / a**2
    a = a * (1 - d / 3 - d**2 - 134 / 81 * d**3)
    d = bulge / a**2
    n, a = n0 / (1 + d), a / (1 - d)
    # the atmosphere's parameters follow a low perigee
    perigee = (a * (1 - e0) - 1) * EARTH
    low = np.where(perigee < 98, 20.0, perigee - 78)
    s = np.where(perigee < 156, low / EARTH + 1, S)
    qs4 = np.where(perigee < 156, ((120 - low) / EARTH) ** 4, QS4)
    xi = 1 / (a - s)
    eta = a * e0 * xi
    psi = np.abs(1 - eta**2)
    f = qs4 * xi**4 / psi**3.5
    c2 = f * n * (a * (1 + 1.5 * eta**2 + 4 * e0 * eta + e0 * eta**3) + 0.75 * K2 * xi / psi * (3 * th**2 - 1) * (8 + 24 * eta**2 + 3 * eta**4))
    c1 = drag * c2
    round_ = e0 < 1e-4  # terms divided by the eccentricity go
    safe = np.where(round_, 1.0, e0)
    c3 = np.where(round_, 0.0, qs4 * xi**5 * A30 * n * sin_i / (K2 * safe))
    c4 = 2 * n * f * a * b2 * (2 * eta * (1 + e0 * eta) + 0.5 * (e0 + eta**3) - 2 * K2 * xi / (a * psi) * (3 * (1 - 3 * th**2) * (1 + 1.5 * eta**2 - 2 * e0 * eta - 0.5 * e0 * eta**3) + 0.75 * (1 - th**2) * (2 * eta**2 - e0 * eta - e0 * eta**3) * np.cos(2 * arg0)))
    c5 = 2 * f * a * b2 * (1 + 2.75 * eta * (eta + e0) + e0 * eta**3)
    # secular rates of gravity
    p1, p2, p4 = 3 * K2 / (a**2 * b2**2), 3 * K2**2 / (16 * a**4 * b2**4), 1.25 * K4 / (a**4 * b2**4)
    mean = mean0 + n * t * (1 + 0.5 * p1 * np.sqrt(b2) * (3 * th**2 - 1) + p2 * np.sqrt(b2) * (13 - 78 * th**2 + 137 * th**4))
    arg = arg0 + n * t * (-0.5 * p1 * (1 - 5 * th**2) + p2 * (7 - 114 * th**2 + 395 * th**4) + p4 * (3 - 36 * th**2 + 49 * th**4))
    node = node0 + n * t * th * (-p1 + 8 * p2 * (4 - 19 * th**2) + 2 * p4 * (3 - 7 * th**2)) - 10.5 * n * K2 * th / (a**2 * b2) * c1 * t**2
    # secular drag; a perigee below 220 km leaves the first terms only
    full = perigee >= 220
    shift = np.where(full, drag * c3 * np.cos(arg0) * t, 0.0)
    by = np.where(full & ~round_, -2 / 3 * qs4 * drag * xi**4 / (safe * np.where(eta == 0, 1.0, eta)), 0.0)
    shift = shift + by * ((1 + eta * np.cos(mean)) ** 3 - (1 + eta * np.cos(mean0)) ** 3)
    mean, arg = mean + shift, arg - shift
    d2 = 4 * a * xi * c1**2
    d3 = d2 * xi * c1 / 3 * (17 * a + s)
    d4 = d2 * xi**2 * c1**2 / 6 * a * (221 * a + 31 * s)
    more = lambda x: np.where(full, x, 0.0)
    ecc = np.clip(e0 - drag * c4 * t - more(drag * c5 * (np.sin(mean) - np.sin(mean0))), 1e-6, 0.999999)
    axis = a * (1 - c1 * t - more(d2 * t**2 + d3 * t**3 + d4 * t**4)) ** 2
    long = mean + arg + node + n * (1.5 * c1 * t**2 + more((d2 + 2 * c1**2) * t**3 + 0.25 * (3 * d3 + 12 * c1 * d2 + 10 * c1**3) * t**4 + 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2**2 + 30 * c1**2 * d2 + 15 * c1**4) * t**5))
    # long-period terms
    k = A30 * sin_i / (4 * K2 * axis * (1 - ecc**2))
    ax, ay = ecc * np.cos(arg), ecc * np.sin(arg) + k
    u = np.mod(long + 0.5 * k * ax * (3 + 5 * th) / np.where(np.abs(1 + th) > 1.5e-12, 1 + th, 1.5e-12) - node, TURN)
    x = u.copy()
    for _ in range(12):  # Newton's rounds on Kepler's equation
        x = x + np.clip((u - ay * np.cos(x) + ax * np.sin(x) - x) / (1 - ay * np.sin(x) - ax * np.cos(x)), -0.95, 0.95)
    # short-period terms
    ec, es, el2 = ax * np.cos(x) + ay * np.sin(x), ax * np.sin(x) - ay * np.cos(x), ax**2 + ay**2
    root, p = np.sqrt(1 - el2), axis * (1 - el2)
    r = axis * (1 - ec)
    u = np.arctan2(axis / r * (np.sin(x) - ay - ax * es / (1 + root)), axis / r * (np.cos(x) - ax + ay * es / (1 + root)))
    r = r * (1 - 1.5 * K2 * root / p**2 * (3 * th**2 - 1)) + 0.5 * K2 / p * (1 - th**2) * np.cos(2 * u)
    turn, inc = node + 1.5 * K2 * th / p**2 * np.sin(2 * u), i0 + 1.5 * K2 * th / p**2 * sin_i * np.cos(2 * u)
    u = u - 0.25 * K2 / p**2 * (7 * th**2 - 1) * np.sin(2 * u)
    cn, sn, ci, cu, su = np.cos(turn), np.sin(turn), np.cos(inc), np.cos(u), np.sin(u)
    return EARTH * r[..., None] * np.stack([cn * cu - sn * ci * su, sn * cu + cn * ci * su, np.sin(inc) * su], -1)


def two_body(e: pd.DataFrame, minutes: np.ndarray) -> np.ndarray:
    """Positions by Kepler's motion with the secular drift that J2 causes."""
    rad = np.pi / 180
    n0, ecc, inc = e["mean_motion"].to_numpy() * TURN / 86400, e["eccentricity"].to_numpy(), e["inclination"].to_numpy() * rad
    node, arg, mean = (e[c].to_numpy() * rad for c in ("ra_of_asc_node", "arg_of_pericenter", "mean_anomaly"))
    a = (MU / n0**2) ** (1 / 3)
    k = 1.5 * J2 * (RADIUS / (a * (1 - ecc**2))) ** 2 * n0
    t = minutes * 60
    node = node[:, None] - (k * np.cos(inc))[:, None] * t
    arg = arg[:, None] + (k * (2 - 2.5 * np.sin(inc) ** 2))[:, None] * t
    m = np.mod(mean[:, None] + (n0 + k * np.sqrt(1 - ecc**2) * (1 - 1.5 * np.sin(inc) ** 2))[:, None] * t, TURN)
    ec = ecc[:, None]
    x = m + ec * np.sin(m)
    for _ in range(12):  # Newton's rounds on Kepler's equation
        x = x - (x - ec * np.sin(x) - m) / (1 - ec * np.cos(x))
    px, py = a[:, None] * (np.cos(x) - ec), a[:, None] * np.sqrt(1 - ec**2) * np.sin(x)
    cn, sn, ca, sa, ci, si = np.cos(node), np.sin(node), np.cos(arg), np.sin(arg), np.cos(inc)[:, None], np.sin(inc)[:, None]
    return np.stack([px * (cn * ca - sn * sa * ci) - py * (cn * sa + sn * ca * ci), px * (sn * ca + cn * sa * ci) - py * (sn * sa - cn * ca * ci), px * sa * si + py * ca * si], -1)


def sidereal(when: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time, radians; when: datetime64."""
    d = (when - np.datetime64("2000-01-01T12:00:00")) / np.timedelta64(1, "s") / 86400
    return np.mod(np.deg2rad(280.46061837 + 360.98564736629 * d), TURN)


def observer(lat: float, lon: float, alt_m: float) -> np.ndarray:
    """Earth-fixed km of a place on the ellipsoid."""
    p, q, e2 = np.deg2rad(lat), np.deg2rad(lon), FLATTENING * (2 - FLATTENING)
    n = RADIUS / np.sqrt(1 - e2 * np.sin(p) ** 2)
    h = alt_m / 1000
    return np.array([(n + h) * np.cos(p) * np.cos(q), (n + h) * np.cos(p) * np.sin(q), (n * (1 - e2) + h) * np.sin(p)])


def look(inertial: np.ndarray, when: np.ndarray, lat: float, lon: float, alt_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elevation and azimuth in degrees, range in km."""
    g = sidereal(when)
    c, s = np.cos(g), np.sin(g)
    fixed = np.stack([c * inertial[..., 0] + s * inertial[..., 1], -s * inertial[..., 0] + c * inertial[..., 1], inertial[..., 2]], -1)
    d = fixed - observer(lat, lon, alt_m)
    p, q = np.deg2rad(lat), np.deg2rad(lon)
    east = -np.sin(q) * d[..., 0] + np.cos(q) * d[..., 1]
    north = -np.sin(p) * np.cos(q) * d[..., 0] - np.sin(p) * np.sin(q) * d[..., 1] + np.cos(p) * d[..., 2]
    up = np.cos(p) * np.cos(q) * d[..., 0] + np.cos(p) * np.sin(q) * d[..., 1] + np.sin(p) * d[..., 2]
    dist = np.sqrt((d**2).sum(-1))
    return np.degrees(np.arcsin(up / dist)), np.mod(np.degrees(np.arctan2(east, north)), 360), dist


def _minutes(e: pd.DataFrame, when: np.ndarray) -> np.ndarray:
    return (when[None, :] - e["epoch"].to_numpy().astype("datetime64[us]")[:, None]) / np.timedelta64(1, "s") / 60


def visible_now(elements: DataFrame, now: dt.datetime, lat: float, lon: float, alt_m: float = 0.0, min_elevation: float = 10.0) -> DataFrame:
    """norad_id, elevation, azimuth, range_km, epoch of the latest elements' objects above min_elevation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        when = np.array([now], "datetime64[us]")
        for e in batches:
            el, az, dist = look(positions(e, _minutes(e, when)), when[None, :], lat, lon, alt_m)
            out = pd.DataFrame({"norad_id": e["norad_id"], "elevation": el[:, 0], "azimuth": az[:, 0], "range_km": dist[:, 0], "epoch": e["epoch"]})
            yield out[out["elevation"] >= min_elevation]

    cols = [c for c in COLUMNS if c in elements.columns]
    return elements.select(*cols).mapInPandas(run, f"norad_id long, elevation double, azimuth double, range_km double, epoch {dict(elements.dtypes)['epoch']}")


def passes(elements: DataFrame, start: dt.datetime, hours: float, lat: float, lon: float, alt_m: float = 0.0, min_elevation: float = 10.0, step_s: int = 30) -> DataFrame:
    """Rises, peaks and sets within the next hours: contiguous runs of a time grid above min_elevation. More than 72 hours raise, as the
    elements do not carry that far."""
    if hours > 72:
        raise ValueError("at most 72 hours ahead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        when = np.datetime64(start, "us") + np.arange(int(hours * 3600 / step_s) + 1) * np.timedelta64(step_s, "s")
        for batch in batches:
            for lo in range(0, len(batch), 64):
                e = batch.iloc[lo : lo + 64]
                el, az, _ = look(positions(e, _minutes(e, when)), when[None, :], lat, lon, alt_m)
                out = []
                for i, norad in enumerate(e["norad_id"]):
                    up = np.flatnonzero(np.diff(np.concatenate([[0], (el[i] >= min_elevation).astype(np.int8), [0]])))
                    for a, b in zip(up[::2], up[1::2], strict=True):
                        k = a + int(np.argmax(el[i, a:b]))
                        out.append((norad, when[a], az[i, a], when[k], el[i, k], az[i, k], when[b - 1], az[i, b - 1], float((b - 1 - a) * step_s)))
                yield pd.DataFrame(out, columns=["norad_id", "rise", "rise_azimuth", "peak", "peak_elevation", "peak_azimuth", "set", "set_azimuth", "duration_s"])

    cols = [c for c in COLUMNS if c in elements.columns]
    t = dict(elements.dtypes)["epoch"]
    return elements.select(*cols).mapInPandas(run, f"norad_id long, rise {t}, rise_azimuth double, peak {t}, peak_elevation double, peak_azimuth double, `set` {t}, set_azimuth double, duration_s double")
