"""Shortest distances on the WGS84 ellipsoid, vectorised.

The longitude on the auxiliary sphere is iterated as Vincenty does, with his series replaced by Gauss
quadrature of the exact integrals. Where that doesn't settle (nearly antipodal points) the azimuth at one
point is bisected until its geodesic comes to the other's longitude.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
ROUNDS = 60
NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(24)


def _along(sin_alpha0: np.ndarray, sigma1: np.ndarray, sigma2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(metres, what the longitude lacks to the angle on the sphere) of a geodesic between two arcs from its node, by quadrature."""
    half, middle = (sigma2 - sigma1) / 2, (sigma2 + sigma1) / 2
    k2 = (A * A - B * B) / (B * B) * (1 - sin_alpha0**2)
    root = np.sqrt(1 + k2[:, None] * np.sin(half[:, None] * NODES + middle[:, None]) ** 2)
    metres = B * half * (root @ NODE_WEIGHTS)
    lack = FLATTENING * sin_alpha0 * half * (((2 - FLATTENING) / (1 + (1 - FLATTENING) * root)) @ NODE_WEIGHTS)
    return metres, lack


def inverse_metres(lon0, lat0, lon1, lat1) -> np.ndarray:
    """Metres between pairs of points in degrees; NaN where a coordinate isn't a number in its range."""
    lon0, lat0, lon1, lat1 = (np.atleast_1d(np.asarray(v, float)) for v in (lon0, lat0, lon1, lat1))
    with np.errstate(all="ignore"):
        good = np.isfinite(lon0 + lat0 + lon1 + lat1) & (np.abs(lat0) <= 90) & (np.abs(lat1) <= 90)
        wide = np.radians(np.where(good, np.abs(np.remainder(lon1 - lon0 + 180, 360) - 180), 0))
        u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(np.where(good, v, 0)))) for v in (lat0, lat1))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam, settled, out = wide.copy(), np.zeros(len(wide), bool), np.zeros(len(wide))
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            east, north = c2 * sl, c1 * s2 - s1 * c2 * cl
            ss = np.hypot(east, north)
            sigma = np.arctan2(ss, s1 * s2 + c1 * c2 * cl)
            sa = np.where(ss > 0, c1 * east / np.where(ss > 0, ss, 1), 0)
            sigma1 = np.arctan2(s1, np.where(ss > 0, c1 * north / np.where(ss > 0, ss, 1), c1))
            metres, lack = _along(np.clip(sa, -1, 1), sigma1, sigma1 + sigma)
            after = wide + lack
            fresh = (np.abs(after - lam) < 1e-14) & ~settled
            out[fresh] = metres[fresh]
            settled |= fresh
            if settled.all():
                break
            lam = np.where(settled, lam, np.minimum(after, 2 * np.pi))
        far = np.flatnonzero((~settled | (lam > np.pi)) & good)
        if len(far):
            out[far] = _nearly_antipodal(u1[far], u2[far], wide[far])
    return np.where(good, out, np.nan)


def _nearly_antipodal(u1: np.ndarray, u2: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The azimuth at the point of the greater latitude, turned to the south, whose geodesic comes to that longitude; its length."""
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    u2 = np.where(u1 > 0, -u2, u2)
    s1, c1, s2, c2 = -np.abs(np.sin(u1)), np.cos(u1), np.sin(u2), np.cos(u2)
    low, high = np.zeros(len(u1)), np.full(len(u1), np.pi)
    metres = np.zeros(len(u1))
    for _ in range(80):
        azimuth = (low + high) / 2
        sa, ca = np.sin(azimuth) * c1, np.cos(azimuth)
        sigma1 = np.arctan2(s1, ca * c1)
        sigma2 = np.arctan2(s2, np.sqrt(np.maximum(0, (ca * c1) ** 2 + c2**2 - c1**2)))
        metres, lack = _along(sa, sigma1, sigma2)
        turn = np.arctan2(sa * np.sin(sigma2), np.cos(sigma2)) - np.arctan2(sa * np.sin(sigma1), np.cos(sigma1)) - lack
        high, low = np.where(turn > wide, azimuth, high), np.where(turn > wide, low, azimuth)
    return metres


def geodesic_metres(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Null where an argument is null or out of range."""

    def metres(*sides: pa.Array) -> pa.Array:
        found = inverse_metres(*(side.to_numpy(zero_copy_only=False) for side in sides))
        return pa.array(found, mask=~np.isfinite(found))

    return F.arrow_udf(metres, "double")(lon0, lat0, lon1, lat1)
