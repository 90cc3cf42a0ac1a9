"""Scalar geometry as column expressions: angles, bins, voxels, rigid transforms, quaternions, map projection.

Everything here stays inside whole-stage code generation. A rigid transform is 12 columns or literals, row-major 3 x 4.
"""

from __future__ import annotations

from math import cos, pi, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def quadrant_angle(x: Column, y: Column, zero: float = 0.001) -> Column:
    """Angle in [0, 360); a coordinate of exactly 0 counts as `zero` (M1)."""
    x, y = (F.when(c == 0, F.lit(zero)).otherwise(c) for c in (x, y))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def polar_angle(x: Column, y: Column) -> Column:
    """Angle in [0, 2 pi)."""
    a = F.atan2(y, x)
    return F.when(a < 0, a + 2 * pi).otherwise(a)


def azimuth_polar_range(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(azimuth, elevation, range)."""
    return polar_angle(x, y), F.atan2(z, F.sqrt(x * x + y * y)), F.sqrt(x * x + y * y + z * z)


def ring_sector(x: Column, y: Column, rings: int, sectors: int, reach: float, ceil: bool = False) -> tuple[Column, Column]:
    """Polar bin of a point, counted from 0 and held inside the grid (M2). ceil: the other binning, shifted to 0 (Q12)."""
    r, a = F.sqrt(x * x + y * y), quadrant_angle(x, y)
    if ceil:
        bin_ = lambda v, n, top: F.greatest(F.least(F.ceil(v / top * n), F.lit(n)), F.lit(1)) - 1
    else:
        bin_ = lambda v, n, top: F.greatest(F.least(F.floor(v / (top / n)), F.lit(n - 1)), F.lit(0))
    return bin_(r, rings, reach).cast("int"), bin_(a, sectors, 360.0).cast("int")


def voxel(c: Column, size: float) -> Column:
    """Voxel index by floor, right for negatives (M3)."""
    return F.floor(c / size).cast("long")


def voxel_centre(index: Column, size: float) -> Column:
    return (index + 0.5) * size


def unprojected(rng: Column, elevation: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Polar to Cartesian (S13); angles in radians."""
    return rng * F.cos(elevation) * F.cos(azimuth), rng * F.cos(elevation) * F.sin(azimuth), rng * F.sin(elevation)


def transformed(x: Column, y: Column, z: Column, t: list) -> tuple[Column, Column, Column]:
    """R p + t with t the 12 numbers or columns of a 3 x 4 matrix (M4, M7)."""
    return tuple(x * t[4 * i] + y * t[4 * i + 1] + z * t[4 * i + 2] + t[4 * i + 3] for i in range(3))


def inverse_transformed(x: Column, y: Column, z: Column, t: list) -> tuple[Column, Column, Column]:
    """R^T (p - t) (M6)."""
    d = [x - t[3], y - t[7], z - t[11]]
    return tuple(d[0] * t[i] + d[1] * t[4 + i] + d[2] * t[8 + i] for i in range(3))


def composed(a: list, b: list) -> list:
    """The transform that applies b, then a (12 numbers or columns)."""
    out = []
    for i in range(3):
        for j in range(4):
            v = a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j]
            out.append(v + a[4 * i + 3] if j == 3 else v)
    return out


def inverse(t: list) -> list:
    rows = [[t[0], t[4], t[8]], [t[1], t[5], t[9]], [t[2], t[6], t[10]]]
    return [v for r in rows for v in (*r, -(r[0] * t[3] + r[1] * t[7] + r[2] * t[11]))]


def similarity_scaled(t: list, s) -> list:
    """The rotation block times s."""
    return [v * s if i % 4 < 3 else v for i, v in enumerate(t)]


def from_euler(x, y, z, roll, pitch, yaw, lib=None) -> list:
    """Z-Y-X Euler angles and a translation to a transform (M5); numbers, or columns with lib=F."""
    c, s = ((lib.cos, lib.sin) if lib else (cos, sin))
    cr, sr, cp, sp, cy, sy = c(roll), s(roll), c(pitch), s(pitch), c(yaw), s(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, x, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, y, -sp, cp * sr, cp * cr, z]


def to_euler(t: list) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw) of a transform of columns (M9, atan2 convention)."""
    return F.atan2(t[9], t[10]), F.asin(F.greatest(F.least(-t[8], F.lit(1.0)), F.lit(-1.0))), F.atan2(t[4], t[0])


def quaternion_euler(qx: Column, qy: Column, qz: Column, qw: Column) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw), pitch held at +-pi/2 (M8)."""
    s = 2 * (qw * qy - qz * qx)
    return (
        F.atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy)),
        F.when(F.abs(s) >= 1, F.signum(s) * (pi / 2)).otherwise(F.asin(s)),
        F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)),
    )


def quaternion_transform(x, y, z, qx, qy, qz, qw) -> list:
    return [
        1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw), x,
        2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw), y,
        2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy), z,
    ]


def axes_changed(t: list, g: list) -> list:
    """G R G^T with a fixed axis change g."""
    return composed(composed(g, t), inverse(g))


def to_scan_start(x: Column, y: Column, z: Column, share: Column, pose: list) -> tuple[Column, Column, Column]:
    """A point moved back by the share of the scan's motion that had passed (M26); pose = x, y, z, roll, pitch, yaw."""
    return inverse_transformed(x, y, z, from_euler(*(share * p for p in pose), lib=F))


#: WGS-84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> tuple[Column, Column, Column]:
    """Geodetic degrees to east, north, up about an origin."""
    e2 = WGS84_F * (2 - WGS84_F)
    p, l, p0, l0 = F.radians(lat), F.radians(lon), radians(lat0), radians(lon0)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    n0 = WGS84_A / sqrt(1 - e2 * sin(p0) ** 2)
    dx = (n + alt) * F.cos(p) * F.cos(l) - (n0 + alt0) * cos(p0) * cos(l0)
    dy = (n + alt) * F.cos(p) * F.sin(l) - (n0 + alt0) * cos(p0) * sin(l0)
    dz = (n * (1 - e2) + alt) * F.sin(p) - (n0 * (1 - e2) + alt0) * sin(p0)
    return (
        -sin(l0) * dx + cos(l0) * dy,
        -sin(p0) * cos(l0) * dx - sin(p0) * sin(l0) * dy + cos(p0) * dz,
        cos(p0) * cos(l0) * dx + cos(p0) * sin(l0) * dy + sin(p0) * dz,
    )


def slerp(a: list, b: list, share: Column) -> list:
    """Spherical interpolation of quaternions (x, y, z, w)."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    w = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    straight = F.sin(w) < 1e-9
    wa = F.when(straight, 1 - share).otherwise(F.sin((1 - share) * w) / F.sin(w))
    wb = F.when(straight, share).otherwise(F.sin(share * w) / F.sin(w)) * sign
    return [x * wa + y * wb for x, y in zip(a, b)]


