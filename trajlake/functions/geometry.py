"""Projection to pixels, bearings and walls as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.clock import _c


def _row_times_matrix(x: Column, y: Column, z: Column, m: Sequence[Sequence[float]]) -> list[Column]:
    """Point as row vector times a 4x4 matrix, divided by the fourth component."""
    out = [
        x * F.lit(m[0][j]) + y * F.lit(m[1][j]) + z * F.lit(m[2][j]) + F.lit(m[3][j])
        for j in range(4)
    ]
    w = F.when(out[3] == 0.0, F.lit(1.0)).otherwise(out[3])
    return [out[0] / w, out[1] / w, out[2] / w]


def view_point(view: Sequence[Sequence[float]], x="x", y="y", z="z") -> list[Column]:
    return _row_times_matrix(_c(x), _c(y), _c(z), view)


def pixel(view_xyz: list[Column], proj, width: int, height: int, scale: float = 1.0) -> list[Column]:
    """Whole pixel of a view-space point, optionally moved radially from the image centre."""
    cx, cy, _ = _row_times_matrix(*view_xyz, proj)
    px = (cx * 0.5 + 0.5) * F.lit(float(width))
    py = (F.lit(1.0) - (cy * 0.5 + 0.5)) * F.lit(float(height))
    if scale > 0.0 and abs(scale - 1.0) > 1e-9:
        mx, my = width * 0.5, height * 0.5
        px = F.lit(mx) + (px - F.lit(mx)) * F.lit(scale)
        py = F.lit(my) + (py - F.lit(my)) * F.lit(scale)
    return [px.cast("bigint"), py.cast("bigint")]


def heading(d_first, d_second) -> tuple[Column, Column]:
    """Unit bearing of a horizontal offset; null where the two points coincide."""
    a, b = _c(d_first), _c(d_second)
    far = a * a + b * b > F.lit(1e-12)
    angle = F.atan2(b, a)
    return F.when(far, F.cos(angle)), F.when(far, F.sin(angle))
