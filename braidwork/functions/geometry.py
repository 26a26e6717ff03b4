"""Plane and space geometry as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped_acos(c: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def line_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Orientation of the line from a to b, in degrees."""
    return F.degrees(F.atan2(by - ay, bx - ax))


def line_separation(angle_a: Column, angle_b: Column) -> Column:
    """Angle between two undirected lines, 0 to 90 degrees."""
    d = F.abs(angle_a - angle_b) % 180
    return F.least(d, 180 - d)


def interior_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle at b in the plane, 0 to 180 degrees; null where two points coincide."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    n = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(n > 0, _clamped_acos((ux * vx + uy * vy) / n))


def tilt_from_vertical(dx: Column, dy: Column) -> Column:
    """Angle of a vector to image-up, whose y is negative; null for no length."""
    n = F.hypot(dx, dy)
    return F.when(n > 0, _clamped_acos(-dy / n))


def inclination(dx: Column, dy: Column, signed: bool = False) -> Column:
    """Angle of a path to the horizontal, rising (y falling) positive; folded to -90..90 unless signed.

    A level path to the left is at -180: the angle is negated and not dy, as Spark's atan2 knows no negative zero.
    """
    return 0.0 - F.degrees(F.atan2(dy, dx if signed else F.abs(dx)))


def _norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def vector_angle3(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Angle between vectors in space; lengths are padded by 1e-9, so zero vectors give 90."""
    na, nb = _norm3(*a) + 1e-9, _norm3(*b) + 1e-9
    return _clamped_acos(sum((p / na * (q / nb) for p, q in zip(a[1:], b[1:], strict=True)), a[0] / na * (b[0] / nb)))


def undirected_angle3(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    t = vector_angle3(a, b)
    return F.least(t, 180 - t)


def between3(p: Column, q: Column) -> tuple[Column, Column, Column]:
    """The vector from struct p to struct q."""
    return q["x"] - p["x"], q["y"] - p["y"], q["z"] - p["z"]


def interior_angle3(a: Column, b: Column, c: Column) -> Column:
    return vector_angle3(between3(b, a), between3(b, c))


def elevation3(v: tuple[Column, Column, Column]) -> Column:
    """Inclination of a vector whose y axis points down; x and z are horizontal."""
    return F.degrees(F.atan2(-v[1], F.hypot(v[0], v[2])))


def lerp(a: Column, b: Column, share: float) -> Column:
    return a + share * (b - a)


def screen_normalised(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return x / width * 2 - 1, y / width * 2 - height / width


def box_columns(x1: str, y1: str, x2: str, y2: str) -> dict[str, Column]:
    """width, height, area, cx and cy of a box."""
    w, h = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return {"width": w, "height": h, "area": w * h, "cx": (F.col(x1) + F.col(x2)) / 2, "cy": (F.col(y1) + F.col(y2)) / 2}


def box_ends(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(knob, tip) as structs: the ends of a diagonal of the box, rising to the right in a wide or square box, falling in a tall one."""
    wide = (x2 - x1) >= (y2 - y1)
    point = lambda y: lambda x: F.struct(x.alias("x"), y.alias("y"))
    return point(F.when(wide, y2).otherwise(y1))(x1), point(F.when(wide, y1).otherwise(y2))(x2)


def blob(height: int, width: int, cx: Column, cy: Column, sigma: float) -> Column:
    """A heat map, row by row: a Gaussian of height 1 at (cx, cy)."""
    cell = lambda i: F.exp(-((i % width - cx) * (i % width - cx) + (F.floor(i / width) - cy) * (F.floor(i / width) - cy)) / (2 * sigma * sigma))
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), cell)


def peak(heat: Column, width: int, threshold: float = 0.3) -> Column:
    """struct<x, y, value> of a heat map's first largest cell; null below the threshold."""

    def found(own: Column) -> Column:
        top = F.array_max(own)
        at = F.array_position(own, top) - 1
        return F.when(top >= threshold, F.struct((at % width).alias("x"), F.floor(at / width).alias("y"), top.alias("value")))

    # As the one element of an array, the map is made once and not each time that it is named
    return F.transform(F.array(heat), found)[0]


def cosine(a: Column, b: Column) -> Column:
    """Dot product, the cosine where both vectors have length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
