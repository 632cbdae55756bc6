"""Column functions on vectors and quaternions. A vector is a tuple of three columns, a quaternion (w, x, y, z) of four."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a):
    """a over its length; a zero stays as it is."""
    n = norm(a)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return tuple(x / n for x in a)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def angle_to_horizontal(v: Vec, up: Vec) -> Column:
    """Degrees above the plane that up stands on; null for a vector shorter than 1e-9."""
    n = norm(v)
    return F.when(n >= 1e-9, F.degrees(F.asin(clip(dot(v, up) / n, -1.0, 1.0))))


def spherical(azimuth: Column, elevation: Column) -> Vec:
    return F.cos(elevation) * F.cos(azimuth), F.cos(elevation) * F.sin(azimuth), F.sin(elevation)


def point_at(knob: Vec, axis: Vec, s) -> Vec:
    """The place s along an axis; of velocities and axis rates, the velocity there."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return tuple(k + s * a for k, a in zip(knob, axis, strict=True))


def lever_acceleration(accel: Vec, omega: Vec, alpha: Vec, arm: Vec) -> Vec:
    """Acceleration at the hub of an arm whose end has this one, on a body that turns."""
    tangential, inner = cross(alpha, arm), cross(omega, arm)
    centripetal = cross(omega, inner)
    return tuple(a - x - c for a, x, c in zip(accel, tangential, centripetal, strict=True))


def conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def multiply(p: Quat, q: Quat) -> Quat:
    """Hamilton product: scalar part first, vector part as p0 q + q0 p + p x q."""
    pv, qv = p[1:], q[1:]
    c = cross(pv, qv)
    return (p[0] * q[0] - dot(pv, qv), *(p[0] * y + q[0] * x + z for x, y, z in zip(pv, qv, c, strict=True)))


def rotate(q: Quat, v: Vec) -> Vec:
    """v turned by the unit quaternion: v + 2w (u x v) + 2 u x (u x v)."""
    q = unit(q)
    once = cross(q[1:], v)
    twice = cross(q[1:], once)
    return tuple(x + 2 * (q[0] * y + z) for x, y, z in zip(v, once, twice, strict=True))


def to_matrix(q: Quat) -> list[Vec]:
    """Rows of the rotation matrix."""
    zero, one = F.lit(0.0), F.lit(1.0)
    columns = [rotate(q, e) for e in ((one, zero, zero), (zero, one, zero), (zero, zero, one))]
    return [tuple(c[k] for c in columns) for k in range(3)]


def from_matrix(m: list[Vec]) -> Quat:
    """The quaternion of a rotation matrix, w not negative; the branch of the largest of the four squares is taken."""
    trace = m[0][0] + m[1][1] + m[2][2]
    squares = [1 + trace] + [1 + 2 * m[k][k] - trace for k in range(3)]
    big = F.greatest(*squares)
    root = F.sqrt(F.greatest(big, F.lit(1e-12)))
    skew = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]

    def part(k: int) -> Column:
        out = None
        for j in range(4):
            if j == k:
                value = root / 2
            elif j == 0 or k == 0:
                value = skew[max(j, k) - 1] / (2 * root)
            else:
                value = (m[j - 1][k - 1] + m[k - 1][j - 1]) / (2 * root)
            out = F.when(squares[j] == big, value) if out is None else out.when(squares[j] == big, value)
        return out

    q = [part(k) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(sign * x for x in q)


def from_rotation_vector(v: Vec) -> Quat:
    """Exponential map; a series replaces sin(a/2)/a where the angle a is not over 1e-9."""
    angle = norm(v)
    k = F.when(angle > 1e-9, F.sin(angle / 2) / F.when(angle > 1e-9, angle).otherwise(1.0)).otherwise(0.5 - angle * angle / 48)
    return F.cos(angle / 2), k * v[0], k * v[1], k * v[2]


def to_rotation_vector(q: Quat) -> Vec:
    """Logarithm, of the sign with w not negative; twice the vector part where that is not over 1e-12."""
    q = unit(q)
    flip = F.when(q[0] < 0, -1.0).otherwise(1.0)
    w, v = flip * q[0], tuple(flip * x for x in q[1:])
    n = norm(v)
    k = F.when(n > 1e-12, 2 * F.atan2(n, w) / F.when(n > 1e-12, n).otherwise(1.0)).otherwise(2.0)
    return tuple(k * x for x in v)


def angle_between(p: Quat, q: Quat) -> Column:
    """Angle of the turn from one to the other, in radians."""
    return 2 * F.acos(clip(F.abs(dot(unit(p), unit(q))), 0.0, 1.0))


def shortest_arc(a: Vec, b: Vec) -> Quat:
    """The least turn of a's direction into b's; of opposite ones, half a turn about a normal of a."""
    a, b = unit(a), unit(b)
    c = dot(a, b)
    turn = unit((1 + c, *cross(a, b)))
    one, zero = F.lit(1.0), F.lit(0.0)
    steep = F.abs(a[0]) < 0.9
    normal_x, normal_y = cross(a, (one, zero, zero)), cross(a, (zero, one, zero))
    half = unit(tuple(F.when(steep, x).otherwise(y) for x, y in zip(normal_x, normal_y, strict=True)))
    opposite = c < -0.999999
    return tuple(F.when(opposite, x).otherwise(y) for x, y in zip((zero, *half), turn, strict=True))


def skew_rows(v: Vec) -> list[Vec]:
    zero = F.lit(0.0)
    return [(zero, -v[2], v[1]), (v[2], zero, -v[0]), (-v[1], v[0], zero)]


def body_rate(q: Quat, dq: Quat) -> Vec:
    """Angular rate in the body's frame of a quaternion and its derivative: the vector part of 2 q* dq."""
    return tuple(2 * x for x in multiply(conjugate(q), dq)[1:])


def world_rate(q: Quat, dq: Quat) -> Vec:
    return tuple(2 * x for x in multiply(dq, conjugate(q))[1:])


def lerped(p: Quat, q: Quat, x: Column) -> Quat:
    """Component by component between two quaternions, made unit again."""
    return unit(tuple(a + (b - a) * x for a, b in zip(p, q, strict=True)))
