"""Box arithmetic as Column expressions; boxes are (x1, y1, x2, y2) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DISTANCE = 99999.0


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, low, high) -> Column:
    return F.greatest(c(low), F.least(c(x), c(high)))


def area(x1, y1, x2, y2) -> Column:
    return (c(x2) - c(x1)) * (c(y2) - c(y1))


def center(a, b) -> Column:
    """The middle, truncated to a whole number."""
    return ((c(a) + c(b)) / 2).cast("long")


def is_empty(x1, y1, x2, y2, class_name) -> Column:
    return (c(x1) + c(y1) + c(x2) + c(y2) == 0) | (c(class_name) == "EMPTY")


def distance_to_center(x1, y1, x2, y2, width, height) -> Column:
    dx, dy = center(x1, x2) - c(width) / 2, center(y1, y2) - c(height) / 2
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(UNKNOWN_DISTANCE))


def relative(x, of) -> Column:
    return c(x).cast("double") / c(of)


def percent(x, of) -> Column:
    return c(x).cast("double") / c(of) * 100.0


def from_percent(x, of) -> Column:
    return c(x) / 100.0 * c(of)


def clip_percent(x, w) -> tuple[Column, Column]:
    """Start and length within [0, 100]."""
    return clamp(x, 0.0, 100.0), clamp(w, 0.0, 100.0 - F.greatest(F.lit(0.0), c(x)))


def clip_box(x, y, w, h, width, height, tolerance: int = 5) -> dict[str, Column]:
    """A COCO box cut to its image and floored if it lies within the tolerance, else the box as it is and valid = false."""
    x, y, w, h, width, height = (c(v).cast("double") for v in (x, y, w, h, width, height))
    valid = (x >= -tolerance) & (y >= -tolerance) & (x + w <= width + tolerance) & (y + h <= height + tolerance)
    cx, cy = clamp(x, 0.0, width), clamp(y, 0.0, height)
    cut = (cx, cy, F.greatest(F.lit(0.0), F.least(w, width - cx)), F.greatest(F.lit(0.0), F.least(h, height - cy)))
    out = {f"c{n}": F.when(valid, F.floor(v).cast("double")).otherwise(o) for n, v, o in zip("xywh", cut, (x, y, w, h), strict=True)}
    changed = valid & ((cut[0] != x) | (cut[1] != y) | (cut[2] != w) | (cut[3] != h))
    return out | {"was_clipped": F.lit(False), "was_clipped_fixed": changed, "is_valid": valid}


def yolo_line(class_id, x, y, w, h, width, height) -> Column:
    """Ties of the sixth digit go to the even one."""
    x, y, w, h = (c(v).cast("double") for v in (x, y, w, h))
    values = ((x + w / 2) / c(width), (y + h / 2) / c(height), w / c(width), h / c(height))
    return F.format_string("%d %.6f %.6f %.6f %.6f", c(class_id), *[F.bround(v, 6) for v in values])


def yolo_to_coco(cx, cy, w, h, width, height) -> tuple[Column, Column, Column, Column]:
    return (c(cx) - c(w) / 2) * c(width), (c(cy) - c(h) / 2) * c(height), c(w) * c(width), c(h) * c(height)


def square_around(x1, y1, x2, y2, size: int, right, bottom) -> tuple[Column, Column, Column, Column]:
    """A square of that size around the box's centre, each edge clamped to [0, right] or [0, bottom]."""
    left, top = (c(x1) + c(x2)) / 2.0 - size / 2.0, (c(y1) + c(y2)) / 2.0 - size / 2.0
    return clamp(left, 0.0, right), clamp(top, 0.0, bottom), clamp(left + size, 0.0, right), clamp(top + size, 0.0, bottom)


def shifted_crop(a, b, size: int, limit) -> tuple[Column, Column]:
    """One axis of a crop of a given size around the middle of [a, b], shifted inward at the image's border; the whole axis if that is shorter."""
    middle, half, limit = (c(a) + c(b)) / 2, size // 2, c(limit)
    low = F.greatest(F.lit(0), (middle - half).cast("long"))
    high = F.least(limit, (middle + half).cast("long"))
    short = high - low < size
    new_high = F.when(short & (low == 0), F.least(limit, F.lit(size))).otherwise(high)
    new_low = F.when(short & (low != 0), F.greatest(F.lit(0), high - size)).otherwise(low)
    low, high = F.when(limit < size, F.lit(0)).otherwise(new_low), F.when(limit < size, limit).otherwise(new_high)
    low = clamp(low, 0, limit - 1)
    return low, F.greatest(low + 1, F.least(high, limit))


def crop_window(x, limit, size: int) -> tuple[Column, Column]:
    return F.greatest(c(x) - size // 2, F.lit(0)).cast("long"), F.least(c(x) + size // 2, c(limit)).cast("long")


def intersection(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    w = F.greatest(F.lit(0), F.least(c(ax2), c(bx2)) - F.greatest(c(ax1), c(bx1)))
    h = F.greatest(F.lit(0), F.least(c(ay2), c(by2)) - F.greatest(c(ay1), c(by1)))
    return (w * h).cast("double")


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    both = intersection(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)
    return both / F.nullif(area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - both, F.lit(0.0))


def ciou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, plain=None, turn=None) -> Column:
    """IoU less the centres' squared distance over the squared diagonal of the hull, less the weighted difference of aspect ratios. plain and turn: the IoU and the difference of the boxes' angles, if known."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (c(v).cast("double") for v in (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    i = iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) if plain is None else c(plain)
    hull_w, hull_h = F.greatest(ax2, bx2) - F.least(ax1, bx1), F.greatest(ay2, by2) - F.least(ay1, by1)
    apart = (F.pow(ax1 + ax2 - bx1 - bx2, 2.0) + F.pow(ay1 + ay2 - by1 - by2, 2.0)) / 4.0
    turn = angle(ax1, ay1, ax2, ay2) - angle(bx1, by1, bx2, by2) if turn is None else c(turn)
    v = F.pow(turn, 2.0) * 4.0 / (F.pi() * F.pi())
    return i - apart / (hull_w * hull_w + hull_h * hull_h) - v * v / F.greatest(F.lit(1e-12), 1.0 - i + v)


def angle(x1, y1, x2, y2) -> Column:
    """Of a box's diagonal, from its aspect ratio."""
    return F.atan((c(x2) - c(x1)) / (c(y2) - c(y1)))


IOU_SQL = """((greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))::DOUBLE
 / nullif(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)), 0))"""
