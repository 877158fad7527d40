"""Boxes, image sizes and similarity transforms as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def width(r: Column) -> Column:
    return F.greatest(r["x2"] - r["x1"], F.lit(0.0))


def height(r: Column) -> Column:
    return F.greatest(r["y2"] - r["y1"], F.lit(0.0))


def area(r: Column) -> Column:
    return width(r) * height(r)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is no area."""
    common = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def expanded(r: Column, factor: Column | float, w: Column, h: Column) -> Column:
    """Grown about its centre by ``factor``, inside the image."""
    f = F.lit(factor) if isinstance(factor, float | int) else factor
    cx, cy = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2
    dx, dy = width(r) * f / 2, height(r) * f / 2
    zero = F.lit(0.0)
    return rect(F.greatest(cx - dx, zero), F.greatest(cy - dy, zero), F.least(cx + dx, w), F.least(cy + dy, h))


def normalised(r: Column, w: Column, h: Column) -> Column:
    """(x, y, w, h) as shares of the image, each within 0 and 1; sizes under 1 count as 1."""
    share = lambda v, of: F.greatest(F.least(v / F.greatest(of, F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    return F.struct(share(r["x1"], w).alias("x"), share(r["y1"], h).alias("y"), share(width(r), w).alias("w"), share(height(r), h).alias("h"))


def detection_quality(score: Column, box_area: Column, frame_area: Column) -> Column:
    """0.6 for the score, 0.4 for a size of which a twentieth of the frame is full marks."""
    unit = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    return unit(score) * 0.6 + unit(F.coalesce(F.try_divide(box_area, frame_area), F.lit(0.0)) / 0.05) * 0.4


def letterbox(w: Column, h: Column, target: Column) -> Column:
    """(width, height, scale) of an image scaled to fit a square."""
    scale = F.least(target / w, target / h)
    side = lambda v: F.greatest(F.round(v * scale), F.lit(1.0)).cast("long")
    return F.struct(side(w).alias("width"), side(h).alias("height"), scale.alias("scale"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors as doubles, within -1 and 1; 0 for different sizes."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))


def unit_vector(v: Column) -> Column:
    """Scaled to length one; a vector of no length stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similarity_transform(src: Column, dst: Column) -> Column:
    """The scaling, turn and shift that best take points ``src`` to ``dst``, arrays of (x, y): the
    image of (x, y) is (a x - b y + tx, b x + a y + ty). Null for fewer than two points or no extent."""
    n = F.size(src).cast("double")
    pairs = F.arrays_zip(src.alias("s"), dst.alias("d"))

    def sums(zero: int, of) -> Column:
        """Sums over all pairs in one pass."""
        named = lambda values: F.struct(*[v.alias(f"t{i}") for i, v in enumerate(values)])
        return F.aggregate(pairs, named([F.lit(0.0)] * zero), lambda s, p: named([s[f"t{i}"] + v for i, v in enumerate(of(p["s"]["x"], p["s"]["y"], p["d"]["x"], p["d"]["y"]))]))

    def with_means(m: Column) -> Column:
        sx, sy, dx, dy = (m[f"t{i}"] / n for i in range(4))
        moments = sums(3, lambda x, y, p, q: ((x - sx) * (x - sx) + (y - sy) * (y - sy), (x - sx) * (p - dx) + (y - sy) * (q - dy), (x - sx) * (q - dy) - (y - sy) * (p - dx)))
        return _bound(moments, lambda t: fitted(t["t0"], t["t1"] / t["t0"], t["t2"] / t["t0"], sx, sy, dx, dy))

    def fitted(norm: Column, a: Column, b: Column, sx: Column, sy: Column, dx: Column, dy: Column) -> Column:
        fit = F.struct(a.alias("a"), b.alias("b"), (dx - a * sx + b * sy).alias("tx"), (dy - b * sx - a * sy).alias("ty"))
        return F.when((n >= 2) & (F.size(src) == F.size(dst)) & (norm >= 1e-12), fit)

    return _bound(sums(4, lambda x, y, p, q: (x, y, p, q)), with_means)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, not at each place where it stands."""
    return F.element_at(F.transform(F.array(value), f), 1)


def crop_view(x: Column, y: Column, w: Column, h: Column, padding: float = 0.35) -> Column:
    """A square view around a face: side, left and top as shares of the image, and how much to enlarge."""
    side = F.least(F.greatest(w, h) * (1 + padding * 2), F.lit(1.0))
    place = lambda p, s: F.least(F.greatest(p + s / 2 - side / 2, F.lit(0.0)), 1 - side)
    return F.struct(side.alias("side"), place(x, w).alias("left"), place(y, h).alias("top"), F.try_divide(F.lit(1.0), side).alias("scale"))
