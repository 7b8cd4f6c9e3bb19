"""Functions over model scores (M1, M2) and box geometry (M7, M9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _exp_sum(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.aggregate(F.transform(logits, lambda x: F.exp(x - top)),
                       F.lit(0.0), lambda a, b: a + b)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of array<double>."""
    top, total = F.array_max(logits), _exp_sum(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def free_energy(logits: Column) -> Column:
    """Minus log-sum-exp: low for familiar inputs."""
    return -(F.array_max(logits) + F.log(_exp_sum(logits)))


def top_class(logits: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def map_bbox_to_original(bbox: Column, matrix: Column) -> Column:
    """Box mapped back through the inverse of a 3x3 perspective transform.

    ``matrix`` is array<double> in row order; NULL means no transform was made.
    """
    a, b, c, d, e, f, g, h, i = [F.get(matrix, F.lit(k)) for k in range(9)]
    # The adjugate is enough: the determinant cancels in the division by w.
    inverse = [e * i - f * h, c * h - b * i, b * f - c * e,
               f * g - d * i, a * i - c * g, c * d - a * f,
               d * h - e * g, b * g - a * h, a * e - b * d]
    x1, y1, x2, y2 = [F.get(bbox, F.lit(k)).cast("double") for k in range(4)]
    xs, ys = [], []
    for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2)):
        w = inverse[6] * x + inverse[7] * y + inverse[8]
        xs.append((inverse[0] * x + inverse[1] * y + inverse[2]) / w)
        ys.append((inverse[3] * x + inverse[4] * y + inverse[5]) / w)
    mapped = F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    return F.when(matrix.isNull(), bbox).otherwise(mapped.cast("array<int>"))


def bbox_to_relative(bbox: Column, width: Column, height: Column, cls: Column) -> Column:
    """Label row ``class cx cy w h`` with sizes relative to the page."""
    x1, y1, x2, y2 = [F.get(bbox, F.lit(k)).cast("double") for k in range(4)]
    numbers = [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height,
               (x2 - x1) / width, (y2 - y1) / height]
    return F.concat_ws(" ", cls.cast("string"),
                       *[F.format_string("%.6f", n) for n in numbers])


def polygon_bbox(points: Column) -> Column:
    """Enclosing box of a polygon given as array<array<int>> of x, y."""
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys),
                   F.array_max(xs), F.array_max(ys)).cast("array<int>")
