"""Points and lines as flat arrays of doubles. A specimen's points are [w0x, w0y, w1x, w1y, l0x, l0y, l1x, l1y]: the ends of
its width line and of its length line. An affine map is [a, b, c, d, e, f]: x' = ax + by + c, y' = dx + ey + f."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caliper.functions.arrays import let, total

LEAST_SCALE = 1e-6
LEAST_WEIGHT = 1e-8


def _pairs(points: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.size(points) / 2).cast("int") - 1)


def array_of(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def apply_affine(m: Column, points: Column) -> Column:
    def moved(s: Column) -> Column:
        a, p = s["m"], s["p"]
        point = lambda i: F.array(a[0] * p[2 * i] + a[1] * p[2 * i + 1] + a[2], a[3] * p[2 * i] + a[4] * p[2 * i + 1] + a[5])
        return F.flatten(F.transform(_pairs(p), point))

    return let(F.struct(m.alias("m"), points.alias("p")), moved)


def crop_resize(x0: Column, y0: Column, w: Column, h: Column, size: float) -> Column:
    """Crop a box and scale it to size x size."""
    zero = F.lit(0.0)
    return F.array(size / w, zero, -x0 * size / w, zero, size / h, -y0 * size / h)


def horizontal_flip(width: float) -> Column:
    return array_of(-1, 0, width - 1, 0, 1, 0)


def vertical_flip(height: float) -> Column:
    return array_of(1, 0, 0, 0, -1, height - 1)


def rotation(degrees: float, cx: float, cy: float) -> Column:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return array_of(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy)


def compose(second: Column, first: Column) -> Column:
    """The map that applies first, then second."""

    def product(s: Column) -> Column:
        a, b = s["a"], s["b"]
        row = lambda i: [a[i] * b[0] + a[i + 1] * b[3], a[i] * b[1] + a[i + 1] * b[4], a[i] * b[2] + a[i + 1] * b[5] + a[i + 2]]
        return F.array(*row(0), *row(3))

    return let(F.struct(second.alias("a"), first.alias("b")), product)


def invert(m: Column) -> Column:
    """NULL elements if the map has no inverse."""

    def inverse(a: Column) -> Column:
        det = a[0] * a[4] - a[1] * a[3]
        q = lambda x: F.try_divide(x, det)
        return F.array(q(a[4]), q(-a[1]), q(a[1] * a[5] - a[4] * a[2]), q(-a[3]), q(a[0]), q(a[3] * a[2] - a[0] * a[5]))

    return let(m, inverse)


def distance(a: Column, i: int, b: Column, j: int) -> Column:
    """From point i of a to point j of b."""
    dx, dy = a[2 * i] - b[2 * j], a[2 * i + 1] - b[2 * j + 1]
    return F.sqrt(dx * dx + dy * dy)


def line_length(points: Column, line: int) -> Column:
    return distance(points, 2 * line, points, 2 * line + 1)


def match_ends(pred: Column, truth: Column, line: int) -> Column:
    """The predicted line's ends, swapped if and only if that is strictly nearer to the true ones."""
    i, j = 2 * line, 2 * line + 1
    straight = distance(pred, i, truth, i) + distance(pred, j, truth, j)
    crossed = distance(pred, j, truth, i) + distance(pred, i, truth, j)
    at = 4 * line
    swapped = F.array(pred[at + 2], pred[at + 3], pred[at], pred[at + 1])
    return F.when(crossed < straight, swapped).otherwise(F.array(pred[at], pred[at + 1], pred[at + 2], pred[at + 3]))


def px_per_cm(bar: Column) -> Column:
    return line_length(bar, 0)


def valid_scale(scale: Column, flag: Column) -> Column:
    return ~F.isnan(scale) & (scale < F.lit(float("inf"))) & (scale > LEAST_SCALE) & flag


def length_error_cm(pred: Column, truth: Column, line: int, scale: Column, mask: Column) -> Column:
    error = F.abs(line_length(pred, line) - line_length(truth, line))
    return F.when(mask > 0, F.try_divide(error, scale))


def point_error_cm(pred: Column, truth: Column, line: int, scale: Column, masks: tuple[Column, Column]) -> Column:
    """Mean distance in cm of a line's matched ends over those whose mask is above 0; NULL if none is or the scale is NULL."""

    def mean(s: Column) -> Column:
        at = (2 * line, 2 * line + 1)
        errors = F.array(*[F.when(m > 0, distance(s["p"], i, s["g"], at[i])) for i, m in enumerate(masks)])
        counted = F.filter(errors, lambda x: x.isNotNull())
        return F.try_divide(total(counted), F.size(counted) * scale)

    return let(F.struct(match_ends(pred, truth, line).alias("p"), truth.alias("g")), mean)


def inside(x: Column, y: Column, width: float, height: float) -> Column:
    """Half-open bounds."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def outside_fraction(points: Column, width: float, height: float) -> Column:
    out = F.transform(_pairs(points), lambda i: F.when(inside(points[2 * i], points[2 * i + 1], width, height), 0.0).otherwise(1.0))
    return F.aggregate(out, F.lit(0.0), lambda a, x: a + x) / F.size(out)


def bounds_mask(points: Column, line: int, width: float, height: float, policy: str, mask: Column) -> Column:
    """Loss mask of a line under a policy for points out of bounds: 'any' masks it if one end is out, 'all' if both are,
    'supervise' never."""
    a = inside(points[4 * line], points[4 * line + 1], width, height)
    b = inside(points[4 * line + 2], points[4 * line + 3], width, height)
    keep = {"any": a & b, "all": a | b, "supervise": F.lit(True)}[policy]
    return F.when(keep, mask).otherwise(0.0)


def to_heatmap(p: Column, stride: float) -> Column:
    """Image coordinate to the cell grid of a heatmap whose cells are stride pixels wide (cell centers align)."""
    return (p + 0.5) / stride - 0.5


def from_heatmap(p: Column, stride: float) -> Column:
    return (p + 0.5) * stride - 0.5


def gaussian_map(cx: Column, cy: Column, size: int, sigma: float) -> Column:
    """size*size values, row by row, of a Gaussian with peak 1 at (cx, cy)."""

    def cells(c: Column) -> Column:
        value = lambda i: F.exp(-(F.pow(F.pmod(i, F.lit(size)) - c["x"], 2) + F.pow(F.floor(i / size) - c["y"], 2)) / (2 * sigma * sigma))
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), value)

    return let(F.struct(cx.alias("x"), cy.alias("y")), cells)


def _scaled(xs: Column) -> Column:
    """xs over their sum."""
    return let(F.struct(xs.alias("xs"), total(xs).alias("sum")), lambda s: F.transform(s["xs"], lambda x: x / s["sum"]))


def softmax(logits: Column) -> Column:
    return let(let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))), _scaled)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def near_uniform(h: Column, cells: int, share: float = 0.98) -> Column:
    return h >= share * math.log(cells)


def expected_cell(p: Column, size: int) -> Column:
    """[x, y]: the mean cell under probabilities p, row by row."""

    def mean(q: Column) -> Column:
        fold = lambda f: F.aggregate(F.transform(q, lambda w, i: w * f(i)), F.lit(0.0), lambda a, x: a + x)
        return F.array(fold(lambda i: F.pmod(i, F.lit(size))), fold(lambda i: F.floor(i / size)))

    return let(p, mean)


def hard_argmax(logits: Column, size: int) -> Column:
    """[x, y] of the first largest cell."""
    return let(F.array_position(logits, F.array_max(logits)) - 1, lambda at: F.array(F.pmod(at, F.lit(size)), F.floor(at / size)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of softmax(logits) against a target map scaled to sum 1."""
    logp = F.transform(softmax(logits), lambda x: F.ln(F.greatest(x, F.lit(1e-300))))
    return F.aggregate(F.zip_with(logp, let(target, _scaled), lambda a, t: -a * t), F.lit(0.0), lambda a, x: a + x)


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def masked_line_loss(pred: list[Column], truth: list[Column], masks: list[Column], loss: Callable[[Column, Column], Column], terms: float = 1.0) -> Column:
    """Mean loss of lines whose ends are pairs of maps, over the lines' masks: of both ways to match the ends the cheaper one.
    `terms` is the number of terms that a line's loss adds up."""
    sums = [F.least(loss(pred[i], truth[i]) + loss(pred[i + 1], truth[i + 1]), loss(pred[i], truth[i + 1]) + loss(pred[i + 1], truth[i])) for i in range(0, len(pred), 2)]
    return sum((s * m for s, m in zip(sums, masks, strict=True)), F.lit(0.0)) / F.greatest(sum(masks, F.lit(0.0)) * terms, F.lit(LEAST_WEIGHT))


def crop_to_image(p: Column, crop: float, box0: Column, box_side: Column) -> Column:
    """A coordinate in a crop scaled to `crop` pixels, back in the image that the box was cut from."""
    return p * box_side / crop + box0
