"""Column functions on points, boxes and rectangles, and decisions on detected text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import Policy


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def coerced_points(numbers: Column) -> Column:
    """Four numbers are two corners, eight or more (even) are points, anything else is no box."""
    n = F.size(numbers)
    corners = F.array(*[point(numbers[i], numbers[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))])
    pairs = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: point(F.get(numbers, i * 2), F.get(numbers, i * 2 + 1)))
    return F.when(n == 4, corners).when((n >= 8) & (n % 2 == 0), pairs)


def side(points: Column, axis: str, largest: bool) -> Column:
    v = F.transform(points, lambda p: p[axis])
    return F.array_max(v) if largest else F.array_min(v)


def big_enough(points: Column, policy: Policy) -> Column:
    """Smaller side of the box; no box passes."""
    small = F.least(side(points, "x", True) - side(points, "x", False), side(points, "y", True) - side(points, "y", False))
    return F.coalesce(small >= policy.min_box_side, F.lit(True))


def in_band(cx: Column, cy: Column, rows: Column, cols: Column, share: float) -> Column:
    """In the outer band of an image."""
    fx, fy = cols * share, rows * share
    return (cx <= fx) | (cx >= cols - fx) | (cy <= fy) | (cy >= rows - fy)


def in_border(points: Column, rows: Column, cols: Column, policy: Policy) -> Column:
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)
    return F.coalesce(in_band(mean("x"), mean("y"), rows, cols, policy.border_share), F.lit(True))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, rows: Column, cols: Column, policy: Policy) -> Column:
    """Pixel rectangle of a box, padded and cut to the image; null where nothing is left."""
    pad = F.lit(policy.exact_pad) if policy.exact else F.greatest(F.lit(policy.pad_px), F.greatest(F.lit(1.0), y1 - y0) * policy.pad_share)
    zero = F.lit(0)
    r = rect(F.greatest(zero, F.floor(x0 - pad)), F.greatest(zero, F.floor(y0 - pad)), F.least(cols, F.ceil(x1 + pad)), F.least(rows, F.ceil(y1 + pad)))
    return F.when((r.x1 > r.x0) & (r.y1 > r.y0), r)


def box_rect(points: Column, rows: Column, cols: Column, policy: Policy, gray_rows: Column | None = None, gray_cols: Column | None = None) -> Column:
    """Rectangle of a hit's polygon, scaled from the detector's raster to the image's."""
    sx = cols / gray_cols if gray_cols is not None else F.lit(1.0)
    sy = rows / gray_rows if gray_rows is not None else F.lit(1.0)
    return padded(side(points, "x", False) * sx, side(points, "y", False) * sy, side(points, "x", True) * sx, side(points, "y", True) * sy, rows, cols, policy)


def border_band(rows: Column, cols: Column, policy: Policy) -> Column:
    """Four rectangles along the edges; widths round half to even."""
    half = lambda n: (n / 2).cast("int")
    bx = F.greatest(F.lit(1), F.least(F.bround(cols * policy.band_share).cast("int"), half(cols)))
    by = F.greatest(F.lit(1), F.least(F.bround(rows * policy.band_share).cast("int"), half(rows)))
    zero = F.lit(0)
    return F.array(rect(zero, zero, cols, by), rect(zero, rows - by, cols, rows), rect(zero, zero, bx, rows), rect(cols - bx, zero, cols, rows))


def near(line: Column, seed: Column, pad: float) -> Column:
    """Overlap of a line with a rectangle grown by ``pad``."""
    return (line.x0 < seed.x1 + pad) & (line.x1 > seed.x0 - pad) & (line.y0 < seed.y1 + pad) & (line.y1 > seed.y0 - pad)


def relevant(line: Column, seeds: Column, rows: Column, cols: Column, policy: Policy) -> Column:
    border = in_band((line.x0 + line.x1) / 2, (line.y0 + line.y1) / 2, rows, cols, policy.sweep_border)
    return border | F.exists(seeds, lambda s: near(line, s, policy.sweep_near))


def wanted(burned: Column, forced: Column, policy: Policy) -> Column:
    """Whether a slice is examined for text."""
    return F.lit(policy.detect) & (F.lit(policy.examine_all) | forced | burned)


def passes_prescreen(components: Column, burned: Column, policy: Policy) -> Column:
    if not policy.prescreen:
        return F.lit(True)
    # a count that failed must not hide text
    enough = F.coalesce(components >= policy.min_components, F.lit(True))
    return enough | burned if policy.run_on_flagged else enough


def confident(conf: Column, policy: Policy) -> Column:
    return F.when(conf.isNull(), F.lit(policy.keep_unknown_confidence)).otherwise(conf >= policy.min_confidence)


def action(n_boxes: Column, n_boxless: Column, policy: Policy) -> tuple[Column, Column, Column]:
    """(action, forced_keep, boxless strategy) for a slice with text."""
    lone = (n_boxless > 0) & (n_boxes == 0)
    first = F.when(lone & F.lit(policy.action == "redact" and policy.boxless == "drop"), F.lit("drop")).otherwise(F.lit(policy.action))
    forced = F.lit(policy.never_drop) & (first == "drop")
    strategy = F.when(lone & F.lit(policy.never_drop), F.lit("border_band")).otherwise(F.lit(policy.boxless))
    return F.when(forced, F.lit("redact")).otherwise(first), forced, strategy


def decision(act: Column, n_rects: Column, policy: Policy) -> Column:
    """REDACTED, DROPPED or UNMASKED."""
    return F.when((act == "redact") & (n_rects > 0), "REDACTED").when((act == "drop") & F.lit(not policy.never_drop), "DROPPED").otherwise("UNMASKED")


def bucket(want: Column, has_text: Column, has_image: Column, skipped: Column) -> Column:
    """How a slice counts in the accounting of images."""
    return F.when(~want, "not_examined").when(has_text, "detected").when(~has_image, "no_image").when(skipped, "prescreen_skipped").otherwise("clean")
