"""Raster kernels in numpy, for use inside Arrow and pandas functions."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from veilframe.config import Policy

Rect = tuple[int, int, int, int]


def labels8(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in raster order of their first pixel.

    Horizontal runs are the nodes of a graph whose edges join runs that touch in neighbouring rows; minima spread
    along the edges, with a jump to the label's own label in each round.
    """
    rows, cols = mask.shape
    wide = np.zeros((rows, cols + 2), np.int8)
    wide[:, 1:-1] = mask != 0
    step = np.diff(wide.ravel())
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros((rows, cols), np.int32), 0
    width = cols + 2
    row = start // width
    # runs of the row above that reach into [start - 1, end + 1): neighbours in the sorted list of runs
    low = np.searchsorted(end, start - width, side="left")
    high = np.searchsorted(start, end - width, side="right")
    many = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(start)), many)
    above = np.repeat(low, many) + np.arange(len(below)) - np.repeat(np.cumsum(many) - many, many)
    ok = row[above] == row[below] - 1
    above, below = above[ok], below[ok]
    label = np.arange(len(start))
    while True:
        new = label.copy()
        low = np.minimum(label[above], label[below])
        np.minimum.at(new, above, low)
        np.minimum.at(new, below, low)
        np.minimum.at(new, label[above], low)
        np.minimum.at(new, label[below], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    names, number = np.unique(label, return_inverse=True)
    out = np.zeros(rows * width + 1, np.int32)
    out[start + 1] = number + 1
    out[end + 1] -= (number + 1).astype(np.int32)
    flat = np.cumsum(out)[:-1]
    return flat.reshape(rows, width)[:, 1:-1].astype(np.int32), len(names)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The component with most pixels (the first of equals) as 0 and 1; all 0 without any."""
    lab, n = labels8(mask)
    if not n:
        return np.zeros(mask.shape, np.uint8)
    return (lab == 1 + np.bincount(lab.ravel())[1:].argmax()).astype(np.uint8)


def touching(mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Components of the mask that share a pixel with the seed."""
    lab, _ = labels8(mask)
    hit = np.unique(lab[seed > 0])
    return np.isin(lab, hit[hit > 0]).astype(np.uint8)


def grown(seed: np.ndarray, hu: np.ndarray, diameter: int, bone: int) -> np.ndarray:
    """Geodesic growth: ceil(diameter / 2) steps to the four neighbours, never onto bone, so never across it."""
    allowed = hu < bone
    now = seed > 0
    for _ in range(max(1, -(-max(1, diameter) // 2))):
        more = now.copy()
        more[1:] |= now[:-1]
        more[:-1] |= now[1:]
        more[:, 1:] |= now[:, :-1]
        more[:, :-1] |= now[:, 1:]
        more &= allowed
        if (more == now).all():
            break
        now = more
    return now.astype(np.uint8)


def anterior_mask(shape: tuple[int, int], axis: int, sign: int, share: float = 0.55) -> np.ndarray:
    """The front part of an image."""
    n = shape[axis]
    centre = n // 2
    at = np.arange(n)
    line = at >= int(centre + (1 - share) * (n - 1 - centre)) if sign > 0 else at <= int(centre - (1 - share) * centre)
    return np.broadcast_to(line[:, None] if axis == 0 else line[None, :], shape).astype(np.uint8)


def without_surface(hu: np.ndarray, diameter: int, policy: Policy, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(image with air, skin and face overwritten, mask): seed is the largest air component, grown up to bone."""
    seed = largest_component(hu <= policy.air)
    mask = grown(seed, hu, diameter, policy.bone)
    out = hu.copy()
    put = (mask == 1) & (hu < policy.bone)
    ring = np.unique(hu[(mask > 0) & (seed == 0)])
    ring = ring[(ring > policy.ring[0]) & (ring < policy.ring[1])]
    if policy.surface_fill == "sample" and len(ring):
        out[put] = (rng or np.random.default_rng(0)).choice(ring, int(put.sum()))
    else:
        out[put] = policy.air_value
    return out, mask


def redacted(hu: np.ndarray, rects: list[Rect], policy: Policy) -> np.ndarray:
    """The image with rectangles set to air, to its least value, or to a number."""
    out = hu.copy()
    value = float(policy.air_value)
    if policy.fill == "min" and hu.size:
        value = float(hu.min())
    elif policy.fill not in ("air", "min"):
        try:
            value = float(policy.fill)
        except ValueError:
            pass
    for x0, y0, x1, y1 in rects:
        out[y0:y1, x0:x1] = value
    return out


def to_gray8(values: np.ndarray, slope: float = 1.0, intercept: float = 0.0, inverted: bool = False, samples: int = 1) -> np.ndarray:
    """8-bit image for a detector; of several frames the first, of colours (``samples`` a pixel) the luminance."""
    if values.ndim == 4:
        values = values[0]
    if values.ndim == 3 and samples >= 3 and values.shape[-1] in (3, 4):
        rgb = values[..., :3].astype(np.float32)
        top = float(rgb.max()) if rgb.size else 0.0
        rgb = rgb / top * 255 if top > 255 else rgb
        return np.rint(rgb.clip(0, 255).astype(np.uint8) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    if values.ndim == 3:
        values = values[0]
    v = values.astype(np.float32) * np.float32(slope) + np.float32(intercept)
    lo, hi = float(v.min()), float(v.max())
    gray = ((v - lo) / ((hi if hi > lo else lo + 1.0) - lo) * 255).clip(0, 255).astype(np.uint8)
    return 255 - gray if inverted else gray


def to_hu(raw: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    """16-bit HU; padding values count as 0, overflow wraps."""
    v = raw.astype(np.int16)
    v[v <= -2000] = 0
    if slope != 1:
        v = np.trunc(v.astype(np.float64) * slope).astype(np.int64).astype(np.int16)
    return (v.astype(np.int64) + int(intercept)).astype(np.int16)


def to_stored(hu: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return np.trunc((hu.astype(np.float64) - intercept) / (slope or 1.0)).astype(np.int64).astype(np.int16)


def top_hat(gray: np.ndarray, k: int) -> np.ndarray:
    """Bright details smaller than a k x k square; pixels outside the image don't count."""
    def pass_(a: np.ndarray, worst: int, pick) -> np.ndarray:
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (k // 2, k - 1 - k // 2)
            a = pick(sliding_window_view(np.pad(a, pad, constant_values=worst), k, axis=axis), axis=-1)
        return a

    return gray - pass_(pass_(gray, 255, np.min), 0, np.max)


def otsu(gray: np.ndarray) -> int:
    """Threshold of greatest variance between the classes at or below it and above."""
    p = np.bincount(gray.ravel(), minlength=256) / max(1, gray.size)
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    rest = 1 - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((weight > 1e-12) & (rest > 1e-12), (mean[-1] * weight - mean) ** 2 / (weight * rest), 0)
    return int(between.argmax())


def character_boxes(gray: np.ndarray, policy: Policy) -> list[Rect]:
    """(x, y, width, height) of bright components of a character's size."""
    hat = top_hat(gray, policy.tophat)
    if not hat.size or hat.max() < 1:
        return []
    lab, n = labels8(hat > otsu(hat))
    if not n:
        return []
    y, x = np.nonzero(lab)
    own = lab[y, x] - 1
    box = [np.full(n, 1 << 30), np.full(n, 1 << 30), np.full(n, -1), np.full(n, -1)]
    np.minimum.at(box[0], own, x)
    np.minimum.at(box[1], own, y)
    np.maximum.at(box[2], own, x)
    np.maximum.at(box[3], own, y)
    w, h, area = box[2] - box[0] + 1, box[3] - box[1] + 1, np.bincount(own, minlength=n)
    ok = (h >= policy.char_height[0]) & (h <= policy.char_height[1]) & (w >= policy.char_width[0]) & (w <= policy.char_width[1]) & (area >= policy.char_area)
    return [tuple(int(v) for v in r) for r in np.stack([box[0], box[1], w, h], 1)[ok]]


def text_lines(boxes: list[Rect], policy: Policy) -> list[Rect]:
    """Lines (x0, y0, x1, y1) of character boxes: rows by a running mean of centres, cut at wide gaps."""
    rows: list[list] = []  # centre, height, members
    for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0])):
        centre = y + h / 2
        for row in rows:
            if abs(centre - row[0]) <= policy.gap_y + row[1] / 2:
                row[2].append((x, y, w, h))
                row[0] += (centre - row[0]) / len(row[2])
                row[1] = max(row[1], h)
                break
        else:
            rows.append([centre, h, [(x, y, w, h)]])
    out = []
    for _, _, members in rows:
        members.sort(key=lambda b: b[0])
        cuts = [i for i in range(1, len(members)) if members[i][0] - members[i - 1][0] - members[i - 1][2] > policy.gap_x]
        for a, b in zip([0, *cuts], [*cuts, len(members)], strict=True):
            run = members[a:b]
            if len(run) >= policy.line_chars:
                out.append((min(m[0] for m in run), min(m[1] for m in run), max(m[0] + m[2] for m in run), max(m[1] + m[3] for m in run)))
    return out


def merged(rects: list[Rect]) -> list[Rect]:
    """Bounding boxes of groups of touching rectangles, until none touch."""
    out: list[Rect] = []
    for r in rects:
        while hit := next((o for o in out if r[0] <= o[2] and o[0] <= r[2] and r[1] <= o[3] and o[1] <= r[3]), None):
            out.remove(hit)
            r = (min(r[0], hit[0]), min(r[1], hit[1]), max(r[2], hit[2]), max(r[3], hit[3]))
        out.append(r)
    return sorted(out)


def swept_rects(rects: list[Rect], gray: np.ndarray, shape: tuple[int, int], policy: Policy) -> list[Rect]:
    """Non-exact geometry: relevant text lines are added, all are widened along their line, and merged."""
    rows, cols = shape
    g_rows, g_cols = gray.shape
    sy, sx = rows / g_rows, cols / g_cols
    boxes = character_boxes(gray, policy)
    back = lambda r: (r[0] / sx, r[1] / sy, r[2] / sx, r[3] / sy)
    cut = lambda x0, y0, x1, y1: (max(0, int(np.floor(x0))), max(0, int(np.floor(y0))), min(cols, int(np.ceil(x1))), min(rows, int(np.ceil(y1))))
    out = list(rects)
    if policy.sweep:
        seeds, fx, fy, near = [back(r) for r in rects], policy.sweep_border * g_cols, policy.sweep_border * g_rows, policy.sweep_near
        for x0, y0, x1, y1 in text_lines(boxes, policy):
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            edge = cx <= fx or cx >= g_cols - fx or cy <= fy or cy >= g_rows - fy
            if edge or any(x0 < s[2] + near and x1 > s[0] - near and y0 < s[3] + near and y1 > s[1] - near for s in seeds):
                pad = max(policy.pad_px, policy.pad_share * max(1.0, y1 - y0))
                out.append(cut((x0 - pad) * sx, (y0 - pad) * sy, (x1 + pad) * sx, (y1 + pad) * sy))
    if policy.expand:
        wide = []
        for r in out:
            x0, y0, x1, y1 = back(r)
            spans = [(float(x), float(x + w)) for x, y, w, h in boxes if y0 <= y + h / 2 <= y1]
            while True:
                hit = [s for s in spans if s[1] >= x0 - policy.gap_x and s[0] <= x1 + policy.gap_x]
                lo, hi = min([x0, *(s[0] for s in hit)]), max([x1, *(s[1] for s in hit)])
                if (lo, hi) == (x0, x1):
                    break
                x0, x1 = lo, hi
            wide.append((max(0, int(np.floor((x0 - policy.line_extra) * sx))), r[1], min(cols, int(np.ceil((x1 + policy.line_extra) * sx))), r[3]))
        out = wide
    return merged(out)


def upscaled(gray: np.ndarray, factor: float) -> np.ndarray:
    """Bicubic (a = -0.5) enlargement for a detector."""
    def weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(m) + 0.5) / factor - 0.5
        base = np.floor(at).astype(int)
        t = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
        w = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        return np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1), w / w.sum(1, keepdims=True)

    out = gray.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at, w = weights(n, int(n * factor))
        out = (np.take(out, at, axis=axis) * (w[:, :, None] if axis == 0 else w[None])).sum(axis + 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def outlined(gray: np.ndarray, rects: list[Rect], colour: tuple[int, int, int] = (255, 0, 0), thick: int = 2) -> np.ndarray:
    """RGB preview with the rectangles drawn."""
    out = np.repeat(gray[:, :, None], 3, 2)
    for x0, y0, x1, y1 in rects:
        keep = out[y0 + thick : y1 - thick, x0 + thick : x1 - thick].copy()
        out[y0:y1, x0:x1] = colour
        if keep.size:
            out[y0 + thick : y1 - thick, x0 + thick : x1 - thick] = keep
    return out


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB image as PNG."""
    import struct
    import zlib

    rows, cols = image.shape[:2]
    raw = np.zeros((rows, 1 + image[0].size), np.uint8)
    raw[:, 1:] = image.reshape(rows, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", cols, rows, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
