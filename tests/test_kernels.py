"""Numpy kernels against plain loops."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from veilframe.config import Policy
from veilframe.operators import detect, kernels

P = Policy()
masks = arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9)), elements=st.integers(0, 1))


def flood(mask):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if lab[y, x]:
            continue
        n += 1
        todo = deque([(y, x)])
        lab[y, x] = n
        while todo:
            a, b = todo.popleft()
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not lab[c, d]:
                        lab[c, d] = n
                        todo.append((c, d))
    return lab, n


@settings(max_examples=150, deadline=None)
@given(masks)
def test_labels(mask):
    lab, n = kernels.labels8(mask)
    want, m = flood(mask)
    assert n == m and (lab == want).all()
    big = kernels.largest_component(mask)
    assert big.sum() == (np.bincount(want.ravel())[1:].max() if m else 0) and (big <= mask).all()


@settings(max_examples=80, deadline=None)
@given(masks, arrays(np.int16, (9, 9), elements=st.integers(0, 400)), st.integers(1, 9))
def test_growth(seed, hu, k):
    hu = hu[: seed.shape[0], : seed.shape[1]]
    seed = seed * (hu < 250)
    got = kernels.grown(seed, hu, k, 250)
    dist = np.full(seed.shape, 99)
    todo = deque((y, x) for y, x in zip(*np.nonzero(seed)))
    for y, x in todo:
        dist[y, x] = 0
    while todo:
        y, x = todo.popleft()
        for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= a < seed.shape[0] and 0 <= b < seed.shape[1] and hu[a, b] < 250 and dist[a, b] == 99:
                dist[a, b] = dist[y, x] + 1
                todo.append((a, b))
    assert (got == (dist <= -(-k // 2))).all()
    # what grew is connected to the seed, so keeping touching components or boosting the front changes nothing
    assert (kernels.touching(got, seed) == got).all() or not seed.any()


def test_growth_stops_at_a_thin_barrier():
    hu = np.zeros((9, 9), int)
    hu[:, 4] = 250
    seed = np.zeros((9, 9), np.uint8)
    seed[4, 0] = 1
    assert kernels.grown(seed, hu, 99, 250)[:, :4].all() and not kernels.grown(seed, hu, 99, 250)[:, 4:].any()


def test_surface_and_fill_modes():
    hu = np.full((12, 12), -1000)
    hu[3:9, 3:9] = 20
    hu[4:8, 4:8] = 300
    out, mask = kernels.without_surface(hu, 20, P)
    assert (out[4:8, 4:8] == 300).all() and (out[hu < 250] == -1000).all() and mask.sum() == 144 - 16
    sample, _ = kernels.without_surface(hu, 20, Policy(surface_fill="sample"))
    assert set(np.unique(sample)) == {20, 300}
    rects = [(0, 0, 2, 1), (10, 10, 99, 99)]
    assert kernels.redacted(hu, rects, Policy(fill="min"))[0, 0] == -1000 and kernels.redacted(hu, [(4, 4, 5, 5)], Policy(fill="77"))[4, 4] == 77 and kernels.redacted(hu, [(4, 4, 5, 5)], Policy(fill="?"))[4, 4] == -1000


@settings(max_examples=40, deadline=None)
@given(arrays(np.uint8, (11, 13), elements=st.integers(0, 255)), st.sampled_from([3, 4, 5]))
def test_top_hat(gray, k):
    before, after = k // 2, k - 1 - k // 2

    def window(a, pick):
        return np.array([[pick(a[max(0, y - before) : y + after + 1, max(0, x - before) : x + after + 1]) for x in range(a.shape[1])] for y in range(a.shape[0])])

    assert (kernels.top_hat(gray, k) == gray - window(window(gray, np.min), np.max)).all()


def test_otsu():
    rng = np.random.default_rng(1)
    gray = np.concatenate((rng.normal(60, 8, 4000), rng.normal(180, 10, 1500))).clip(0, 255).astype(np.uint8)
    best = max(range(255), key=lambda t: (gray <= t).mean() * (gray > t).mean() * (gray[gray <= t].mean() - gray[gray > t].mean()) ** 2 if (gray <= t).any() and (gray > t).any() else 0)
    assert abs(kernels.otsu(gray) - best) <= 1


def strokes(n, y=10, x=10, gap=6, h=9):
    a = np.zeros((80, 120), np.uint8)
    for i in range(n):
        a[y : y + h, x + i * gap : x + i * gap + 3] = 250
    return a


def test_lines_and_engine():
    image = np.maximum(strokes(4), strokes(3, y=60, x=20))
    boxes = kernels.character_boxes(image, P)
    assert len(boxes) == 7 and kernels.text_lines(boxes, P) == [(10, 10, 31, 19), (20, 60, 35, 69)]
    assert kernels.text_lines(boxes[:1], P) == [] and kernels.character_boxes(np.zeros((5, 5), np.uint8), P) == []
    far = np.maximum(strokes(2), strokes(2, x=80))
    assert len(kernels.text_lines(kernels.character_boxes(far, P), P)) == 2
    (hits,) = detect.LineEngine().read_batch([image])
    assert [t for _, t, _ in hits] == ["XXXX", "XXX"]
    (up,) = detect.Upscaled(detect.LineEngine()).read_batch([image])
    assert np.allclose(np.array(up[0][0]), np.array(hits[0][0]), atol=1.5)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 6), st.integers(1, 6)), max_size=12))
def test_merged(raw):
    rects = [(x, y, x + w, y + h) for x, y, w, h in raw]
    out = kernels.merged(rects)
    touch = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    assert not any(touch(a, b) for i, a in enumerate(out) for b in out[:i])
    assert all(any(o[0] <= r[0] and o[1] <= r[1] and o[2] >= r[2] and o[3] >= r[3] for o in out) for r in rects)


def test_swept_geometry():
    image = strokes(6)
    wide = kernels.swept_rects([(12, 11, 20, 18)], image, image.shape, Policy(exact=False))
    assert len(wide) == 1 and wide[0][0] <= 10 and wide[0][2] >= 43
    assert kernels.swept_rects([], image, image.shape, Policy(exact=False, sweep=False)) == []


def test_gray_and_values():
    frames = np.arange(24).reshape(2, 3, 4)
    assert (kernels.to_gray8(frames) == kernels.to_gray8(frames[0])).all() and (kernels.to_gray8(frames[0], inverted=True) == 255 - kernels.to_gray8(frames[0])).all()
    rgb = np.zeros((2, 2, 3), np.uint16)
    rgb[0, 0] = (510, 0, 0)
    assert kernels.to_gray8(rgb, samples=3)[0, 0] == 76 and kernels.to_gray8(np.full((3, 3), 7)).max() == 0
    assert kernels.to_hu(np.array([-2000, 10, 32767], np.int16), 1.0, -1024).tolist() == [-1024, -1014, 31743] and kernels.to_hu(np.array([10]), 0.25, 0).tolist() == [2]
    assert kernels.to_stored(np.array([-1000, 5]), 2.0, -1024).tolist() == [12, 514] and kernels.to_stored(np.array([5]), 0.0, 1).tolist() == [4]
    assert kernels.anterior_mask((5, 5), 0, 1)[4].all() and not kernels.anterior_mask((5, 5), 0, 1)[0].any() and kernels.anterior_mask((5, 5), 1, -1)[:, 0].all()


def test_previews():
    view = kernels.outlined(np.zeros((20, 20), np.uint8), [(2, 2, 18, 18)])
    assert tuple(view[2, 2]) == (255, 0, 0) and not view[10, 10].any()
    data = kernels.png(view)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) == 20 * 61


def test_engine_halves_batches_and_parses_replies():
    class Small:
        def read_batch(self, images):
            if len(images) > 2:
                raise MemoryError
            return [[(None, str(i), None)] for i in images]

    assert [h[0][1] for h in detect.read_halving(Small(), list(range(7)))] == [str(i) for i in range(7)]
    with pytest.raises(ValueError):
        detect.read_halving(type("E", (), {"read_batch": lambda self, i: (_ for _ in ()).throw(ValueError("x"))})(), [1, 2])
    assert detect.parse_reply("<s>hi</s>") == [(None, "hi", None)] and detect.parse_reply(None) == [] and detect.parse_reply(" ") == []
    got = detect.parse_reply({"labels": ["a", "", "b", "c"], "quad_boxes": [[0, 0, 1, 1, 2, 2, 3, 3], [1], [1, 2, 3, 4]]})
    assert got == [([(0, 0), (1, 1), (2, 2), (3, 3)], "a", None), ([(1, 2), (3, 2), (3, 4), (1, 4)], "b", None), (None, "c", None)]
