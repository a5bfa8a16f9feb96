"""Text detection: the engine contract, the Arrow function around it, and the filters on its hits.

An engine has ``read_batch(images) -> list of lists of (points or None, text, confidence or None)`` for 8-bit images.
``factory`` is a picklable function that builds one; a Python worker builds it once and keeps it, and Spark's task retry
stands for restarts.  A failing detector gives ``detect_status = 'failed'``; with ``fail_closed`` such slices are held back.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.batches import pieces
from veilframe.config import Policy
from veilframe.functions import geometry, text
from veilframe.operators import kernels
from veilframe.schema import HITS

#: Slices that are examined at a time, where small ones would fill a piece by thousands.
PIECE_ROWS = 256

Hit = tuple[list[tuple[float, float]] | None, str, float | None]


class Engine(Protocol):
    def read_batch(self, images: list[np.ndarray]) -> list[list[Hit]]: ...


class LineEngine:
    """A deterministic engine without a model: every line of character-sized components is a hit."""

    def __init__(self, policy: Policy = Policy()):
        self.policy = policy

    def read_batch(self, images: list[np.ndarray]) -> list[list[Hit]]:
        out = []
        for image in images:
            boxes = kernels.character_boxes(image, self.policy)
            hits: list[Hit] = []
            for x0, y0, x1, y1 in kernels.text_lines(boxes, self.policy):
                n = sum(x0 <= x < x1 and y0 <= y < y1 for x, y, _, _ in boxes)
                hits.append(([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], "X" * n, None))
            out.append(hits)
        return out


class Upscaled:
    """An engine that sees enlarged images and reports in the original's coordinates."""

    def __init__(self, inner: Engine, factor: float = 2.0):
        self.inner, self.factor = inner, factor

    def read_batch(self, images: list[np.ndarray]) -> list[list[Hit]]:
        found = self.inner.read_batch([kernels.upscaled(i, self.factor) for i in images])
        return [[(p and [(x / self.factor, y / self.factor) for x, y in p], t, c) for p, t, c in hits] for hits in found]


_ENGINES: dict = {}


def engine_of(factory: Callable[[], Engine]) -> Engine:
    """This worker's engine; a factory that failed is not tried again."""
    key = (factory.__module__, factory.__qualname__)
    if key not in _ENGINES:
        try:
            _ENGINES[key] = factory()
        except Exception as e:  # any failure of foreign code is an outcome here
            _ENGINES[key] = e
    if isinstance(_ENGINES[key], Exception):
        raise _ENGINES[key]
    return _ENGINES[key]


def read_halving(engine: Engine, images: list[np.ndarray]) -> list[list[Hit]]:
    """The batch at once; in halves where memory runs out."""
    try:
        return engine.read_batch(images)
    except Exception as e:
        if len(images) < 2 or not (isinstance(e, MemoryError) or "out of memory" in str(e).lower()):
            raise
        half = len(images) // 2
        return read_halving(engine, images[:half]) + read_halving(engine, images[half:])


def parse_reply(payload: str | dict | None) -> list[Hit]:
    """A model's answer: a text without places, or labels with quadrangles or boxes."""
    clean = lambda s: s.replace("<s>", "").replace("</s>", "").replace("<pad>", "").strip()
    if isinstance(payload, str):
        return [(None, clean(payload), None)] if clean(payload) else []
    if not isinstance(payload, dict):
        return []
    boxes = payload.get("quad_boxes")
    boxes = payload.get("bboxes") if boxes is None else boxes
    out: list[Hit] = []
    for i, label in enumerate(payload.get("labels") or []):
        if t := clean(str(label)):
            n = list(boxes[i]) if boxes is not None and i < len(boxes) else []
            points = None
            if len(n) == 4:
                points = [(n[0], n[1]), (n[2], n[1]), (n[2], n[3]), (n[0], n[3])]
            elif len(n) >= 8 and len(n) % 2 == 0:
                points = list(zip(n[::2], n[1::2], strict=True))
            out.append((points, t, None))
    return out


def examined(slices: DataFrame, factory: Callable[[], Engine], policy: Policy) -> DataFrame:
    """hits, n_components, blank, detect_status of each row of ``slices`` (instance_id, gray binary, rows, cols, burned).

    Only slices that pass the pre-screen reach the engine; the gate is inside, since the optimizer may reorder filters.
    """
    kind = pa.list_(pa.struct([("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("text", pa.string()), ("conf", pa.float64())]))

    def run(batches):
        for b in pieces(batches, "gray", rows=PIECE_ROWS):
            rows = b.to_pylist()
            images = [np.frombuffer(r["gray"], np.uint8).reshape(r["rows"], r["cols"]) if r["gray"] is not None else None for r in rows]
            count = [None if i is None else len(kernels.character_boxes(i, policy)) for i in images]
            go = [k for k, (i, n, r) in enumerate(zip(images, count, rows, strict=True)) if i is not None and (not policy.prescreen or n >= policy.min_components or (r["burned"] and policy.run_on_flagged))]
            hits: list = [[] for _ in rows]
            status = ["no_image" if i is None else "prescreen_skipped" for i in images]
            try:
                found = read_halving(engine_of(factory), [images[k] for k in go]) if go else []
                for k, h in zip(go, found, strict=True):
                    hits[k] = [{"points": p and [{"x": float(x), "y": float(y)} for x, y in p], "text": t, "conf": c} for p, t, c in h]
                    status[k] = "examined"
            except Exception as e:  # a detector's failure must show, not stop the run
                for k in go:
                    status[k] = f"failed: {type(e).__name__}"
            blank = [None if i is None else bool(i.astype(np.float32).std() < policy.blank_std) for i in images]
            yield pa.RecordBatch.from_arrays([b.column("instance_id"), pa.array(hits, kind), pa.array(count, pa.int32()), pa.array(blank), pa.array(status)], ["instance_id", "hits", "n_components", "blank", "detect_status"])

    return slices.select("instance_id", "gray", "rows", "cols", "burned").mapInArrow(run, f"instance_id string, hits {HITS}, n_components int, blank boolean, detect_status string")


def kept_hits(hits: Column, blank: Column, rows: Column, cols: Column, policy: Policy) -> Column:
    """Hits that are confident, plausible, large enough and, where asked, near the border; with their flags."""
    marked = F.transform(hits, lambda h: F.struct(h.points.alias("points"), h.text.alias("text"), h.conf.alias("conf"), text.flags(h.text, blank, policy).alias("flags")))

    def keep(h: Column) -> Column:
        ok = geometry.confident(h.conf, policy) & text.plausible(h.text, policy) & geometry.big_enough(h.points, policy)
        if policy.border_only:
            ok = ok & geometry.in_border(h.points, rows, cols, policy)
        return ok & (F.size(h.flags) == 0) if policy.drop_suspect else ok

    return F.filter(marked, keep)


def decided(slices: DataFrame, policy: Policy) -> DataFrame:
    """What becomes of each slice, from hits, blank, detect_status, burned, want, rows and cols."""
    d = slices.withColumn("hits", F.coalesce(F.when(F.col("want"), F.col("hits")), F.array().cast(HITS)))
    d = d.withColumn("kept", kept_hits(F.col("hits"), F.col("blank"), F.col("rows"), F.col("cols"), policy))
    boxed = F.filter("kept", lambda h: h.points.isNotNull())
    d = d.withColumn("has_text", F.coalesce(F.size("kept") > 0, F.lit(False))).withColumn("boxed", boxed).withColumn("boxless_hits", F.greatest(F.size("kept") - F.size("boxed"), F.lit(0)))
    act, forced, strategy = geometry.action(F.size("boxed"), F.col("boxless_hits"), policy)
    d = d.withColumn("act", act).withColumn("forced_keep", forced & F.col("has_text")).withColumn("strategy", strategy)
    rects = F.filter(F.transform("boxed", lambda h: geometry.box_rect(h.points, F.col("rows"), F.col("cols"), policy)), lambda r: r.isNotNull())
    band = F.when((F.col("boxless_hits") > 0) & (F.col("strategy") == "border_band"), geometry.border_band(F.col("rows"), F.col("cols"), policy))
    d = d.withColumn("seed_rects", rects).withColumn("rects", F.when(F.col("has_text") & (F.col("act") == "redact"), F.concat(rects, F.coalesce(band, F.slice(rects, 1, 0)))).otherwise(F.slice(rects, 1, 0)))
    failed = F.coalesce(F.col("detect_status").startswith("failed"), F.lit(False)) & F.col("want")
    d = d.withColumn("held", failed & F.lit(policy.fail_closed))
    d = d.withColumn("decision", F.when(F.col("has_text"), geometry.decision(F.col("act"), F.size("rects"), policy)))
    d = d.withColumn("bucket", geometry.bucket(F.col("want"), F.col("has_text"), F.col("detect_status") != "no_image", F.col("detect_status") == "prescreen_skipped"))
    d = d.withColumn("hit_text", F.when(F.col("has_text"), text.joined_hits(F.transform("kept", lambda h: h.text)))).withColumn("hit_conf", F.array_max(F.transform("kept", lambda h: h.conf)))
    return d.withColumn("hit_bbox", F.to_json(F.get("boxed", F.lit(0)).points)).withColumn("n_redacted_regions", F.size("rects")).drop("act", "strategy", "boxed")
