"""Raster kernels on embeddings as 8 x 8 images: HU = trunc(2500 * value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import geometry, raster
from veilframe.operators import detect, kernels
from veilframe.plans.registry import query, t

POLICY = Policy()
HU = "SELECT vec_id, list_transform(embedding, lambda v: trunc(CAST(v AS DOUBLE) * 2500)::INTEGER) AS hu FROM embeddings"
#: 8 x 8 images magnified eightfold have components of a character's size.
SIDE, ZOOM = 8, 8


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v.cast("double") * 2500).cast("int")).alias("hu"))


@query(f"""
WITH r AS (SELECT vec_id, (vec_id % 3 + 1) / 2.0 AS slope, list_transform(hu, lambda x: CASE WHEN x - 1100 <= -2000 THEN 0 ELSE x - 1100 END) AS raw FROM ({HU}))
SELECT vec_id, list_transform(raw, lambda x: (((CASE WHEN slope = 1 THEN x ELSE trunc(x * slope)::BIGINT END - 1024 + 32768) % 65536 + 65536) % 65536 - 32768)::INTEGER) AS out FROM r
""")
def hu_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform("hu", lambda x: x - 1100)
    return images(spark, sf_dir).select("vec_id", raster.hounsfield(raw, (F.col("vec_id") % 3 + 1) / 2.0, F.lit(-1024)).alias("out"))


@query(f"SELECT vec_id, list_transform(hu, lambda x: trunc((x + 1024) / ((vec_id % 3 + 1) / 2.0))::INTEGER) AS out FROM ({HU})")
def hu_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("vec_id", raster.stored(F.col("hu"), (F.col("vec_id") % 3 + 1) / 2.0, F.lit(-1024)).alias("out"))


GRAY = f"SELECT vec_id, hu, list_transform(hu, lambda x: least(greatest(trunc((x - list_min(hu)) / (CASE WHEN list_max(hu) <= list_min(hu) THEN 1.0 ELSE (list_max(hu) - list_min(hu))::DOUBLE END) * 255)::INTEGER, 0), 255)) AS gray FROM ({HU})"


@query(f"SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN list_transform(gray, lambda x: 255 - x) ELSE gray END AS gray FROM ({GRAY})")
def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("vec_id", raster.gray8(F.col("hu"), F.col("vec_id") % 2 == 1).alias("gray"))


@query(f"SELECT vec_id, list_transform(hu, lambda x: trunc(least(greatest((x + 275) / 350.0, 0), 1) * 255)::INTEGER) AS gray FROM ({HU})")
def window8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("vec_id", raster.window8(F.col("hu")).alias("gray"))


@query(f"SELECT vec_id, list_sum(list_transform(hu, lambda x: CASE WHEN x <= -800 THEN 1 ELSE 0 END))::BIGINT AS n_air, list_transform(hu, lambda x: CASE WHEN x <= -800 THEN 1 ELSE 0 END) AS mask FROM ({HU})")
def air_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).withColumn("mask", raster.air_mask(F.col("hu"), POLICY.air))
    return d.select("vec_id", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_air"), "mask")


@query(f"""
WITH m AS (SELECT vec_id, hu, list_sum(hu) / 64.0 AS mean FROM ({HU}))
SELECT vec_id, round(sqrt(list_sum(list_transform(hu, lambda x: (x - mean) * (x - mean))) / 64), 6) AS deviation, sqrt(list_sum(list_transform(hu, lambda x: (x - mean) * (x - mean))) / 64) < 3 AS blank FROM m
""")
def blank_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).withColumn("s", raster.deviation(F.col("hu")))
    return d.select("vec_id", F.round("s", 6).alias("deviation"), (F.col("s") < POLICY.blank_std).alias("blank"))


@query(f"""
SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i // 8 >= 1 AND i // 8 < 2 + vec_id % 6 AND i % 8 >= 2 AND i % 8 < 5 THEN -1000 ELSE hu[i + 1] END) AS out FROM ({HU})
""")
def rect_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.struct(F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.lit(5).alias("x1"), (2 + F.col("vec_id") % 6).cast("int").alias("y1"))
    d = images(spark, sf_dir).withColumn("r", r)
    return d.select("vec_id", raster.filled(F.col("hu"), SIDE, F.col("r"), F.lit(-1000)).alias("out"))


def each_image(spark: SparkSession, sf_dir: str, work, schema: str) -> DataFrame:
    """``work(image)`` -> a dict of further columns, for every image as an int array of 8 x 8."""

    def run(batches):
        for b in batches:
            rows = [{"vec_id": i} | work(np.array(h, np.int32).reshape(SIDE, SIDE)) for i, h in zip(b.column("vec_id").to_pylist(), b.column("hu").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in rows[0]})

    return images(spark, sf_dir).mapInArrow(run, f"vec_id long, {schema}")


@query(f"""
WITH RECURSIVE px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, i FROM (SELECT vec_id, hu, unnest(range(64)) AS i FROM ({HU})) WHERE hu[i + 1] <= 0),
reach AS (SELECT vec_id, i, r, c, i AS root FROM px
  UNION SELECT p.vec_id, p.i, p.r, p.c, reach.root FROM reach JOIN px p ON p.vec_id = reach.vec_id AND abs(p.r - reach.r) <= 1 AND abs(p.c - reach.c) <= 1),
lab AS (SELECT vec_id, i, min(root) AS root FROM reach GROUP BY ALL), area AS (SELECT vec_id, root, count(*) AS n FROM lab GROUP BY ALL)
SELECT vec_id, max(n) AS area, count(*) AS n_components FROM area GROUP BY 1
""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the largest 8-connected component of HU <= 0, in every image."""
    work = lambda a: {"area": int(kernels.largest_component(a <= 0).sum()), "n_components": kernels.labels8(a <= 0)[1]}
    return each_image(spark, sf_dir, work, "area long, n_components long").filter("n_components > 0")


@query(f"""
WITH RECURSIVE px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, hu[i + 1] AS v FROM (SELECT vec_id, hu, unnest(range(64)) AS i FROM ({HU}))),
reach AS (SELECT vec_id, r, c, 0 AS step FROM px WHERE r = 0 AND v < 250
  UNION SELECT p.vec_id, p.r, p.c, reach.step + 1 FROM reach JOIN px p ON p.vec_id = reach.vec_id AND abs(p.r - reach.r) + abs(p.c - reach.c) = 1 WHERE p.v < 250 AND reach.step < 4)
SELECT vec_id, count(DISTINCT r * 8 + c) AS area FROM reach GROUP BY 1
""")
def geodesic_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of four steps from the first row's soft pixels, stopped by bone."""

    def work(a: np.ndarray) -> dict:
        seed = np.zeros(a.shape, np.uint8)
        seed[0] = a[0] < 250
        return {"area": int(kernels.grown(seed, a, 8, 250).sum())}

    return each_image(spark, sf_dir, work, "area long").filter("area > 0")


@query(f"""
WITH RECURSIVE px AS (SELECT vec_id, i, i // 8 AS r, i % 8 AS c, hu[i + 1] AS v FROM (SELECT vec_id, hu, unnest(range(64)) AS i FROM ({HU}))),
air AS (SELECT * FROM px WHERE v <= {POLICY.air}),
reach AS (SELECT vec_id, i, r, c, i AS root FROM air
  UNION SELECT p.vec_id, p.i, p.r, p.c, reach.root FROM reach JOIN air p ON p.vec_id = reach.vec_id AND abs(p.r - reach.r) <= 1 AND abs(p.c - reach.c) <= 1),
lab AS (SELECT vec_id, i, r, c, min(root) AS root FROM reach GROUP BY ALL),
top AS (SELECT vec_id, root FROM (SELECT vec_id, root, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, root) AS place FROM lab GROUP BY vec_id, root) WHERE place = 1),
grow AS (SELECT vec_id, r, c, 0 AS step FROM lab JOIN top USING (vec_id, root)
  UNION SELECT p.vec_id, p.r, p.c, grow.step + 1 FROM grow JOIN px p ON p.vec_id = grow.vec_id AND abs(p.r - grow.r) + abs(p.c - grow.c) = 1 WHERE p.v < {POLICY.bone} AND grow.step < 3),
mask AS (SELECT DISTINCT vec_id, r, c FROM grow)
SELECT vec_id, count(mask.r) AS n_masked, count(*) FILTER (mask.r IS NOT NULL AND v <> {POLICY.air_value}) AS n_changed, sum(CASE WHEN mask.r IS NULL THEN v ELSE {POLICY.air_value} END)::BIGINT AS total
FROM px LEFT JOIN mask USING (vec_id, r, c) GROUP BY 1
""")
def surface_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface removal of every image: pixels overwritten and a checksum of the result."""

    def work(a: np.ndarray) -> dict:
        out, mask = kernels.without_surface(a, 5, POLICY)
        return {"n_masked": int(mask.sum()), "n_changed": int((out != a).sum()), "total": int(out.sum())}

    return each_image(spark, sf_dir, work, "n_masked long, n_changed long, total long")


def zoomed(a: np.ndarray) -> np.ndarray:
    return np.kron(kernels.to_gray8(a), np.ones((ZOOM, ZOOM), np.uint8))


@query()
def text_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-sized components and text lines of magnified images."""

    def work(a: np.ndarray) -> dict:
        boxes = kernels.character_boxes(zoomed(a), POLICY)
        return {"n_boxes": len(boxes), "n_lines": len(kernels.text_lines(boxes, POLICY))}

    return each_image(spark, sf_dir, work, "n_boxes long, n_lines long")


@query()
def rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of text lines, widened and merged."""

    def work(a: np.ndarray) -> dict:
        image = zoomed(a)
        lines = kernels.text_lines(kernels.character_boxes(image, POLICY), POLICY)
        rects = kernels.swept_rects(lines, image, image.shape, Policy(exact=False))
        return {"n_rects": len(rects), "covered": int(sum((r[2] - r[0]) * (r[3] - r[1]) for r in rects))}

    return each_image(spark, sf_dir, work, "n_rects long, covered long")


@query()
def detect_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and decisions on magnified images with the engine that needs no model."""

    def run(batches):
        for b in (b.slice(at, detect.PIECE_ROWS) for b in batches for at in range(0, b.num_rows, detect.PIECE_ROWS)):
            gray = [zoomed(np.array(h, np.int32).reshape(SIDE, SIDE)).tobytes() for h in b.column("hu").to_pylist()]
            yield pa.RecordBatch.from_pydict({"instance_id": [str(i) for i in b.column("vec_id").to_pylist()], "gray": gray})

    n = SIDE * ZOOM
    facts = {"rows": F.lit(n), "cols": F.lit(n), "burned": F.col("instance_id").endswith("0")}
    slices = images(spark, sf_dir).mapInArrow(run, "instance_id string, gray binary").withColumns(facts)
    # the side that only says what is asked has no pixels and no Python; a missing id is Python's word for it on both sides
    d = t(spark, sf_dir, "embeddings").select(F.coalesce(F.col("vec_id").cast("string"), F.lit("None")).alias("instance_id")).withColumns(facts)
    d = d.withColumn("want", geometry.wanted(F.col("burned"), F.lit(True), POLICY))
    d = d.join(detect.examined(slices, detect.LineEngine, POLICY), "instance_id", "left")
    d = detect.decided(d, POLICY)
    return d.select("instance_id", "detect_status", "bucket", "decision", "boxless_hits", "n_redacted_regions", "hit_text", F.to_json("rects").alias("rects"))
