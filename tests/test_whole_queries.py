"""Queries over whole tables and texts, against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from compare import differences
from veilframe.config import Policy
from veilframe.functions import text
from veilframe.plans import catalog, raster_queries

SF = "/root/testdata/sf0.001"


def areas(mask):
    """Sizes of the 8-connected components by flooding."""
    left, out = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(n)
    return out


def test_largest_component_of_every_image(spark, tmp_path):
    snake = [[c % 2 == 0 or r == (7 if c % 4 == 1 else 0) for c in range(8)] for r in range(8)]
    made = [(10**6, [-0.1 if x else 0.1 for row in snake for x in row]), (10**6 + 1, [0.1] * 64), (10**6 + 2, [-0.1] * 64)]
    real = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    real.union(spark.createDataFrame(made, real.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    want = {}
    for r in rows:
        a = areas(np.trunc(np.array(r.embedding, np.float64) * 2500).reshape(8, 8) <= 0)
        want[r.vec_id] = (max(a, default=0), len(a))
    got = {r.vec_id: (r.area, r.n_components) for r in catalog.QUERIES["largest_component"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v[1]} and len(got) > 150


def test_whole_texts(spark, tmp_path):
    made = [(14 * i, t) for i, t in enumerate(["ab " * 300 + "-" * 10 + " cd", "ab " * 300 + "-" * 9 + " cd", "x" * 10, "ab " * 300 + "\n" * 10 + "c", "", None, "... " * 200 + "a b", "... " * 200 + "a"], 1)]
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    real.filter("doc_id > 200 OR doc_id % 14 <> 0").union(spark.createDataFrame(made, real.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    runs = {r.doc_id: r.run for r in catalog.QUERIES["char_runs"](spark, str(tmp_path)).collect()}
    plausible = {r.doc_id: r.plausible for r in catalog.QUERIES["text_plausible"](spark, str(tmp_path)).collect()}
    assert [runs[i] for i, _ in made] == [True, False, True, False, False, False, False, False]
    assert [plausible[i] for i, _ in made] == [True, True, True, True, False, False, True, False]
    for r in rows:
        s = r.text and r.text + chr(97 + r.doc_id % 26) * (r.doc_id % 14)
        assert runs[r.doc_id] == any(len(set(g)) == 1 and g[0] != "\n" for g in (s[i : i + 10] for i in range(len(s or "") - 9)))


def test_runs_of_line_ends_and_without_an_id(spark, tmp_path):
    """only line feeds are no run; a row without an id keeps the runs of its text."""
    texts = ["a" + c * 10 + "b" for c in "\r\u0085\u2028\u2029\n\x0b\0\u0301\U0001f600"] + ["\r\n" * 10]
    made = [(14 * i, t) for i, t in enumerate(texts, 1)] + [(None, "z" * 10), (None, "z" * 9), (None, None), (27, "a" * 9 + "b"), (24, "")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = tmp_path / "duck"
    duck.mkdir()
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in made], pa.int64()), "text": [t for _, t in made]}), duck / "documents.parquet")
    assert differences(catalog.QUERIES["char_runs"](spark, str(tmp_path)), str(duck), catalog.ORACLES["char_runs"]) == ""
    talks = [(i, i % 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(talks, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pq.write_table(pa.table({"conv_id": [i for i, _, _ in talks], "turn": pa.array([n for _, n, _ in talks], pa.int32()), "text": texts}), duck / "conversations.parquet")
    assert differences(catalog.QUERIES["hallucination_drop"](spark, str(tmp_path)), str(duck), catalog.ORACLES["hallucination_drop"]) == ""


def test_plausible_counts_letters_and_digits(spark):
    """against counting, with other bounds too."""
    texts = ["", None, "a", "a1", "-a-", "-a-\n-1-", "\u00e4\u00f6", "a\u00e4\r\nb", "." * 5000 + "a", "." * 5000 + "a" + "." * 5000 + "b", "abc"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(5):
        got = [r.p for r in d.select(text.plausible(F.col("t"), Policy(min_alnum=n)).alias("p")).collect()]
        assert got == [sum(c.isascii() and c.isalnum() for c in t or "") >= n for t in texts]
    plan = d.select(text.plausible(F.col("t"), Policy()).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan, plan


def opened(a, k):
    """Grey opening by a k x k square, by loops; what lies outside doesn't count."""
    before, after = k // 2, k - 1 - k // 2

    def window(a, pick):
        rows = [[pick(a[y, max(0, x - before) : x + after + 1]) for x in range(a.shape[1])] for y in range(a.shape[0])]
        rows = np.array(rows)
        return np.array([[pick(rows[max(0, y - before) : y + after + 1, x]) for x in range(a.shape[1])] for y in range(a.shape[0])])

    return window(window(a, np.min), np.max)


def threshold(gray):
    """The first level of greatest variance between classes."""
    best, at = 0.0, 0
    for t in range(256):
        low, high = gray[gray <= t], gray[gray > t]
        if len(low) and len(high):
            v = len(low) * len(high) * (low.mean() - high.mean()) ** 2 / gray.size**2
            if v > best * (1 + 1e-9):
                best, at = v, t
    return at


def boxes_of(mask, policy):
    left, out = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, own = [left.pop()], []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        ys, xs = [r for r, _ in own], [c for _, c in own]
        h, w = max(ys) - min(ys) + 1, max(xs) - min(xs) + 1
        if policy.char_height[0] <= h <= policy.char_height[1] and policy.char_width[0] <= w <= policy.char_width[1] and len(own) >= policy.char_area:
            out.append((min(xs), min(ys), w, h))
    return out


def lines_of(boxes, policy):
    """Number of lines: rows by running means of centres, cut at gaps."""
    rows = []
    for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0])):
        fit = [r for r in rows if abs(y + h / 2 - sum(r["centres"]) / len(r["centres"])) <= policy.gap_y + max(r["heights"]) / 2]
        row = fit[0] if fit else {"centres": [], "heights": [], "spans": []}
        if not fit:
            rows.append(row)
        row["centres"].append(y + h / 2)
        row["heights"].append(h)
        row["spans"].append((x, x + w))
    n = 0
    for row in rows:
        runs, end = [0], None
        for x, z in sorted(row["spans"]):
            runs = [*runs, 0] if end is not None and x - end > policy.gap_x else runs
            runs[-1] += 1
            end = z
        n += sum(k >= policy.line_chars for k in runs)
    return n


def test_text_components_by_loops(spark, tmp_path):
    """Every stage of the query anew, on the first images."""
    policy = raster_queries.POLICY
    real = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(12)
    real.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for r in real.collect():
        a = np.trunc(np.array(r.embedding, np.float64) * 2500).reshape(8, 8).astype(np.float32)
        gray = ((a - a.min()) / (a.max() - a.min() if a.max() > a.min() else 1) * 255).clip(0, 255).astype(np.uint8)
        gray = gray.repeat(8, 0).repeat(8, 1).astype(int)
        hat = gray - opened(gray, policy.tophat)
        boxes = boxes_of(hat > threshold(hat), policy) if hat.max() >= 1 else []
        want[r.vec_id] = (len(boxes), lines_of(boxes, policy))
    got = {r.vec_id: (r.n_boxes, r.n_lines) for r in catalog.QUERIES["text_components"](spark, str(tmp_path)).collect()}
    assert got == want and any(b for b, _ in want.values())
