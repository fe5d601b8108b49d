"""Raster operators: images are rows of a binary column; pixels are read once, in Arrow batches, and only counts and boxes come back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUADRANTS = ("top-left", "top-right", "bottom-left", "bottom-right")
LEAST_COMPONENT = 100
SHAPE = "width int, height int, color string, pixels int, quadrant string, component int, x0 int, y0 int, x1 int, y1 int"


def parse_ppm(data: bytes) -> np.ndarray:
    """(height, width, 3) of a plain PPM (P3); comments are dropped, sizes and ranges checked."""
    fields = b" ".join(line.split(b"#", 1)[0] for line in data.splitlines()).split()
    if not fields or fields[0] != b"P3":
        raise ValueError("not a P3 image")
    width, height, top = (int(x) for x in fields[1:4])
    values = np.array(fields[4:], np.int64)
    if width <= 0 or height <= 0 or not 0 < top < 65536 or len(values) != 3 * width * height or (len(values) and (values.min() < 0 or values.max() > top)):
        raise ValueError("size or values of the image are wrong")
    return values.reshape(height, width, 3)


def largest_component(mask: np.ndarray) -> tuple[int, int, int, int, int]:
    """Pixels and box (x0, y0, x1, y1, inclusive) of the largest 4-connected component, the first of equals; zeros if there is none.

    Runs of each line are joined to those they touch in the line above.
    """
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    runs, before = [], []
    for y, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(np.int8), [0]))))
        now = []
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(parent)
            parent.append(k)
            for a, b, other in before:
                if a < e and s < b:
                    x, z = sorted((find(k), find(other)))
                    parent[z] = x
            now.append((s, e, k))
            runs.append((y, s, e, k))
        before = now
    boxes: dict[int, list[int]] = {}
    for y, s, e, k in runs:
        box = boxes.setdefault(find(k), [0, s, y, e - 1, y])
        box[0] += e - s
        box[1], box[2], box[3], box[4] = min(box[1], s), min(box[2], y), max(box[3], e - 1), max(box[4], y)
    return tuple(max(boxes.values(), key=lambda b: b[0])) if boxes else (0, 0, 0, 0, 0)


def describe(images: DataFrame, colors: dict[str, tuple[int, int, int]], image: str = "image_id", data: str = "data") -> DataFrame:
    """image, width, height, and for each named colour that occurs: pixels, dominant quadrant (the first of equals), largest component and its box."""
    kind = images.schema[image].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(image).to_pylist(), batch.column(data).to_pylist()):
                if raw is None:
                    continue
                px = parse_ppm(raw)
                h, w = px.shape[:2]
                for name, rgb in colors.items():
                    mask = (px == rgb).all(2)
                    if not mask.any():
                        continue
                    y, x = np.nonzero(mask)
                    quarter = np.bincount(2 * (y >= h / 2) + (x >= w / 2), minlength=4)
                    n, x0, y0, x1, y1 = largest_component(mask)
                    rows.append((i, w, h, name, int(mask.sum()), QUADRANTS[int(quarter.argmax())], n, x0, y0, x1, y1))
            names = [image, "width", "height", "color", "pixels", "quadrant", "component", "x0", "y0", "x1", "y1"]
            ints = {n: pa.int32() for n in names if n not in (image, "color", "quadrant")}
            types = [batch.schema.field(image).type if n == image else ints.get(n, pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return images.select(image, data).mapInArrow(run, f"{image} {kind}, {SHAPE}")


def region(d: DataFrame) -> DataFrame:
    """d (of describe) with region: where the centre of the largest component lies, in thirds; null for a component that is too small."""
    third = lambda lo, hi, n, names: F.when((F.col(lo) + F.col(hi)) / 2 < F.col(n) / 3, names[0]).when((F.col(lo) + F.col(hi)) / 2 >= 2 * F.col(n) / 3, names[2]).otherwise(names[1])
    name = F.concat_ws("-", third("y0", "y1", "height", ("top", "middle", "bottom")), third("x0", "x1", "width", ("left", "center", "right")))
    return d.withColumn("region", F.when(F.col("component") >= LEAST_COMPONENT, name))


def is_wide(ratio: float = 1.5) -> Column:
    return (F.col("x1") - F.col("x0") + 1) >= ratio * (F.col("y1") - F.col("y0") + 1)


def visual_rank(d: DataFrame, text: DataFrame, color: str, quadrant: str | None = None, k: int = 3, weight: float = 0.6) -> DataFrame:
    """image_id, score, rank: weight for images whose colour matches, the rest for their text score (image_id, score) over the best one."""
    hit = F.col("color") == color
    if quadrant:
        hit = hit & (F.col("quadrant") == quadrant)
    seen = d.groupBy("image_id").agg(F.max(hit.cast("double")).alias("visual"))
    best = text.agg(F.max("score").alias("top"))
    s = seen.join(text, "image_id", "left").crossJoin(best).select("image_id", (weight * F.col("visual") + (1 - weight) * F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0))).alias("score"))
    return s.where("score > 0").orderBy(F.desc(F.round("score", 9)), "image_id").limit(k).withColumn("rank", F.row_number().over(_by_score()))


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc(F.round("score", 9)), "image_id")
