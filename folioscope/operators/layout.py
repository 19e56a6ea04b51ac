"""Layout of pages: roles, rows and reading order, rectangles, rasters and foreground measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_role(kind: Column) -> Column:
    """primary, deleted, visual or other, by the type's name without case and hyphens."""
    name = F.regexp_replace(F.lower(kind), "-", "_")
    return F.when(name.isin("txtblock", "txt_block"), "primary").when(name == "deleted_text_block", "deleted").when(name.isin("figure", "chart", "table"), "visual").otherwise("other")


def interference_level(ratio: Column) -> Column:
    return F.when(ratio <= 0, "zero").when(ratio < 0.03, "low").when(ratio < 0.06, "medium").otherwise("high")


def segments(values: Column, step: float) -> Column:
    """How many rows or columns sorted centres fall into; a new one begins more than step past the beginning of the last."""
    state = F.struct(F.lit(float("-inf")).alias("start"), F.lit(0).alias("n"))
    move = lambda s, v: F.when(v - s["start"] > step, F.struct(v.alias("start"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(values), state, move, lambda s: s["n"])


def reading_order(rows: DataFrame, page: str, order: Column, cy: Column, cx: Column) -> DataFrame:
    """Of each page the pairs read against the order of (cy, cx), their share, and the mean jump; a page's few blocks meet in one row."""
    place = W.partitionBy(page)
    ranked = rows.select(page, order.alias("o"), F.row_number().over(place.orderBy(cy, cx, order)).alias("r"))
    seq = ranked.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("s"))
    later = F.transform("s", lambda r, i: F.size(F.filter(F.slice("s", i + 2, F.size("s")), lambda x: x < r)))
    jumps = F.transform(F.slice("s", 2, F.size("s")), lambda r, i: F.abs(r - F.get("s", i) - 1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size("s").cast("long")
    return seq.select(page, n.alias("blocks"), total(later).alias("inversions"), F.when(n > 1, total(later) / (n * (n - 1) / 2)).otherwise(0.0).alias("inversion_share"), F.when(n > 1, total(jumps) / (n - 1)).otherwise(0.0).alias("mean_jump"))


def deduplicated_boxes(rows: DataFrame, image: str, order: str, min_iou: float = 0.95, near: float = 0.02) -> DataFrame:
    """(image, order, kept): a box goes if a kept earlier one of its label covers the same place; sequential within an image's few boxes.

    Boxes are compared for many images at once, each with the one so many places before it; a null image is one too.
    """

    def solve(frame: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        label = pd.factorize(frame["label"], use_na_sentinel=False)[0]
        x0, y0, x1, y1 = (frame[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        place = np.arange(len(frame)) - start
        late, early, i, back = [], [], np.flatnonzero(place >= 1), 1
        with np.errstate(invalid="ignore", over="ignore"):
            while len(i):
                j = i - back
                a = i[(np.abs((x0[i] + x1[i]) - (x0[j] + x1[j])) / 2 <= near) & (label[i] == label[j])]
                b = a - back
                inter = np.maximum(np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), 0) * np.maximum(np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b]), 0)
                union = (x1[a] - x0[a]) * (y1[a] - y0[a]) + (x1[b] - x0[b]) * (y1[b] - y0[b]) - inter
                close = (np.abs((y0[a] + y1[a]) - (y0[b] + y1[b])) / 2 <= near) & (np.abs((x1[a] - x0[a]) - (x1[b] - x0[b])) <= near) & (np.abs((y1[a] - y0[a]) - (y1[b] - y0[b])) <= near)
                same = close & (union > 0) & (inter / np.where(union > 0, union, 1) >= min_iou)
                late.append(a[same])
                early.append(b[same])
                back += 1
                i = i[place[i] >= back]
        kept = np.ones(len(frame), bool)
        if late:
            late, early = np.concatenate(late), np.concatenate(early)
            by = np.argsort(place[late], kind="stable")
            late, early = late[by], early[by]
            cuts = np.flatnonzero(np.r_[True, np.diff(place[late]) != 0, True]) if len(late) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                kept[late[a:b][kept[early[a:b]]]] = False
        return pd.DataFrame({image: frame[image], order: frame[order], "kept": kept})

    types = dict(rows.dtypes)
    placed = rows.select(image, order, "label", "x0", "y0", "x1", "y1").repartition(image).sortWithinPartitions(image, F.col(order).asc_nulls_last())
    return placed.mapInPandas(_by_groups(image, solve), f"{image} {types[image]}, {order} {types[order]}, kept boolean")


def _by_groups(key: str, solve):
    """Whole groups of a partition sorted by key, many to a frame, with the place where each row's group begins; a group may go over the end of a batch."""

    def begins(keys: pd.Series) -> np.ndarray:
        null, values = keys.isna().to_numpy(), keys.to_numpy()
        new = np.ones(len(keys), bool)
        new[1:] = ((values[1:] != values[:-1]) | (null[1:] != null[:-1])) & ~(null[1:] & null[:-1])
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = int(begins(b[key])[-1])
            joins = held and not last and len(begins(pd.concat([held[-1][key].iloc[-1:], b[key].iloc[:1]], ignore_index=True)).nonzero()[0]) == 0
            if not last and (joins or not held):
                held.append(b)
                continue
            whole = pd.concat([*held, b.iloc[:last]], ignore_index=True)
            held = [b.iloc[last:]]
            yield solve(whole, begins(whole[key]))
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield solve(whole, begins(whole[key]))

    return run


# ---- pixels and rectangles: numpy on single rows ---------------------------------------------------------------------------------


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Positive for a left turn at b."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    half = []
    for run in (p, p[::-1]):
        side: list[np.ndarray] = []
        for q in run:
            while len(side) > 1 and _turn(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        half += side[:-1]
    return np.array(half)


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and the long side's angle in degrees, from -90 to below 90, of the rectangle of least area around points."""
    h = hull(np.asarray(points, float))
    if len(h) < 3:
        side = h.max(0) - h.min(0) if len(h) else np.zeros(2)
        return float(np.hypot(*side)), 0.0, 0.0
    edges = np.diff(np.vstack([h, h[:1]]), axis=0)
    best = (np.inf, 0.0, 0.0, 0.0)
    for angle in np.arctan2(edges[:, 1], edges[:, 0]):
        c, s = np.cos(angle), np.sin(angle)
        r = h @ np.array([[c, -s], [s, c]])
        w, t = r.max(0) - r.min(0)
        if w * t < best[0] - 1e-12:
            best = (w * t, w, t, angle)
    _, w, t, angle = best
    turn = np.degrees(angle if w >= t else angle + np.pi / 2)
    return float(max(w, t)), float(min(w, t)), float((turn + 90) % 180 - 90)


def raster(points: np.ndarray, width: int, height: int, inclusive: bool = False) -> np.ndarray:
    """Mask of the pixels whose centres lie in a polygon by the even-odd rule; inclusive adds those on its outline."""
    p = np.asarray(points, float)
    mask = np.zeros((height, width), bool)
    if len(p) < 3:
        return mask
    q = np.roll(p, -1, axis=0)
    xs = np.arange(width)
    for y in range(height):
        cross = (p[:, 1] <= y) != (q[:, 1] <= y)
        at = p[cross, 0] + (y - p[cross, 1]) * (q[cross, 0] - p[cross, 0]) / (q[cross, 1] - p[cross, 1])
        mask[y] = (at[:, None] > xs).sum(0) % 2 == 1
    if inclusive:
        for a, b in zip(p, q):
            n = int(max(abs(b - a))) + 1
            line = np.rint(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
            fine = (line[:, 0] >= 0) & (line[:, 0] < width) & (line[:, 1] >= 0) & (line[:, 1] < height)
            mask[line[fine, 1], line[fine, 0]] = True
    return mask


def foreground_density(gray: np.ndarray, threshold: int, points: np.ndarray | None = None) -> float:
    """Share of dark pixels, of all or of those in a polygon; 0 for none."""
    mask = np.ones(gray.shape, bool) if points is None else raster(points, gray.shape[1], gray.shape[0])
    return float((gray[mask] <= threshold).mean()) if mask.any() else 0.0


def ink_outside(gray: np.ndarray, threshold: int, points: np.ndarray) -> float:
    """Dark pixels in a polygon's box but not in the polygon, over the box's area."""
    mask = raster(points, gray.shape[1], gray.shape[0], True)
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return 0.0
    box = (slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1))
    return float(((gray[box] <= threshold) & ~mask[box]).mean())


def gray_histogram(gray: np.ndarray) -> list[int]:
    return np.bincount(np.asarray(gray, np.uint8).ravel(), minlength=256).tolist()


def pooled_otsu(histogram: np.ndarray) -> int:
    """Threshold with the largest variance between classes, the smallest on ties."""
    h, v = np.asarray(histogram, float), np.arange(len(histogram))
    w, m = np.cumsum(h), np.cumsum(h * v)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w * (w[-1] - w) * (m / w - (m[-1] - m) / (w[-1] - w)) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def equal_image_average(histograms: np.ndarray) -> np.ndarray:
    """Mean of the images' own densities, each image counting alike."""
    h = np.asarray(histograms, float)
    return (h / np.maximum(h.sum(1, keepdims=True), 1)).mean(0)


def density_percentile(density: np.ndarray, percent: float) -> int:
    run = np.cumsum(density)
    return int(np.searchsorted(run, percent / 100 * run[-1], side="left"))


def darkness(gray: np.ndarray, dark: float, light: float) -> np.ndarray:
    """0 at the light reference, 1 at the dark one."""
    return 1 - np.clip((np.asarray(gray, float) - dark) / max(light - dark, 1e-9), 0, 1)


def rectangles(rows: DataFrame, polygon: str) -> DataFrame:
    """rows with rect, the smallest rectangle around each polygon of array<struct<x, y>>."""

    def solve(polygons: pd.Series) -> pd.DataFrame:
        made = [smallest_rectangle(np.array([[q["x"], q["y"]] for q in p])) if p is not None and len(p) else (0.0, 0.0, 0.0) for p in polygons]
        return pd.DataFrame(made, columns=["long_side", "short_side", "angle"])

    return rows.withColumn("rect", F.pandas_udf(solve, "long_side double, short_side double, angle double")(F.col(polygon)))
