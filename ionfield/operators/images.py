"""Image operators in numpy: masks, distance maps, marker-based watershed, nuclei.  An image is one task."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..storage import ship_package


def otsu_level(grey: np.ndarray, bins: int = 256) -> float:
    hist, edges = np.histogram(grey, bins)
    mid = (edges[:-1] + edges[1:]) / 2
    n0, s0 = np.cumsum(hist), np.cumsum(hist * mid)
    n1 = n0[-1] - n0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = n0 * n1 * (s0 / n0 - (s0[-1] - s0) / n1) ** 2
    return float(mid[np.nanargmax(between)])


def shift(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def erode(mask: np.ndarray, size: int = 1) -> np.ndarray:
    out = mask
    for _ in range(size):
        out = out & shift(out, 1, 0) & shift(out, -1, 0) & shift(out, 0, 1) & shift(out, 0, -1)
    return out


def dilate(mask: np.ndarray, size: int = 1) -> np.ndarray:
    out = mask
    for _ in range(size):
        out = out | shift(out, 1, 0) | shift(out, -1, 0) | shift(out, 0, 1) | shift(out, 0, -1)
    return out


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected parts, numbered from 1 by their first pixel; 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            near = shift(label, dy, dx)
            new = np.where(mask & (near > 0), np.minimum(new, near), new)
        flat = new.ravel()
        new = np.where(mask, flat[np.maximum(flat, 1) - 1].reshape(mask.shape), 0)  # jump to the label's own label
        if np.array_equal(new, label):
            break
        label = new
    values = np.unique(label[mask])
    return np.where(mask, np.searchsorted(values, label) + 1, 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = label_components(np.pad(~mask, 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def flood(allowed: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The 4-connected part of ``allowed`` that holds the seed."""
    if not allowed[seed]:
        return np.zeros_like(allowed)
    label = label_components(allowed)
    return label == label[seed]


def matched_component(tissue: np.ndarray, measurement: np.ndarray) -> np.ndarray:
    """The part of the tissue nearest the measurement's centre, with its holes filled."""
    label = label_components(tissue)
    if not label.max():
        return tissue
    centre = np.argwhere(measurement).mean(0)
    at = np.argwhere(label > 0)
    y, x = at[((at - centre) ** 2).sum(1).argmin()]
    return fill_holes(label == label[y, x])


def distance_map(mask: np.ndarray) -> np.ndarray:
    """Steps to the background (erosions survived)."""
    out, rest = np.zeros(mask.shape), mask
    while rest.any():
        out += rest
        rest = erode(rest)
    return out


def watershed(height: np.ndarray, mask: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """Regions around the maxima of ``height``: pixels join from the highest down; two regions merge where the
    lower maximum is less than ``tolerance`` above where they meet."""
    label = np.zeros(mask.shape, dtype=int)
    top, parent = {}, {}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    heap = [(-height[y, x], y, x) for y, x in np.argwhere(mask)]
    heapq.heapify(heap)
    while heap:
        h, y, x = heapq.heappop(heap)
        near = sorted({find(label[j, i]) for j, i in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and label[j, i]}, key=lambda r: -top[r])
        if not near:
            k = len(parent) + 1
            parent[k], top[k] = k, -h
            label[y, x] = k
            continue
        label[y, x] = near[0]
        for r in near[1:]:
            if top[r] - -h < tolerance:
                parent[r] = near[0]
    roots = {r: i + 1 for i, r in enumerate(sorted({find(k) for k in parent}))}
    return np.vectorize(lambda v: roots[find(v)] if v else 0)(label) if parent else label


def segment_nuclei(grey: np.ndarray, min_size: int = 4, max_size: int = 10_000, opening: int = 1, tolerance: float = 1.0) -> list[dict]:
    """Dark nuclei of a grey image: Otsu, opening, holes, distance map, watershed, shape measures."""
    mask = grey < otsu_level(grey)
    mask = fill_holes(dilate(erode(mask, opening), opening))
    label = watershed(distance_map(mask), mask, tolerance)
    out = []
    for k in range(1, label.max() + 1):
        at = np.argwhere(label == k)
        if min_size <= len(at) <= max_size:
            part = label == k
            perimeter = int((part & ~erode(part)).sum())
            out.append({"object_id": len(out) + 1, "x": float(at[:, 1].mean()), "y": float(at[:, 0].mean()), "area": float(len(at)), "perimeter": float(perimeter), "mean_intensity": float(grey[part].mean())})
    return out


def segment_images(images: DataFrame, **options) -> DataFrame:
    """(image_id, object_id, x, y, area, perimeter, mean_intensity) of (image_id, width, height, grey array)."""
    ship_package(images.sparkSession)
    names = ["object_id", "x", "y", "area", "perimeter", "mean_intensity"]

    def run(batches):
        for pdf in batches:
            rows = [(i, *(o[n] for n in names)) for i, w, h, g in zip(pdf.image_id, pdf.width, pdf.height, pdf.grey, strict=True) for o in segment_nuclei(np.asarray(g, dtype=float).reshape(h, w), **options)]
            yield pd.DataFrame(rows, columns=["image_id", *names])

    return images.select("image_id", "width", "height", "grey").mapInPandas(run, f"image_id {images.schema['image_id'].dataType.simpleString()}, object_id long, x double, y double, area double, perimeter double, mean_intensity double")


def load_images(spark, path: str) -> DataFrame:
    """(image_id, width, height, grey) by the image source, channels averaged."""
    ship_package(spark)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, w, h, c, data in zip(pdf.origin, pdf.width, pdf.height, pdf.nChannels, pdf.data, strict=True):
                rows.append((name, w, h, np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)[:, :, :3].mean(2).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "grey"])

    return spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInPandas(run, "image_id string, width int, height int, grey array<double>")
