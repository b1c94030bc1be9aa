"""Pixel kernels in numpy, one image at a time, behind Arrow.

A pixel buffer is row-major RGBA (``height * width * 4`` bytes). The kernels are plain functions of arrays, so
they can be tested alone; ``apply_kernel`` and ``render`` run them over image tables. What is asked of an image is
gathered by id first, so its pixels are shuffled once at most, and are never broadcast.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import CONFIG

# Weights of red, green and blue in the grey of a pixel.
LUMA = np.array([0.299, 0.587, 0.114])


def pixels(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def half_up(x):
    return np.floor(np.asarray(x, float) + 0.5)


def luma(rgba: np.ndarray) -> np.ndarray:
    p = rgba[..., :3].astype(float)
    return p[..., 0] * LUMA[0] + p[..., 1] * LUMA[1] + p[..., 2] * LUMA[2]


def _with_grey(rgba: np.ndarray, grey: np.ndarray) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] = np.clip(grey, 0, 255).astype(np.uint8)[..., None]
    return out


def grey(rgba: np.ndarray) -> np.ndarray:
    return _with_grey(rgba, half_up(luma(rgba)))


def grey_contrast(rgba: np.ndarray) -> np.ndarray:
    return _with_grey(rgba, half_up((luma(rgba) - 128) * 1.65 + 128))


def binarise(threshold: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda rgba: _with_grey(rgba, np.where(luma(rgba) >= threshold, 255, 0))


def colour_extract(rgba: np.ndarray) -> np.ndarray:
    """Colourless pixels turn white, the others grey."""
    p = rgba[..., :3].astype(int)
    return _with_grey(rgba, np.where(p.max(-1) - p.min(-1) < 32, 255, half_up(luma(rgba))))


def invert(rgba: np.ndarray) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] = 255 - out[..., :3]
    return out


#: The variants by name.
VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "source": lambda rgba: rgba,
    "gray": grey,
    "contrast": grey_contrast,
    "bin180": binarise(180),
    "bin220": binarise(220),
    "color": colour_extract,
    "invert": invert,
}


def grey_plane(rgba: np.ndarray, boost: bool = False) -> np.ndarray:
    """Rounded grey, and with ``boost`` its contrast raised once more."""
    v = half_up(luma(rgba))
    return np.clip(half_up((v - 128) * 1.52 + 128) if boost else v, 0, 255).astype(np.uint8)


def crop(rgba: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return rgba[max(0, y) : y + h, max(0, x) : x + w].copy()


def white_border(rgba: np.ndarray, pad: int) -> np.ndarray:
    out = np.full((rgba.shape[0] + 2 * pad, rgba.shape[1] + 2 * pad, 4), 255, np.uint8)
    out[pad : pad + rgba.shape[0], pad : pad + rgba.shape[1]] = rgba
    return out


#: Rows of a resampled picture that are made at a time.
STRIP = 64


def _taps(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), both (new, taps), of a resampling: area means when shrinking, linear between centres when growing."""
    if new < size:
        a, b = np.arange(new) * size / new, np.arange(1, new + 1) * size / new
        first = a.astype(int)
        places = first[:, None] + np.arange(int((np.ceil(b) - first).max()))
        weights = np.maximum(0, np.minimum(places + 1, b[:, None]) - np.maximum(places, a[:, None]))
        places = np.minimum(places, size - 1)
    else:
        at = np.clip((np.arange(new) + 0.5) * size / new - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        places, weights = np.stack((low, np.minimum(low + 1, size - 1)), axis=1), np.stack((1 - (at - low), at - low), axis=1)
    return places, weights / weights.sum(axis=1, keepdims=True)


def resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """Smooth resampling. A browser's own is not specified, so only sizes are comparable, not single bytes.

    Made strip by strip, each from the rows that it needs, so beside the two pictures only a strip is held as doubles.
    """
    out = np.empty((height, width, rgba.shape[2]), np.uint8)
    (rows, down), (columns, along) = _taps(rgba.shape[0], height), _taps(rgba.shape[1], width)
    for at in range(0, height, STRIP):
        strip = slice(at, at + STRIP)
        lines = sum(down[strip, t, None, None] * rgba[rows[strip, t]] for t in range(rows.shape[1]))
        both = sum(along[None, :, t, None] * lines[:, columns[:, t]] for t in range(columns.shape[1]))
        out[strip] = np.clip(half_up(both), 0, 255)
    return out


def text_regions(rgba: np.ndarray, limit: int = CONFIG.region_limit) -> list[dict]:
    """Bands of rows with enough dark or light pixels, densest first, none overlapping another by much."""
    height, width = rgba.shape[:2]
    step = CONFIG.region_sample
    sample = luma(rgba[::step, ::step])
    rows, columns = sample.shape
    xs = np.minimum(width - 1, np.arange(columns) * step)
    least = max(3, int(half_up(columns * 0.0015)))
    found = []
    for mode, hit in (("dark", sample < CONFIG.region_dark), ("light", sample > CONFIG.region_light)):
        count = hit.sum(axis=1)
        any_ = count > 0
        left = np.where(any_, xs[hit.argmax(axis=1)], width)
        right = np.where(any_, xs[columns - 1 - hit[:, ::-1].argmax(axis=1)], 0)
        full = np.flatnonzero(count >= least)
        # A band ends where more than three sampled rows in turn are too empty.
        for band in np.split(full, np.flatnonzero(np.diff(full) > 4) + 1) if len(full) else []:
            a, b = int(band[0]), int(band[-1])
            y0, y1 = max(0, a * step - 10), min(height, (b + 1) * step + 10)
            x0, x1 = int(left[a : b + 1].min()), int(right[a : b + 1].max())
            if x1 <= x0:
                continue
            x0, x1 = max(0, x0 - 14), min(width, x1 + 14)
            w, h = x1 - x0, y1 - y0
            if 14 <= h <= 110 and 35 <= w <= min(width, 1400):
                found.append({"x": x0, "y": y0, "w": w, "h": h, "mode": mode, "density": float(count[a : b + 1].sum()) / max(1.0, w * h / (step * step))})
    found.sort(key=lambda r: -r["density"])
    kept: list[dict] = []
    for r in found:
        if len(kept) >= limit:
            break
        if not any(shared_area(r, q) > min(r["w"] * r["h"], q["w"] * q["h"]) * CONFIG.box_overlap for q in kept):
            kept.append(r)
    return kept


def shared_area(a: dict, b: dict) -> float:
    ix = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    iy = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    return max(0, ix) * max(0, iy)


def ring_colour(rgba: np.ndarray, rect: dict, ring: int = 6) -> tuple[int, int, int]:
    """Mean colour of the opaque pixels around a rectangle; white if there are none."""
    height, width = rgba.shape[:2]
    x0, y0 = max(0, int(np.floor(rect["x"] - ring))), max(0, int(np.floor(rect["y"] - ring)))
    x1, y1 = min(width, int(np.ceil(rect["x"] + rect["w"] + ring))), min(height, int(np.ceil(rect["y"] + rect["h"] + ring)))
    area = rgba[y0:y1, x0:x1]
    ys, xs = np.mgrid[y0 : max(y0, y1), x0 : max(x0, x1)]
    inside = (xs >= rect["x"]) & (xs < rect["x"] + rect["w"]) & (ys >= rect["y"]) & (ys < rect["y"] + rect["h"])
    use = area[~inside & (area[..., 3] >= 8)] if area.size else area.reshape(0, 4)
    if not len(use):
        return 255, 255, 255
    return tuple(int(v) for v in half_up(use[:, :3].astype(float).sum(axis=0) / len(use)))


def _gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(plane, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        plane = sum(w * np.take(padded, np.arange(i, i + plane.shape[axis]), axis=axis) for i, w in enumerate(k))
    return plane


def blur(rgba: np.ndarray, rect: dict) -> None:
    """Blurs a rectangle in place, of the pixels as they are now: shrunk to a twelfth, smoothed, enlarged."""
    height, width = rgba.shape[:2]
    margin = max(10, min(28, int(half_up(rect["h"] * 0.55))))
    x, y = max(0, int(np.floor(rect["x"] - margin))), max(0, int(np.floor(rect["y"] - margin)))
    w = max(1, min(width - x, int(np.ceil(rect["w"] + margin * 2))))
    h = max(1, min(height - y, int(np.ceil(rect["h"] + margin * 2))))
    small = resize(rgba[y : y + h, x : x + w], max(2, int(half_up(w / 12))), max(2, int(half_up(h / 12))))
    soft = _gaussian(resize(small, w, h).astype(float), max(10, min(24, int(half_up(rect["h"] * 0.45)))))
    a, b = max(0, int(half_up(rect["x"]))), max(0, int(half_up(rect["y"])))
    c, d = min(width, int(half_up(rect["x"] + rect["w"]))), min(height, int(half_up(rect["y"] + rect["h"])))
    rgba[b:d, a:c, :3] = np.clip(half_up(soft[b - y : d - y, a - x : c - x, :3]), 0, 255)


def _colour(text: str | None) -> tuple[int, int, int]:
    t = (text or "#1a1a1a").lstrip("#")
    return tuple(int(t[i : i + 2], 16) for i in (0, 2, 4))


def cover(rgba: np.ndarray, stamps: list[dict]) -> np.ndarray:
    """The image with its stamps painted in order; background colours come from the uncovered image."""
    out = rgba.copy()
    height, width = out.shape[:2]
    for s in stamps:
        mode = (s.get("style") or {}).get("mode") or "black"
        if mode == "blur":
            blur(out, s)
            continue
        colour = ring_colour(rgba, s) if mode == "bg" else _colour((s.get("style") or {}).get("color")) if mode == "color" else (0, 0, 0)
        x0, y0 = max(0, int(half_up(s["x"]))), max(0, int(half_up(s["y"])))
        x1, y1 = min(width, int(half_up(s["x"] + s["w"]))), min(height, int(half_up(s["y"] + s["h"])))
        out[y0:y1, x0:x1] = (*colour, 255)
    return out


def png(rgba: np.ndarray) -> bytes:
    """PNG file of an RGBA image."""
    height, width = rgba.shape[:2]
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)), axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def grey_planes(images: DataFrame, boost: bool = False) -> DataFrame:
    """(image_id, width, height, data): one byte of grey a pixel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["data"] = [grey_plane(pixels(d, w, h), boost).tobytes() for d, w, h in zip(f["data"], f["width"], f["height"])]
            yield f

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id string, width int, height int, data binary")


def apply_kernel(images: DataFrame, variant: str) -> DataFrame:
    """Images with their pixels replaced by a variant's."""
    kernel = VARIANTS[variant]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["data"] = [kernel(pixels(d, w, h)).tobytes() for d, w, h in zip(f["data"], f["width"], f["height"])]
            yield f

    return images.mapInPandas(run, images.schema)


def analysed(rgba: np.ndarray) -> tuple[np.ndarray, float]:
    """The page on which regions and templates are sought, of bounded size, and its scale."""
    height, width = rgba.shape[:2]
    scale = min(1.0, CONFIG.analysis_width / width, float(np.sqrt(CONFIG.analysis_pixels / (width * height))))
    if scale >= CONFIG.scale_snap:
        return rgba, 1.0
    return resize(rgba, max(1, int(half_up(width * scale))), max(1, int(half_up(height * scale)))), scale


def page_regions(rgba: np.ndarray) -> list[dict]:
    """``text_regions`` of the analysed page, in the image's own pixels."""
    page, scale = analysed(rgba)
    return [{**r, **{k: r[k] / scale for k in ("x", "y", "w", "h")}} for r in text_regions(page)]


def detect_regions(images: DataFrame) -> DataFrame:
    """(image_id, region_ix, x, y, w, h, mode, density) of the text-like bands of every image."""
    schema = "image_id string, region_ix int, x double, y double, w double, h double, mode string, density double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"image_id": i, "region_ix": k, **r} for i, d, w, h in zip(f["image_id"], f["data"], f["width"], f["height"]) for k, r in enumerate(page_regions(pixels(d, w, h)))]
            yield pd.DataFrame(rows, columns=["image_id", "region_ix", "x", "y", "w", "h", "mode", "density"])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, schema)


def render(images: DataFrame, stamps: DataFrame, encode: bool = True) -> DataFrame:
    """(image_id, path, data): the covered images, as PNG files or as pixels.

    Stamps are gathered by image (some hundred narrow rows at most) and joined by id.
    """
    order = ["stamp_ix", "x", "y", "w", "h", "style"]
    packed = stamps.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("stamps"))
    rows = images.select("image_id", "path", "width", "height", "data").join(packed.hint("shuffle_hash"), "image_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, w, h, s in zip(f["data"], f["width"], f["height"], f["stamps"]):
                done = cover(pixels(d, w, h), [_plain(x) for x in (s if s is not None else [])])
                out.append(png(done) if encode else done.tobytes())
            yield pd.DataFrame({"image_id": f["image_id"], "path": f["path"], "data": out})

    return rows.mapInPandas(run, "image_id string, path string, data binary")


def _plain(x) -> dict:
    row = x.asDict(True) if hasattr(x, "asDict") else dict(x)
    if row.get("style") is not None and not isinstance(row["style"], dict):
        row["style"] = row["style"].asDict()
    return row
