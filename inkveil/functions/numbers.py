"""Number rules shared by all operators: rounding halves up, finite values, medians, scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import CONFIG
from .plan import let


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity: floor(x + 0.5), not Spark's ``round``."""
    return F.floor(x + F.lit(0.5)).cast("double")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def positive_box(b: Column) -> Column:
    """A box with finite corners and a positive size."""
    return F.coalesce(finite(b["x0"]) & finite(b["x1"]) & finite(b["y0"]) & finite(b["y1"]) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), F.lit(False))


def median_of(values: Column) -> Column:
    """Median of the finite numbers of an array; null if there is none."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        half = F.floor(n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(s, half)).when(n > 0, (F.get(s, half - 1) + F.get(s, half)) / 2)

    return let(F.sort_array(F.filter(values, finite)), middle)


def median_or_zero(values: Column) -> Column:
    return F.coalesce(median_of(values), F.lit(0.0))


def _snapped(scale: Column) -> Column:
    return F.when(scale >= CONFIG.scale_snap, F.lit(1.0)).otherwise(scale)


def analysis_scale(width: Column, height: Column) -> Column:
    return _snapped(F.least(F.lit(1.0), CONFIG.analysis_width / width, F.sqrt(CONFIG.analysis_pixels / (width * height))))


def ocr_scale(width: Column, height: Column) -> Column:
    """Scale of the recognised page over the analysis page of the given size."""
    low, high = CONFIG.ocr_scale
    return F.greatest(F.lit(low), F.least(F.lit(high), F.sqrt(CONFIG.ocr_pixels / (width * height))))


def template_scale(width: Column, height: Column) -> Column:
    s = _snapped(F.least(F.lit(1.0), CONFIG.template_width / width, F.sqrt(CONFIG.template_pixels / (width * height))))
    return F.when(s == 1.0, s).otherwise(F.greatest(F.lit(1.0), half_up(width * s)) / width)


def scaled_size(size: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1.0), half_up(size * scale)).cast("int")
