"""Fixed values of the engine, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # They must equal the reference's for right results.
    # Boxes and rectangles.
    short_name_height_width: float = 1.18
    short_name_median_width: float = 1.22
    short_name_shape: float = 1.20
    short_name_step: float = 1.02
    short_name_narrow: float = 0.78
    short_name_wide: float = 1.30
    # Fuzzy match.
    min_similarity: float = 0.50
    near_limit: int = 60
    near_slack: int = 2
    identical: float = 0.999
    # Groups, votes, recovery.
    group_gap: float = 28.0
    group_width: float = 0.45
    group_height: float = 0.65
    group_slots: int = 8
    touch_gap: float = 24.0
    touch_width: float = 0.55
    touch_height: float = 0.70
    vote_similarity: float = 0.66
    vote_least: int = 2
    recovery_similarity: float = 0.72
    # Suppression.
    box_overlap: float = 0.45
    template_overlap: float = 0.35
    # Text regions.
    region_sample: int = 2
    region_dark: float = 185.0
    region_light: float = 225.0
    region_limit: int = 24
    # Templates.
    template_weights: tuple[float, float] = (0.72, 0.28)
    gray_text: tuple[int, int] = (95, 235)
    gray_background: int = 84
    coarse: tuple[float, float] = (0.57, 0.42)
    final: tuple[float, float] = (0.60, 0.44)
    coarse_step: int = 6
    coarse_offset: int = 3
    refine_step: int = 2
    refine_reach: int = 10
    coarse_limit: int = 10
    final_limit: int = 6
    merged_limit: int = 12
    search_left: float = 0.10
    search_right: float = 0.02
    search_top: float = 0.12
    region_margin: int = 18
    rescue: tuple[float, float, float] = (0.62, 0.47, 0.93)
    rescue_limit: int = 3
    template_heights: tuple[int, int] = (26, 28)
    # Scales.
    analysis_width: int = 1000
    analysis_pixels: float = 2.5e6
    ocr_scale: tuple[float, float] = (1.8, 2.5)
    ocr_pixels: float = 11e6
    template_width: int = 900
    template_pixels: float = 1.8e6
    scale_snap: float = 0.995
    ocr_border: int = 10
    # Manual edits.
    min_manual_size: float = 4.0
    undo_limit: int = 50
    history_limit: int = 5
    hit_radius: float = 30.0
    tap_reach: float = 12.0


CONFIG = Config()
#: Characters of which short Japanese names consist.
NAME_CHARACTER = "[ぁ-ゖァ-ヺ一-龯々〆ヵヶ]"
#: Where a covered box comes from, in the order in which boxes are taken.
SOURCES = ("OCR", "再OCR", "近似候補救出", "局所OCR", "イタリック救出")
