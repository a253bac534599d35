"""Displays and windows: whether a page captured on them is wide enough, and which to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.pages import MIN_WIDTH

#: Share of a display that a maximised window covers, and pixels kept of the possible ones.
FULL_WIDTH, FULL_HEIGHT, ZOOM = 0.95, 0.90, 0.85


def page_pixels(width: Column, scale: Column, pages: Column) -> Column:
    return F.floor(width * scale / F.greatest(pages, F.lit(1))).cast("int")


def needed_width(scale: Column, pages: Column) -> Column:
    return F.ceil(MIN_WIDTH * F.greatest(pages, F.lit(1)) / scale).cast("int")


def preflight(windows: DataFrame, *, win_w: str, win_h: str, disp_w: str, disp_h: str, scale: str, pages: str, measured: str) -> DataFrame:
    """windows with what a capture would give and advice: maximised, page_px, zoom, meets, need_pt, advice, ok."""
    w, h, dw, dh, m = (F.col(c) for c in (win_w, win_h, disp_w, disp_h, measured))
    full = (w >= dw * FULL_WIDTH) & (h >= dh * FULL_HEIGHT)
    px, need = page_pixels(w, F.col(scale), F.col(pages)), needed_width(F.col(scale), F.col(pages))
    zoom = F.bround(F.nullif(m, F.lit(0)) / F.nullif(px, F.lit(0)), 2)
    meets = F.coalesce(F.nullif(m, F.lit(0)), px) >= MIN_WIDTH
    advice = F.array_compact(F.array(F.when(~full, "maximise"), F.when(F.col(pages) >= 2, "single page"), F.when(zoom < ZOOM, "zoom in"), F.when(~meets, F.when(need > dw, "larger display").otherwise("wider window"))))
    return windows.select(
        "*", full.alias("maximised"), F.bround(w / F.nullif(dw, F.lit(0)), 3).alias("coverage_w"), px.alias("page_px"), zoom.alias("zoom"), meets.alias("meets"), need.alias("need_pt"), advice.alias("advice"), (full & meets & F.coalesce(zoom >= ZOOM, F.lit(True))).alias("ok")
    )


def evaluate_displays(displays: DataFrame, *, width: str, scale: str, spread: int = 2) -> DataFrame:
    """displays with backing width, pixels of a page in a spread and alone, and the best layout that suffices."""
    w, s = F.col(width), F.col(scale)
    both, alone = page_pixels(w, s, F.lit(spread)), page_pixels(w, s, F.lit(1))
    best = F.when(page_pixels(w, s, F.lit(2)) >= MIN_WIDTH, "spread").when(alone >= MIN_WIDTH, "single")
    return displays.select("*", F.bround(w * s).cast("int").alias("backing"), both.alias("page_px"), alone.alias("single_px"), (both >= MIN_WIDTH).alias("meets"), (alone >= MIN_WIDTH).alias("meets_single"), best.alias("best_layout"))


def plan_display(evaluated: DataFrame, *, group: str, id: str, builtin: str, prefer: str) -> DataFrame:
    """Per group: the preferred display if it suffices, else the one of most page pixels (built-in on
    ties, then the first id), whether any suffices, and otherwise whether one page alone would fit."""
    rank = F.struct("page_px", F.col(builtin).cast("int").alias("b"), (-F.col(id)).alias("i"))
    meets = F.col("meets")
    per = evaluated.groupBy(group).agg(
        F.max(F.when(meets & (F.col(id) == F.col(prefer)), F.col(id))).alias("preferred"),
        F.max_by(id, F.when(meets, rank)).alias("widest"),
        F.bool_or("meets").alias("any_meets"),
        F.bool_or("meets_single").alias("any_single"),
    )
    return per.select(group, "any_meets", F.coalesce("preferred", "widest").alias("chosen"), F.when(F.col("preferred").isNotNull(), "preferred").when(F.col("widest").isNotNull(), "widest").alias("reason"), (~F.col("any_meets")).alias("override"), (~F.col("any_meets") & F.col("any_single")).alias("single_page"))
