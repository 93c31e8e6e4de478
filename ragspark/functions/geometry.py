"""Layout-block geometry: cover scaling, clamping, orientation and down-sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PREVIEW_SIDE = 1600  # fixed value


def cover_scale(view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    return F.greatest(F.try_divide(view_w, image_w), F.try_divide(view_h, image_h))


def _place(value: Column, scale: Column, view: Column, image: Column) -> Column:
    return value * scale + (view - image * scale) / F.lit(2.0)


def overlay_box(box: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """Scaled, centred and clamped box; null when it is empty inside the viewport or there is no image."""
    scale = cover_scale(view_w, view_h, image_w, image_h)

    def clamp(v: Column, hi: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), hi)

    left = clamp(_place(box["left"], scale, view_w, image_w), view_w)
    right = clamp(_place(box["right"], scale, view_w, image_w), view_w)
    top = clamp(_place(box["top"], scale, view_h, image_h), view_h)
    bottom = clamp(_place(box["bottom"], scale, view_h, image_h), view_h)
    visible = (image_w > 0) & (image_h > 0) & (right > left) & (bottom > top)
    return F.when(visible, F.struct(
        left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")
    ))


def label_anchor(box: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """Rounded top-left of a translated label: scaled and centred, neither clamped nor dropped."""
    scale = cover_scale(view_w, view_h, image_w, image_h)
    half = F.lit(0.5)
    return F.when((image_w > 0) & (image_h > 0), F.struct(
        F.floor(_place(box["left"], scale, view_w, image_w) + half).cast("int").alias("x"),
        F.floor(_place(box["top"], scale, view_h, image_h) + half).cast("int").alias("y"),
    ))


def sample_size(width: Column, height: Column, limit: int = MAX_PREVIEW_SIDE) -> Column:
    """Smallest power of two that brings both sides within ``limit`` under integer division.

    ``side / s > limit`` in integers means ``side >= (limit + 1) * s``, so the answer is the first
    power of two above ``side / (limit + 1)``; null for an unreadable image.
    """
    side = F.greatest(width, height).cast("bigint")
    expr = F.lit(1 << 31).cast("bigint")
    for bits in range(30, -1, -1):
        expr = F.when(side < F.lit((limit + 1) << bits), F.lit(1 << bits).cast("bigint")).otherwise(expr)
    return F.when((width > 0) & (height > 0), expr)


def oriented_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height after EXIF orientation; 5..8 swap the axes, negatives count as zero."""
    w, h = F.greatest(width, F.lit(0)), F.greatest(height, F.lit(0))
    swap = orientation.isin(5, 6, 7, 8)
    return F.struct(F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"))


def recognizer(tag: Column) -> Column:
    """Script family of a language tag."""
    t = F.lower(tag)
    return (
        F.when(t.isin("zh", "zh-cn", "zh-tw"), "CHINESE").when(t == "ja", "JAPANESE")
        .when(t == "ko", "KOREAN").otherwise("LATIN")
    )


def recognised_lines(blocks: Column) -> Column:
    """Lines of ``array<struct<lines:array<struct<text,box>>>>`` in reading order; lines without a box drop out."""
    lines = F.flatten(F.transform(blocks, lambda b: b["lines"]))
    return F.transform(F.filter(lines, lambda x: x["box"].isNotNull()), lambda x: F.struct(
        x["text"].alias("text"), *[x["box"][side].alias(side) for side in ("left", "top", "right", "bottom")]
    ))
