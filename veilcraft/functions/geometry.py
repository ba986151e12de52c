"""Rectangle and text style expressions for page overlays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
MIN_FONT_SIZE = 4.0
MAX_FONT_SIZE = 72.0
HEIGHT_TO_SIZE = 0.78
# Tests in their order: (fragments of the lower-cased font name, built-in font).
FONT_FAMILIES = [(["courier"], "cour"), (["times"], "tiro"), (["symbol"], "symb"), (["zapf", "ding"], "zadb")]
DEFAULT_FONT = "helv"
# ----------------------------------------------------------------------------


def font_family(font: Column) -> Column:
    lowered = F.lower(F.coalesce(font, F.lit("")))
    chain = F
    for fragments, family in FONT_FAMILIES:
        chain = chain.when(lowered.rlike("|".join(fragments)), family)
    return chain.otherwise(DEFAULT_FONT)


def color_parts(color: Column) -> Column:
    """``struct(red, green, blue)`` in 0..1 of a packed colour; black for NULL."""

    def channel(shift: int) -> Column:
        return F.coalesce(F.shiftright(color, shift).bitwiseAND(F.lit(0xFF)) / 255, F.lit(0.0))

    return F.struct(channel(16).alias("red"), channel(8).alias("green"), channel(0).alias("blue"))


def overlap_area(a: str, b: str) -> Column:
    """Shared area of the rectangles in columns ``{a}x0 … {a}y1`` and ``{b}x0 … {b}y1``."""
    width = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    height = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def clamp_size(size: Column) -> Column:
    return F.greatest(F.lit(MIN_FONT_SIZE), F.least(F.lit(MAX_FONT_SIZE), size))


def centred_baseline(bottom: Column, height: Column, size: Column) -> Column:
    return bottom - F.greatest(F.lit(0.0), (height - size) / 2)
