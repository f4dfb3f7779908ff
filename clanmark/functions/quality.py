"""Quality scores and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The named parameter rows (name, minimum size, minimum confidence, blur).
PRESETS = (
    ("default", 30, 0.4, 50.0),
    ("very_lenient", 20, 0.3, 30.0),
    ("lenient", 30, 0.4, 50.0),
    ("normal", 40, 0.5, 80.0),
    ("strict", 60, 0.7, 120.0),
)


def quality_area(confidence: Column, width: Column, height: Column) -> Column:
    """confidence * w * h; NULL when the box or the confidence is missing or zero."""
    return F.when(confidence != 0, confidence * (width * height))


def quality_composite(confidence: Column, width: Column, height: Column, blur: Column) -> Column:
    """0.5 * confidence + 0.25 * size score + 0.25 * sharpness score."""
    size = F.least(width * height / 10000.0, F.lit(1.0))
    sharpness = F.least(blur / 300.0, F.lit(1.0))
    return confidence * 0.5 + size * 0.25 + sharpness * 0.25


def quality_strict_score(confidence: Column, blur: Column, ratio: Column) -> Column:
    return confidence * 0.4 + blur / 300.0 * 0.3 + F.least(ratio * 100.0, F.lit(1.0)) * 0.3


def owner_score(quality: Column, confidence: Column) -> Column:
    """0.6 * quality + 0.4 * confidence, a missing value counting as 0."""
    zero = F.lit(0.0)
    return F.coalesce(quality, zero) * 0.6 + F.coalesce(confidence, zero) * 0.4


def gate(
    width: Column, height: Column, confidence: Column, blur: Column,
    min_size: Column, min_confidence: Column, min_blur: Column,
) -> tuple[Column, Column, Column]:
    """(passed, checks, reason) of the size, confidence and blur checks.

    A check is written ``name:value:limit``; the reason names the failed checks, with commas.
    """
    tests = (
        ("size", F.least(width, height), min_size, "%.0f"),
        ("confidence", confidence, min_confidence, "%.3f"),
        ("blur", blur, min_blur, "%.2f"),
    )
    checks = F.array(
        *[
            F.format_string(f"{name}:{form}:{form}", value.cast("double"), limit.cast("double"))
            for name, value, limit, form in tests
        ]
    )
    failed = F.array_compact(F.array(*[F.when(value < limit, F.lit(name)) for name, value, limit, _ in tests]))
    passed = (height >= min_size) & (width >= min_size) & (confidence >= min_confidence) & (blur >= min_blur)
    return passed, checks, F.array_join(failed, ",")


def preset_array() -> Column:
    """The presets as one array literal: exploding it needs neither a join nor a shuffle."""
    rows = [
        F.struct(
            F.lit(name).alias("preset"), F.lit(size).alias("min_size"),
            F.lit(confidence).alias("min_confidence"), F.lit(blur).alias("min_blur"),
        )
        for name, size, confidence, blur in PRESETS
    ]
    return F.array(*rows)
