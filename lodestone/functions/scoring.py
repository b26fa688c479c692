"""Vector similarity and the hybrid ranking score of stored facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score, e-folding days of recency, uses at which usage saturates.
W_SEMANTIC, W_RECENCY, W_IMPORTANCE, W_USAGE = 0.60, 0.15, 0.20, 0.05
RECENCY_DAYS = 21.0
USAGE_SATURATION = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 for null, empty or zero vectors and for different lengths."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.coalesce(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))


def recency(age_days: Column) -> Column:
    """exp(-age / 21), ages below 0 as 0; an unknown age gives 0."""
    return F.when(age_days.isNull(), F.lit(0.0)).otherwise(F.exp(-F.greatest(age_days.cast("double"), F.lit(0.0)) / RECENCY_DAYS))


def age_days(updated_at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def usage(use_count: Column) -> Column:
    return F.least(F.greatest(F.coalesce(use_count, F.lit(0)), F.lit(0)), F.lit(USAGE_SATURATION)) / F.lit(float(USAGE_SATURATION))


def hybrid(semantic: Column, recent: Column, importance: Column, used: Column) -> Column:
    return W_SEMANTIC * clamp01(semantic) + W_RECENCY * recent + W_IMPORTANCE * clamp01(F.coalesce(importance, F.lit(0.0))) + W_USAGE * used


def iso_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp; without a zone UTC (the session's); what cannot be read is null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.concat(text, F.lit("Z"))))
