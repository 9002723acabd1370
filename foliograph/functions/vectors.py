"""Vector functions as column expressions over arrays (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import RECENCY_DAYS


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector is zero or lengths differ."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size).otherwise(0.0)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    # the norm is bound once: inside a lambda it would be summed again for every element
    bound = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v)))
    return F.get(bound, F.lit(0))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def recency(created: Column, as_of: Column) -> Column:
    """1 now or in the future, falling to 0 over three years by whole days; 0.5 without a date."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400)
    return F.when(created.isNull(), 0.5).when(created > as_of, 1.0).otherwise(clamp(1 - days / RECENCY_DAYS))


def search_score(similarity: Column, recent: Column) -> Column:
    return clamp(0.9 * similarity + 0.1 * recent)


def related_score(similarity: Column, jaccard: Column, recent: Column) -> Column:
    return 0.55 * similarity + 0.35 * jaccard + 0.10 * recent


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_distance(a: Column, b: Column) -> Column:
    """Share of members added or removed; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) / union).otherwise(0.0)


def softmax_over(df: DataFrame, logit: str, by: list[str], out: str) -> DataFrame:
    """Softmax over the rows of a group, shifted by the maximum; uniform where all weights vanish."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    total = F.sum(e).over(w)
    return df.withColumn(out, F.when(total > 0, e / total).otherwise(1 / F.count("*").over(w)))


def poincare_distance(a: Column, b: Column) -> Column:
    gap = F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    inside = (1 - F.pow(norm(a), 2)) * (1 - F.pow(norm(b), 2))
    return F.acosh(1 + 2 * gap / F.greatest(inside, F.lit(1e-9)))
