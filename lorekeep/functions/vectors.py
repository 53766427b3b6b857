"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, policy: str = "rank") -> Column:
    """Cosine by policy: "rank" is 0 at a vanishing norm and clamped to +-1; "bank" is 0 at a zero norm; "title" is 0.5
    for different sizes or zero norms and clamped to 0..1."""
    scale = norm(a) * norm(b)
    raw = F.try_divide(dot(a, b), scale)
    if policy == "rank":
        return F.when(scale < 1e-8, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    if policy == "bank":
        return F.when(scale == 0, 0.0).otherwise(raw)
    if policy == "title":
        return F.when((F.size(a) != F.size(b)) | (scale == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    raise ValueError(f"unknown policy {policy!r}")


def distance_score(distance: Column, large: bool = False) -> Column:
    """Score of a cosine distance: 1 - d, not under 0; large indexes score by 1 / (1 + d)."""
    return 1.0 / (1.0 + distance) if large else F.greatest(F.lit(0.0), 1.0 - distance)


def adapted(a: Column, delta: Column) -> Column:
    """A vector moved by an adapter's delta and brought to length one; a vanishing delta moves nothing."""
    return l2_normalised(F.when(norm(delta) < 1e-9, F.transform(a, lambda x: x.cast("double"))).otherwise(F.zip_with(a, delta, lambda x, y: x.cast("double") + y.cast("double"))))


def l2_normalised(a: Column) -> Column:
    """Unit vector; vectors shorter than 1e-9 stay as they are."""
    n = norm(a)
    return F.when(n > 1e-9, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
