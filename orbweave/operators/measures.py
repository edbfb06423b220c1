"""Intensity statistics of objects from the values of their voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percentiles reported for each object.
PERCENTILES = (5, 10, 25, 75, 90, 95)


def intensity_aggregates(value: str, digits: int | None = None) -> list[Column]:
    """median, mean, stdev (population), min, max and the percentiles (linear interpolation) of a column."""
    v = F.col(value)
    # one aggregate for all of them, so that a label's values are held once
    at = F.percentile(v, F.array(F.lit(0.5), *[F.lit(p / 100) for p in PERCENTILES]))
    out = {
        "median": F.get(at, F.lit(0)),
        "mean": F.avg(v),
        "stdev": F.stddev_pop(v),
        "min": F.min(v),
        "max": F.max(v),
    } | {f"percentile_{p}": F.get(at, F.lit(k + 1)) for k, p in enumerate(PERCENTILES)}
    # ties go up, and a bit below them already: a mean can be a tie but for the order of its sum
    return [(c if digits is None else F.bround(c + 10.0 ** -(digits + 3), digits)).alias(name) for name, c in out.items()]


def object_measures(voxels: DataFrame, label: str = "label", value: str = "value", background: int | None = 0, digits: int | None = None) -> DataFrame:
    """One row for each label: label_id, count and intensity statistics.

    One hash aggregate with map-side partials; no group is materialised in Python. Labels that are null or the
    background are left out, null values are ignored, an empty input gives no rows.
    """
    kept = voxels.where(F.col(label).isNotNull())
    if background is not None:
        kept = kept.where(F.col(label) != background)
    return kept.groupBy(F.col(label).alias("label_id")).agg(F.count(value).alias("n"), *intensity_aggregates(value, digits))
