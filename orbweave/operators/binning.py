"""Binning along the frequency axis and along the length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ranges import numbered

#: Lower edges of the octave bands in kHz; the last one is open above. Fixed values.
OCTAVES = {"mouse": (0.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), "gerbil": (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}


def octave_band(frequency: Column, animal: str) -> Column:
    """Number of the band, left-closed; null outside."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(OCTAVES[animal]):
        out = F.when(frequency >= low, k).otherwise(out)
    return out


def by_octave(table: DataFrame, animal: str, frequency: str, value: str, how: str = "mean") -> DataFrame:
    """band, value: mean or sum in each band; a band without rows stays, with null."""
    agg = {"mean": F.avg, "sum": F.sum}[how](value)
    found = table.groupBy(octave_band(F.col(frequency), animal).alias("band")).agg(agg.alias("value"))
    bands = table.sparkSession.range(len(OCTAVES[animal])).select(F.col("id").cast("int").alias("band"))
    return bands.join(found, "band", "left")


def transduction_efficiency(table: DataFrame, animal: str, frequency: str, marker: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Positive (1) over all marked (1 or 2) rows in each band; null where there are none."""
    m = F.col(marker)
    return table.groupBy(*by, octave_band(F.col(frequency), animal).alias("band")).agg(F.try_divide(F.count_if(m == 1), F.count_if(m.isin(1, 2))).alias("efficiency"))


def fraction_bin(fraction: Column, n: int) -> Column:
    """1..n, right-closed, 0 in the first one; null outside [0, 1]."""
    return F.when(fraction.between(0, 1), F.greatest(F.lit(1), F.ceil(fraction * n).cast("int")))


def average_by_fraction(table: DataFrame, n: int, fraction: str, value: str) -> DataFrame:
    return table.groupBy(fraction_bin(F.col(fraction), n).alias("bin")).agg(F.avg(value).alias("value")).where("bin is not null")


def histogram_bin(value: Column, n: int) -> Column:
    """0..n-1 on [0, 1], left-closed, the last one closed; compared with the edges k * (1 / n) themselves."""
    out = F.lit(None).cast("int")
    for k in range(n):
        out = F.when(value >= k * (1 / n), k).otherwise(out)
    return F.when(value <= 1, out)


def density_by_bins(table: DataFrame, n: int, fraction: str, length: float) -> DataFrame:
    """Rows in each bin over the bin's length."""
    counted = table.groupBy(histogram_bin(F.col(fraction), n).alias("bin")).agg(F.count("*").alias("c")).where("bin is not null")
    return table.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", (F.coalesce("c", F.lit(0)) / (length / n)).alias("density"))


def total_run_length(table: DataFrame, length: str, fraction: str) -> DataFrame:
    return table.where(F.col(fraction) > 0).agg(F.percentile(F.col(length) / F.col(fraction), F.lit(0.5)).alias("run_length"))


def sliding_density(table: DataFrame, value: str, low: float, high: float, points: int, window: float) -> DataFrame:
    """Rows within half a window (borders included) of each of `points` places; each row goes only to the places it meets."""
    step = (high - low) / (points - 1)
    v = F.col(value)
    first = F.greatest(F.lit(0), F.floor((v - window / 2 - low) / step).cast("long") - 1)
    last = F.least(F.lit(points - 1), F.ceil((v + window / 2 - low) / step).cast("long") + 1)
    hits = table.where(v.isNotNull() & (first <= last)).select(v.alias("v"), F.explode(F.sequence(first, last)).alias("point")).where(F.abs(F.col("v") - (low + F.col("point") * step)) <= window / 2)
    counted = hits.groupBy("point").agg(F.count("*").alias("n"))
    return table.sparkSession.range(points).select(F.col("id").alias("point")).join(counted, "point", "left").select("point", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(table: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The bin centre that parts the histogram with the most variance between the classes, the first among equals."""
    span = table.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    rows = table.where(F.col(value).isNotNull()).withColumns({"_lo": lo.cast("double"), "_hi": hi.cast("double")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    hist = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    hist = hist.withColumn("center", F.col("lo") + (F.col("hi") - F.col("lo")) / bins * (F.coalesce("bin", F.lit(0)) + 0.5))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("center")).over(up)
    w, s = F.sum("n").over(all_), F.sum(F.col("n") * F.col("center")).over(all_)
    gap = s1 / w1 - F.try_divide(s - s1, w - w1)
    scored = hist.select("bin", "center", (w1 * (w - w1) * gap * gap).alias("between"))
    return scored.where("between is not null").agg(F.max(F.struct("between", (-F.col("bin")).alias("b"), "center")).alias("x")).select(F.col("x.center").alias("threshold"))


def largest_gaps(table: DataFrame, value: str, n: int) -> DataFrame:
    """The n widest gaps between neighbouring distinct values."""
    d = numbered(table.select(F.col(value).alias("low")).where("low is not null").distinct(), ["low"], "place")
    gaps = d.join(d.select((F.col("place") - 1).alias("place"), F.col("low").alias("high")), "place").select("low", "high")
    return gaps.withColumn("gap", F.col("high") - F.col("low")).orderBy(F.desc("gap"), "low").limit(n)
