"""Thresholds of annotated crops, bands along the length, marker labels, subtypes, and their variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (stain, expression) pairs that make a subtype; a stain with + is positive. Fixed values.
SUBTYPES = {"Type Ia": ("CR+", "Ntng1-"), "Type Ib": ("CR+", "Ntng1+"), "Type Ic": ("CR-", "Ntng1+"), "Type II": ("Prph+",)}


def crop_thresholds(annotations: DataFrame) -> DataFrame:
    """From (crop, sign in 'pos' 'neg' 'between', intensity): crop, threshold.

    The median of the cells in between, else the mean of the lowest positive and the highest negative; a crop of only
    positive cells has 0, of only negative ones 1.5 times the highest.
    """
    s, v = F.col("sign"), F.col("intensity")
    g = annotations.groupBy("crop").agg(F.percentile(F.when(s == "between", v), F.lit(0.5)).alias("m"), F.min(F.when(s == "pos", v)).alias("p"), F.max(F.when(s == "neg", v)).alias("n"))
    one = F.when(F.col("n").isNull() & F.col("p").isNotNull(), F.lit(0.0)).when(F.col("p").isNull(), 1.5 * F.col("n")).otherwise((F.col("p") + F.col("n")) / 2)
    return g.select("crop", F.coalesce("m", one).alias("threshold"))


def mean_threshold(rows: DataFrame) -> DataFrame:
    """Mean over annotators, with how many gave one."""
    return rows.groupBy("crop").agg(F.avg("threshold").alias("threshold"), F.count("threshold").alias("success"), F.count_if(F.col("threshold").isNull()).alias("missing"))


def band_labels(cells: DataFrame, bands: DataFrame, value: str, most: int = 10_000) -> DataFrame:
    """cells with label: 1 at or over the threshold of the band whose open limits hold the fraction, 2 under it, else 0.

    bands (lo, hi, threshold) is one row for each crop; where several hold a fraction, the first by (lo, hi, threshold) counts. Up to `most` of them travel as an
    array. More meet the fractions in slots of [0, 1), one for each band; a band is dealt to the slots that it touches, so narrow bands, as many
    bands are, meet few fractions in vain. Both ways give the same rows.
    """
    v, f = F.col(value), F.col("length_fraction")
    number = bands.count()
    if number <= most:
        listed = bands.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "threshold")))).scalar()
        rows = cells.withColumn("_bands", listed)
        rows = rows.withColumn("_t", F.get(F.filter("_bands", lambda b: (f > b["lo"]) & (f < b["hi"])), F.lit(0))["threshold"]).drop("_bands")
    else:
        slot = lambda c: F.floor(F.least(F.greatest(c, F.lit(-1.0)), F.lit(2.0)) * number).cast("long")
        dealt = bands.where("lo < hi").select("lo", "hi", "threshold").withColumn("_slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
        places = cells.select(f.alias("_f")).where(f.isNotNull() & ~F.isnan(f)).distinct().withColumn("_slot", slot(F.col("_f")))
        held = places.join(dealt, "_slot").where((F.col("_f") > F.col("lo")) & (F.col("_f") < F.col("hi"))).groupBy("_f").agg(F.min(F.struct("lo", "hi", "threshold")).alias("_b"))
        rows = cells.join(held.select("_f", F.col("_b.threshold").alias("_t")), f == F.col("_f"), "left").drop("_f")
    t = F.col("_t")
    known = v.isNotNull() & ~F.isnan(v) & t.isNotNull()
    return rows.withColumn("label", F.when(known & (v >= t), 1).when(known & (v < t), 2).otherwise(0)).drop("_t")


def marker_volume_label(segment: Column, positive: Column, negative: Column) -> Column:
    """0, 1 positive, 2 negative; negative wins."""
    return F.when(segment == 0, 0).when(negative, 2).when(positive, 1).otherwise(0)


def count_labels(cells: DataFrame, by: str, label: str = "label") -> DataFrame:
    m = F.col(label)
    n = F.count_if(m.isin(1, 2))
    pct = lambda k: F.when(n > 0, F.bround(100.0 * F.count_if(m == k) / n, 4)).otherwise(0.0)
    return cells.groupBy(by).agg(F.count_if(m == 1).alias("positive"), F.count_if(m == 2).alias("negative"), pct(1).alias("positive_percent"), pct(2).alias("negative_percent"))


def subtype(markers: dict[str, Column]) -> Column:
    """Name of the subtype by the markers (1 positive, 2 negative) of the stains; null where none fits."""
    out = F.lit(None).cast("string")
    for name, needs in reversed(list(SUBTYPES.items())):
        if all(x[:-1] in markers for x in needs):
            test = F.lit(True)
            for x in needs:
                test = test & (markers[x[:-1]] == (1 if x[-1] == "+" else 2))
            out = F.when(test, name).otherwise(out)
    return out


def shares(table: DataFrame, by: list[str], kind: str) -> DataFrame:
    """by, kind, n and share of the kind in its group; rows without a kind are left out."""
    counted = table.where(F.col(kind).isNotNull()).groupBy(*by, kind).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def annotator_variance(rows: DataFrame) -> DataFrame:
    """From (crop, annotator, percent): crop, mean, variance and deviation (population), largest difference of a pair."""
    return rows.groupBy("crop").agg(F.avg("percent").alias("mean"), F.var_pop("percent").alias("variance"), F.stddev_pop("percent").alias("deviation"), (F.max("percent") - F.min("percent")).alias("spread"))


def annotator_offset(rows: DataFrame, by: str, value: str, is_reference: Column) -> DataFrame:
    """value less the group's reference value."""
    return rows.withColumn("offset", F.col(value) - F.max(F.when(is_reference, F.col(value))).over(Window.partitionBy(by)))


def find_annotations(files: DataFrame) -> DataFrame:
    """From (crop, sign): crop, pairing: both, positive, negative, or ambiguous (several of one sign)."""
    p, n = F.count_if(F.col("sign") == "pos"), F.count_if(F.col("sign") == "neg")
    kind = F.when((p > 1) | (n > 1), "ambiguous").when((p == 1) & (n == 1), "both").when(p == 1, "positive").when(n == 1, "negative").otherwise("none")
    return files.groupBy("crop").agg(kind.alias("pairing"))


def crop_fraction(cells: DataFrame, crops: DataFrame, halos: tuple[float, ...] = (20.0, 40.0, 80.0)) -> DataFrame:
    """crop, fraction, halo: mean fraction of the cells strictly inside the first halo that holds any.

    Cells and crops meet in the cells of a grid as wide as the largest halo.
    """
    wide = max(halos)
    g = [F.floor(F.col(f"anchor_{c}") / wide).alias(f"g{c}") for c in "xyz"]
    spread = crops
    for c in "xyz":
        spread = spread.withColumn(f"g{c}", F.explode(F.array(*[F.floor(F.col(f"center_{c}") / wide) + s for s in (-1, 0, 1)])))
    off = F.greatest(*[F.abs(F.col(f"anchor_{c}") - F.col(f"center_{c}")) for c in "xyz"])
    met = cells.select("length_fraction", *[f"anchor_{c}" for c in "xyz"], *g).join(spread, ["gx", "gy", "gz"]).withColumn("off", off).where(F.col("off") < wide)
    means = met.groupBy("crop").agg(*[F.avg(F.when(F.col("off") < h, F.col("length_fraction"))).alias(f"f{k}") for k, h in enumerate(halos)])
    halo = F.coalesce(*[F.when(F.col(f"f{k}").isNotNull(), F.lit(h)) for k, h in enumerate(halos)])
    return means.select("crop", F.coalesce(*[F.col(f"f{k}") for k in range(len(halos))]).alias("fraction"), halo.alias("halo"))
