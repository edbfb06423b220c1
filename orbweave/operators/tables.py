"""Operators on tables of objects: derived columns, filters, joins by id, nearest rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.ranges import numbered
from orbweave.operators.spatial import nearest_node


def add_volume(objects: DataFrame, voxel: tuple[float, float, float], name: str = "volume") -> DataFrame:
    """n_pixels times the voxel's volume, where the column is missing."""
    return objects if name in objects.columns else objects.withColumn(name, F.col("n_pixels") * voxel[0] * voxel[1] * voxel[2])


def filter_table(table: DataFrame, column: str, subset: Iterable) -> DataFrame:
    return table.where(F.col(column).isin(*subset))


def size_between(objects: DataFrame, low: int, high: int) -> DataFrame:
    return objects.where(F.col("n_pixels").between(low, high))


def overlaps_slice(objects: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """Objects whose box meets the slice, borders included."""
    return objects.where((F.col(f"bb_min_{axis}") <= high) & (F.col(f"bb_max_{axis}") >= low))


def near_fraction(objects: DataFrame, reference: float, tolerance: float, column: str = "length_fraction") -> DataFrame:
    return objects.where(F.abs(F.col(column) - reference) <= tolerance)


def inside_box(objects: DataFrame, center: tuple[float, float, float], halo: float) -> DataFrame:
    """Strictly inside."""
    test = F.lit(True)
    for axis, c in zip("xyz", center, strict=True):
        test = test & (F.col(f"anchor_{axis}") > c - halo) & (F.col(f"anchor_{axis}") < c + halo)
    return objects.where(test)


def add_column(table: DataFrame, other: DataFrame, column: str, target: str | None = None, key: str = "label_id") -> DataFrame:
    """column of another table by key, under the target name; a column of that name goes first."""
    target = target or column
    return table.drop(target).join(other.select(key, F.col(column).alias(target)), key, "left")


def add_measures(table: DataFrame, measures: dict[str, DataFrame], column: str = "median", key: str = "label_id") -> DataFrame:
    """One column for each stain: its measure by id, null where there is none."""
    for stain, m in measures.items():
        table = add_column(table, m, column, f"{stain}_{column}", key)
    return table


def main_table(objects: DataFrame, components: Iterable[int], measures: dict[str, DataFrame], voxel: tuple[float, float, float]) -> DataFrame:
    """Objects of the components, with volume, distance from the center and the stains' medians."""
    kept = add_volume(filter_table(objects, "component_labels", components), voxel)
    return add_measures(kept.withColumnRenamed("offset", "dist_from_center"), measures)


#: So many values at most meet every row of a table.
FEW_VALUES = 16


def nearest_rows(table: DataFrame, values: DataFrame, column: str, order: str = "label_id") -> DataFrame:
    """For each distinct row of values (value): the row of table nearest in column, the first by order among equals.

    Both sides meet in cells of the column's range, which widen for values that have no row near; a null value, and a
    row without the column, meets nothing. Up to FEW_VALUES values, which a count shows, travel as one array to all rows
    instead, and one aggregate with a partial one before its shuffle finds the rows.
    """
    wanted = values.select(F.col("value").cast("double")).where("value is not null").distinct()
    nodes = table.where(F.col(column).isNotNull())
    if wanted.count() <= FEW_VALUES:
        all_values = wanted.agg(F.collect_list("value")).scalar()
        gap = F.abs(F.col(column).cast("double") - F.col("value")).alias("gap")
        met = nodes.select(F.col(column), F.col(order), F.explode(all_values).alias("value"))
        near = met.groupBy("value").agg(F.min(F.struct(gap, F.col(order).alias("node"))).alias("near")).select("value", F.col("near.node").alias(order))
        return near.join(nodes, order).select("value", *table.columns)
    low, high, n = nodes.agg(F.min(column).cast("double"), F.max(column).cast("double"), F.count("*")).first()
    if not n:
        return table.limit(0).select(F.lit(None).cast("double").alias("value"), "*")
    near = nearest_node(wanted, nodes, "value", order, ("value",), (column,), most=0, radius=max((high - low) / n, 1e-12)).select("value", F.col("node").alias(order))
    return near.join(nodes, order).select("value", *table.columns)


def relabel(table: DataFrame, key: str, name: str = "new_label") -> DataFrame:
    """Numbers 1..n in order of a key (labels of a volume). Rows without a key go."""
    return table.join(numbered(table.select(key).where(F.col(key).isNotNull()).distinct(), [key], name), key)


def mark_members(table: DataFrame, ids: DataFrame, name: str, key: str = "label_id") -> DataFrame:
    """1 for rows whose key is in ids, else 0."""
    return table.join(ids.select(key).distinct().withColumn(name, F.lit(1)), key, "left").fillna(0, [name])


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """New values where the row was made again, else the old ones."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    columns = set(columns)
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def complete(table: DataFrame, columns: Iterable[str], total: str, parts: Iterable[str]) -> Column:
    """Whether no column is null and the parts add up to the total."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test & (F.col(total) == sum((F.col(p) for p in parts), F.lit(0)))


def overlapping_boxes(boxes: DataFrame, cell: float, key: str = "label_id") -> DataFrame:
    """Pairs a < b of boxes that overlap strictly on all axes.

    Boxes are dealt to the grid cells that they touch and meet only there; a pair counts in the cell that holds the
    upper of the two lower corners, so none comes twice.
    """
    low, high = [F.floor(F.col(f"bb_min_{c}") / cell) for c in "xyz"], [F.floor(F.col(f"bb_max_{c}") / cell) for c in "xyz"]
    dealt = boxes.select(F.col(key).alias("id"), *[F.col(f"bb_{n}_{c}") for n in ("min", "max") for c in "xyz"], *[F.sequence(a, b).alias(f"s{c}") for c, a, b in zip("xyz", low, high, strict=True)])
    for c in "xyz":
        dealt = dealt.withColumn(f"g{c}", F.explode(f"s{c}")).drop(f"s{c}")
    a, b = dealt.alias("a"), dealt.alias("b")
    test = F.col("a.id") < F.col("b.id")
    for c in "xyz":
        test = test & (F.col(f"a.bb_min_{c}") < F.col(f"b.bb_max_{c}")) & (F.col(f"b.bb_min_{c}") < F.col(f"a.bb_max_{c}"))
        test = test & (F.col(f"a.g{c}") == F.col(f"b.g{c}")) & (F.floor(F.greatest(f"a.bb_min_{c}", f"b.bb_min_{c}") / cell) == F.col(f"a.g{c}"))
    return a.join(b, test).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
