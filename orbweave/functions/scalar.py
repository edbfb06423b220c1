"""Column functions: frequency maps, scores, names and places written as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A, a, k of A * (10 ** (a * x) - k), x the fraction of the length. Fixed values.
GREENWOOD = {
    "mouse": (1.46, 1.77, 0.0),
    "gerbil": (0.35, 2.1, 0.7),
    "mouse_otof": (1.0, 100 / 82.5, -0.684848485),
}


def greenwood(fraction: Column, animal: str, otof: bool = False) -> Column:
    """Frequency in kHz at a fraction of the run length; an unknown animal raises ValueError."""
    name = f"{animal}_otof" if otof else animal
    if name not in GREENWOOD:
        raise ValueError(f"no frequency map for {name}")
    scale, slope, shift = GREENWOOD[name]
    return F.lit(scale) * (F.pow(F.lit(10.0), F.lit(slope) * fraction) - F.lit(shift))


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp, tp + fp)


def f1(p: Column, r: Column) -> Column:
    """Null where a part is null or both are 0."""
    return F.try_divide(2 * p * r, p + r)


def scores(tp: Column, fp: Column, fn: Column, digits: int = 3) -> dict[str, Column]:
    """precision, recall and f1 score, half-even; null where undefined."""
    p, r = precision(tp, fp), precision(tp, fn)
    return {"precision": F.bround(p, digits), "recall": F.bround(r, digits), "f1_score": F.bround(f1(p, r), digits)}


def percentage(count: Column, total: Column, digits: int = 4) -> Column:
    return F.when(total > 0, F.bround(100.0 * count / total, digits)).otherwise(F.lit(0.0))


def stain_ratio(value: Column, reference: Column) -> Column:
    """Null where the reference is 0."""
    return F.try_divide(value, reference)


def coordinates(text: Column) -> Column:
    """'x-y-z' to an array of ints; null where a part is no number."""
    return F.transform(F.split(text, "-"), lambda c: c.try_cast("int"))


def threshold_from_name(name: Column) -> Column:
    """The number at the start of the last part of a file name, with or without 'thr' before it."""
    last = F.element_at(F.split(name, "_"), -1)
    return F.regexp_extract(last, r"^(?:thr)?(\d+(?:\.\d+)?)", 1).try_cast("double")


def crop_suffix(x: Column, y: Column, z: Column, width: int = 4) -> Column:
    return F.concat_ws("-", *[F.lpad(F.bround(c).cast("long").cast("string"), width, "0") for c in (x, y, z)])


def standard_name(name: Column) -> Column:
    """'MLR226L' to 'M_LR_000226_L'; other names stay."""
    pattern = r"^([A-Z])([A-Z]+?)(\d+)([LR])$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.concat_ws("_", part(1), part(2), F.lpad(part(3), 6, "0"), part(4))).otherwise(name)


def voxel(position: Column, size: float) -> Column:
    """The voxel that a place in micrometres rounds to, half-even."""
    return F.rint(position / size).cast("long")


def capture_parts(name: Column) -> dict[str, Column]:
    """timepoint, channel, tile, illumination, detection and setup id out of a file name; missing ones are 0."""
    number = lambda key: F.coalesce(F.nullif(F.regexp_extract(name, rf"_{key}(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    t, c, r, i, d = (number(k) for k in ("t", "C", "R", "I", "D"))
    return {"timepoint": t, "channel": c, "tile": r, "illumination": i, "detection": d, "setup": F.format_string("c%d-t%d-i%d-d%d", c, r, i, d)}


def voxel_size(text: str | float | tuple | list) -> tuple[float, float, float]:
    """A number, 'a,b,c', or one or three numbers, as a triple."""
    parts = [float(x) for x in (text.split(",") if isinstance(text, str) else text if isinstance(text, (tuple, list)) else [text])]
    if len(parts) not in (1, 3):
        raise ValueError(f"a voxel size has one or three parts, not {len(parts)}")
    return tuple(parts * 3 if len(parts) == 1 else parts)  # type: ignore[return-value]


def species(name: Column) -> Column:
    """Species by the first part of a data set's name."""
    return F.coalesce(F.element_at(F.create_map(F.lit("M"), F.lit("mouse"), F.lit("G"), F.lit("gerbil")), F.element_at(F.split(name, "_"), 1)), F.lit("other"))


def density_per_mm2(density: Column) -> Column:
    return density * 1e6
