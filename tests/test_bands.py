import random

import pytest

from orbweave.operators.annotate import band_labels
from orbweave.plans import catalog


def test_both_ways_of_bands_agree(spark):
    rng = random.Random(4)
    edge = lambda: rng.choice([rng.random(), -0.2, 0.0, 0.5, 1.0, 1.3])
    bands = [(*sorted((edge(), edge())), rng.choice([None, 5.0, 20.0])) for _ in range(60)]
    cells = [(k, rng.choice([None, float("nan"), rng.random(), 0.5, 1.0, 0.0]), rng.choice([None, float("nan"), 1.0, 5.0, 10.0, 30.0])) for k in range(400)]
    c, b = spark.createDataFrame(cells, "label_id long, length_fraction double, value double"), spark.createDataFrame(bands, "lo double, hi double, threshold double")
    few, many = ({r.label_id: r.label for r in band_labels(c, b, "value", most=most).collect()} for most in (1000, 10))
    assert few == many and len(few) == 400 and set(few.values()) == {0, 1, 2}
    for k, f, v in cells:
        held = sorted((x for x in bands if f is not None and x[0] < f < x[1]), key=lambda x: (x[0], x[1], -1.0 if x[2] is None else x[2]))
        t = held[0][2] if held else None
        known = v is not None and v == v and t is not None
        assert few[k] == (0 if not known else 1 if v >= t else 2)


def test_a_name_is_registered_once():
    with pytest.raises(ValueError, match="twice: a"):
        catalog._united([{"a": 1}, {"b": 2}, {"a": 3}])
    assert len(catalog.queries()) == sum(len(m.QUERIES) for m in catalog.MODULES)
