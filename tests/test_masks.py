import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubes import cube_of
from pixeltide import errors
from pixeltide.operators import masks


def test_int_mask_and_drop(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 5.0, 3.0), (1, 1, 1, 0, 6.0, 4.0)], ("v", "scl"))
    out = masks.set_mask(cube, "scl", [3])
    assert out.bands == ("v",) and {r.x: r.v for r in out.df.collect()} == {0: None, 1: 6.0}
    assert masks.set_mask(cube, "scl", [3], drop_mask=False).bands == ("v", "scl")
    with pytest.raises(errors.BandMissing):
        masks.set_mask(cube, "none", [3])


def test_bit_masks_agree(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("v"))
    for bits in ([0], [3, 2], [7, 1]):
        assert df.filter(masks.bit_mask(F.col("v"), bits) != masks.bit_mask_by_remainder(F.col("v"), bits)).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bad=st.sets(st.tuples(st.integers(0, 6), st.integers(0, 8)), max_size=6), size=st.integers(1, 2))
def test_buffer_is_a_square_dilation(spark, bad, size):
    rows = [(1, 1, x, y, 1.0, float((x, y) in bad)) for x in range(7) for y in range(9)]
    out = masks.set_mask(cube_of(spark, rows, ("v", "m")), "m", [1.0], buffer=size).df.filter("v is null").collect()
    want = {(x, y) for x in range(7) for y in range(9) if any(max(abs(x - a), abs(y - b)) <= size for a, b in bad)}
    assert {(r.x, r.y) for r in out} == want


def test_created_mask_needs_its_bands(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 0.5, 0.5, 0.5), (1, 1, 1, 0, 0.1, 0.5, 0.5)], ("r", "g", "n"))
    out = masks.create_mask(cube, masks.brightness_mask(), red="r", green="g", nir="n")
    assert {r.x: r.cloud for r in out.df.collect()} == {0: 1.0, 1: 0.0} and out.mask_band == "cloud"
    with pytest.raises(errors.BandMissing):
        masks.create_mask(cube, masks.brightness_mask(), red="r", green="g")
