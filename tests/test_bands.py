import pytest

from cubes import cube_of
from pixeltide import errors
from pixeltide.operators import bands, sets
from pixeltide.sources.sinks import to_nodata

ROWS = [(1, 1, 0, 0, 10.0, 30.0), (2, 2, 0, 0, 20.0, None)]


def test_rename_and_length(spark):
    cube = bands.rename(cube_of(spark, ROWS), ["B1", "B2"])
    assert cube.bands == ("B1", "B2")
    with pytest.raises(errors.LengthMismatch):
        bands.rename(cube, ["only"])


def test_move_band(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, 2.0, 3.0, 4.0)], ("B02", "B03", "B04", "B08"))
    assert bands.move(cube, 1, 2).bands == ("B03", "B02", "B04", "B08")
    assert bands.move(cube, 4, 0).bands == ("B08", "B02", "B03", "B04")
    for band, after in ((0, 1), (5, 1), (1, 5), (2, 2)):
        with pytest.raises(errors.OutOfRange):
            bands.move(cube, band, after)


def test_add_empty_takes_the_first_scale(spark):
    cube = bands.set_scale(cube_of(spark, ROWS), [0.5, 2.0])
    more = bands.add_empty(cube, 1, "new")
    assert more.bands == ("a", "new", "b") and more.of("new").scale == 0.5
    assert more.df.filter("new is not null").count() == 0


def test_scale_is_an_annotation(spark):
    cube = bands.set_scale(cube_of(spark, ROWS), 0.1, 1.0, "a")
    assert [r.a for r in cube.df.orderBy("item").collect()] == [10.0, 20.0]
    assert [r.a for r in bands.apply_scale(cube).df.orderBy("item").collect()] == pytest.approx([2.0, 3.0])


def test_nodata_of_source_and_band(spark):
    cube = bands.set_nodata(cube_of(spark, ROWS), -9.0, 20.0, "a")
    assert [r.a for r in cube.df.orderBy("item").collect()] == [10.0, None]
    assert [r.a for r in to_nodata(cube).orderBy("item").collect()] == [10.0, -9.0]


def test_derive_uses_each_bands_own_scale(spark):
    cube = bands.set_scale(cube_of(spark, [(1, 1, 0, 0, 10.0, 30.0)]), [0.1, 0.01], [0.0, 1.0])
    got = bands.derive(cube, d="(b - a) / (b + a)").df.first().d
    assert got == pytest.approx((1.3 - 1.0) / (1.3 + 1.0))


def test_derive_division_by_zero_and_wrong_names(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, -1.0)])
    assert bands.derive(cube, d="a / (a + b)").df.first().d is None
    with pytest.raises(errors.BandMissing):
        bands.derive(cube, d="a + nothing")
    with pytest.raises(errors.BandMissing):
        bands.derive(cube, d="1 + 2")


def test_concat_counts_and_lengths(spark):
    five = cube_of(spark, [(i, i, 0, 0, 1.0, 2.0) for i in range(5)])
    one = cube_of(spark, [(9, 0, 0, 0, 1.0, 2.0)])
    assert sets.concat(five, five).df.count() == 10
    assert sets.concat(five, one).df.count() == sets.concat(one, five).df.count() == 6
    with pytest.raises(errors.LengthMismatch):
        sets.concat(five, cube_of(spark, [(1, 1, 0, 0, 1.0)], ("a",)))
    assert [r.item for r in sets.in_order(sets.concat(five, one)).collect()][:2] == [0, 9]


def test_harmonize_fills_missing_bands(spark):
    out = sets.harmonize(cube_of(spark, ROWS), cube_of(spark, [(3, 3, 0, 0, 7.0)], ("c",)))
    assert out.bands == ("a", "b", "c") and out.df.filter("c = 7 and a is null").count() == 1
