import pytest

from cubes import cube_of
from pixeltide import errors
from pixeltide.functions import geometry
from pixeltide.model import GridSpec, default_nodata
from pixeltide.operators import grids, rendering, tiles
from pixeltide.sources import catalog, rasters, sinks


def items(spark, n):
    rows = [
        (f"i{i}", "s2", [-1 + 0.1 * i, 50 + 0.1 * i, 1 + 0.1 * i, 52 + 0.1 * i], f"2023-01-{i:02d} 12:00:00", 10.0 * i, "ascending" if i % 2 == 0 else "descending", "p", {"B04": ("u4",), "B03": ("u3",)}, i)
        for i in range(1, n + 1)
    ]
    df = spark.createDataFrame(rows, "id string, collection string, bbox array<double>, d string, cloud_cover double, orbit_state string, platform string, assets map<string,struct<href:string>>, pos int")
    return df.withColumn("datetime", df.d.cast("timestamp_ntz")).drop("d")


def test_filters(spark):
    assert catalog.cloud_filter(items(spark, 5), 25).count() == 2
    assert catalog.orbit_filter(items(spark, 4), "ascending").count() == 2
    assert catalog.orbit_filter(items(spark, 4), ["ascending", "descending"]).count() == 4
    assert catalog.coverage_filter(items(spark, 5), (-0.5, 50.5, 0.5, 51), 0.9).count() == 5
    with pytest.raises(errors.OutOfRange):
        catalog.coverage_filter(items(spark, 1), (0, 0, 1, 1), 2)


def test_duplicates_keep_the_first(spark):
    from pyspark.sql import functions as F

    two = items(spark, 2)
    copy = two.filter("pos = 1").withColumns({"id": F.lit("copy"), "pos": F.lit(9)})
    out = catalog.drop_duplicates(two.unionByName(copy), F.col("pos"))
    assert sorted(r.id for r in out.collect()) == ["i1", "i2"]


def test_assets_and_plan(spark):
    one = catalog.select_assets(items(spark, 1), ["B03"])
    assert list(one.first().assets) == ["B03"]
    assert catalog.sign_assets(one, "t").first().assets["B03"].href == "u3?t"
    plan = catalog.plan(items(spark, 3), "/vsicurl/").collect()
    assert [r.id for r in plan] == ["i1", "i2", "i3"] and plan[0].sources == ["/vsicurl/u3", "/vsicurl/u4"]
    assert catalog.has_collection(items(spark, 1), "s2") and not catalog.has_collection(items(spark, 1), "s1")
    with pytest.raises(errors.BandMissing):
        catalog.need_assets(items(spark, 1), ["B99"])


def test_boxes():
    assert geometry.validate_box((131, -11.3, 130.8, -11.5)) == (130.8, -11.5, 131, -11.3)
    for bad in ((1, 2, 3), (1, 2, 1, 4), (0, 0, 200, 1), (0, 0, 1, 95), ("a", 0, 1, 1)):
        with pytest.raises(errors.BadBox):
            geometry.validate_box(bad)
    assert geometry.utm_zone(-3.51) == 30 and geometry.utm_zone(-3.51, rounded=True) == 29
    assert "+proj=laea" in geometry.projection_for((-4, 50, -3, 51)) and "+zone=30" in geometry.projection_for((-4, 50, -3, 51), "utm")


def test_grid():
    grid = GridSpec("EPSG:1", 100, 200, 300, 400, 50, 50)
    assert grid.geotransform == (100, 50, 0, 400, 0, -50)
    snapped = GridSpec("EPSG:1", 289813.58, 88876.43, 297031.04, 95714.02, 19.9929669011164, 19.9929669011164).snapped()
    assert round(snapped.xmin, 2) == 289798.06
    assert default_nodata("Byte") == 255 and default_nodata("Float32") is None and default_nodata("other") == 0


def test_arrays(spark):
    df, grid = rasters.from_array(spark, [1, 2, None, 4, 5, None, 7, 8, 9], 3, 3, (100, 200, 400, 500), pixel_type="Byte")
    assert {(r.x, r.y): r.value for r in df.collect()}[2, 1] == 255.0 and grid.xres == 100
    nested, grid = rasters.from_array(spark, [[1, 2], [3, 4], [5, 6]], nbands=2)
    got = {(r.band, r.x, r.y): r.value for r in nested.collect()}
    assert (grid.nx, grid.ny) == (3, 2) and got[1, 2, 1] == 6.0 and got[2, 0, 0] is None
    with pytest.raises(errors.LengthMismatch):
        rasters.from_array(spark, [1, 2, 3], 2, 2)


def test_tiles(spark):
    assert tiles.tile_size(10000, 10000, 512, 512, 1000) == (512, 512)
    assert tiles.tile_size(10000, 10000, 285, 512, 20) == (10000, 512)
    table = tiles.tile_table(spark, 10000, 10000, 10000, 512).orderBy("y_off").collect()
    assert len(table) == 20 and table[-1].y_size == 272
    assert tiles.chunks(100, 10, 2, 0.5) == 40


def test_warp_forces_classes_and_keeps_constants(spark):
    rows = [(1, 1, x, y, 5.0, float(x % 2)) for x in range(4) for y in range(4)]
    cube = cube_of(spark, rows)
    for method in ("near", "bilinear", "cubic", "cubicspline", "lanczos"):
        got = [r.a for r in grids.warp(cube, 2, 2, 2.0, method).df.collect()]
        assert got == pytest.approx([5.0] * 4), method
    from dataclasses import replace

    assert {r.b for r in grids.coarsen(replace(cube, mask_band="b"), 4).df.collect()} == {0.0}


def test_sinks(spark, tmp_path):
    from dataclasses import replace

    from pixeltide.operators import bands

    cube = bands.set_nodata(cube_of(spark, [(1, 1, 0, 0, 1.0, None), (2, 2, 0, 0, 2.0, 3.0)]), -1.0)
    cube = replace(cube, grid=GridSpec("s", 0, 0, 1, 1, 1, 1))
    back = sinks.recollect(spark, cube, str(tmp_path / "c"), by_item=True)
    assert sorted((r.a, r.b) for r in back.df.collect() if r.b is None) == [(1.0, None)]
    again = sinks.from_json(spark, sinks.describe_json(cube), str(tmp_path / "c"))
    assert again.bands == cube.bands and again.grid == cube.grid and again.df.filter("b is null").count() == 1
    with pytest.raises(errors.OutOfRange):
        sinks.write(cube, str(tmp_path / "d"), "gif")


def test_median_date(spark):
    cube = cube_of(spark, [(i, 19723 + d, 0, 0, 1.0) for i, d in enumerate((0, 60, 121, 182, 244))], ("a",))
    assert cube.df.agg(sinks.median_date(cube.df.t).alias("d")).first().d == "median date: 2024-05-01"


def test_labels():
    assert rendering.label_digits([1, 2, 3]) == 0 and rendering.label_digits([1500.5, 2]) == 0
    assert rendering.label_digits([0.1, 1.5]) == 0 and rendering.label_digits([0.01, 0.03]) == 2 and rendering.label_digits([]) == 0
    assert rendering.label_digits([0.1, 0.1004, 2]) == 4 and rendering.label_digits([0.5]) == 3 and rendering.label_digits([1e-30, 2e-30]) == 15
    for labels in ([0.25, 0.5, 0.75], [1.1, 1.12, 1.125], [12.5, 100.25]):
        assert len({round(v, rendering.label_digits(labels)) for v in labels}) == len(labels)


def test_save_and_load(spark, tmp_path):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, None)])
    sinks.save(cube, str(tmp_path / "s"))
    back = sinks.load(spark, str(tmp_path / "s"))
    assert back.bands == cube.bands and [(r.a, r.b) for r in back.df.collect()] == [(1.0, None)]
    with pytest.raises(errors.OutOfRange):
        sinks.save(cube, str(tmp_path / "t"), bundle=False)
    assert sinks.writer_options("fast", a="b") == {"compression": "snappy", "a": "b"}


def test_descriptions_notes_and_system_travel(spark, tmp_path):
    from dataclasses import replace

    from pixeltide.model import GridSpec
    from pixeltide.operators import bands

    cube = replace(cube_of(spark, [(1, 1, 0, 0, 1.0, 2.0)]), grid=GridSpec("EPSG:32630", 0, 0, 2, 2, 1, 1))
    cube = bands.set_notes(bands.set_descriptions(cube, ["first", "second"]), made="today", gone="x")
    cube = bands.set_notes(cube, gone=None)
    with pytest.raises(errors.LengthMismatch):
        bands.set_descriptions(cube, ["one"])
    sinks.save(cube, str(tmp_path / "c"))
    back = sinks.load(spark, str(tmp_path / "c"))
    assert back.notes == {"made": "today"} and [back.of(b).description for b in back.bands] == ["first", "second"]
    stored = spark.read.parquet(str(tmp_path / "c" / "rows"))
    assert rasters.system_of(stored) == "EPSG:32630" and stored.schema["a"].metadata["description"] == "first"
    assert rasters.system_of(spark.range(1).selectExpr("id AS x")) is None


def test_gather_follows_sources(spark, tmp_path):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, None)])
    at = lambda *p: str(tmp_path.joinpath(*p))
    sinks.write(cube, at("one", "rows"))
    sinks.write(cube, at("two", "rows"))
    sinks.save(cube, at("inner"), sources={"deep": at("two", "rows"), "self": at("outer")})
    sinks.save(cube, at("outer"), sources={"a": at("one", "rows"), "b": at("inner"), "c": at("lost"), "d": "s3://far/rows"})
    with pytest.warns(UserWarning) as said:
        found = sinks.gather(spark, at("outer"), at("moved"))
    assert sorted((a.split("/")[-2:], n, s) for a, n, s in found) == sorted(
        [(["one", "rows"], "rows", "copied"), ([tmp_path.name, "inner"], "inner", "copied"), ([tmp_path.name, "lost"], "", "missing"),
         (["far", "rows"], "", "remote"), (["two", "rows"], "rows_1", "copied")]
    )
    told = [str(w.message) for w in said if issubclass(w.category, UserWarning)]
    assert len(told) == 2 and at("lost") in told[0], [str(w) for w in said]
    assert sinks.load(spark, at("moved")).df.count() == 1
    assert sinks.load(spark, at("moved", "sources", "inner")).df.count() == 1
    assert spark.read.parquet(at("moved", "sources", "rows_1")).count() == 1
    for path, target in ((at("nowhere"), at("m")), (at("outer"), at("moved"))):
        with pytest.raises(errors.OutOfRange):
            sinks.gather(spark, path, target)


def test_workspace_is_removed_as_a_whole(spark, tmp_path):
    from pixeltide.sources.folders import Workspace

    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, None)])
    with Workspace(spark, str(tmp_path / "w")) as work:
        back = sinks.recollect(spark, cube, work.path("cube"))
        assert back.df.count() == 1 and work.path("cube") != work.path("cube")
    assert not (tmp_path / "w").exists()
    (tmp_path / "mine").mkdir()
    with pytest.raises(errors.OutOfRange):
        Workspace(spark, str(tmp_path / "mine"))
    with pytest.raises(errors.OutOfRange):
        work.destroy()


def test_registered_pixel_function(spark):
    from pyspark.sql import functions as F

    from pixeltide.functions import pixel
    from pixeltide.operators import composites

    pixel.register("spread", lambda v: F.max(v) - F.min(v))
    try:
        cube = cube_of(spark, [(1, 1, 0, 0, 1.0, 2.0), (2, 2, 0, 0, 4.0, 2.0)])
        assert composites.composite(cube, "spread").first().a == 3.0
        with pytest.raises(errors.OutOfRange):
            pixel.register("median", F.median)
    finally:
        del pixel.AGGREGATES["spread"]


def test_tokens_expire_and_are_kept():
    now, issued = [0.0], []
    tokens = catalog.Tokens(lambda c: (issued.append(c) or f"{c}{len(issued)}", 100), margin=10, clock=lambda: now[0])
    assert tokens.get("a") == tokens.get("a") == "a1" and tokens.get("b") == "b2"
    now[0] = 89
    assert tokens.get("a") == "a1"
    now[0] = 90
    assert tokens.get("a") == "a3"
    tokens.forget("a")
    assert tokens.get("a") == "a4"
    tokens.forget()
    assert tokens.get("b") == "b5"


def test_presets_check_their_arguments(spark):
    box, span = (-1, 50, 1, 52), ("2023-01-01", "2023-02-01")
    assert catalog.sentinel2_query(items(spark, 3), box, *span, collection="s2", max_cloud_cover=None).count() == 3
    assert catalog.sentinel1_query(items(spark, 3), box, *span, collection="s2", orbit_state="ascending").count() == 1
    for wrong in (lambda: catalog.hls_query(items(spark, 1), box, *span, "HLSS30_2.0"), lambda: catalog.hls_query(items(spark, 1), box, *span, source="x"), lambda: catalog.orbit_filter(items(spark, 1), "sideways"), lambda: catalog.orbit_filter(items(spark, 1), [])):
        with pytest.raises(errors.OutOfRange):
            wrong()


def test_a_cube_is_not_overwritten_while_it_is_read(spark, tmp_path):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, None)])
    back = sinks.recollect(spark, cube, str(tmp_path / "a"))
    with pytest.raises(errors.OutOfRange):
        sinks.recollect(spark, back, str(tmp_path / "a"), mode="overwrite")
    assert sinks.recollect(spark, back, str(tmp_path / "b")).df.count() == sinks.recollect(spark, cube, str(tmp_path / "b"), mode="overwrite").df.count() == 1


def test_projection_strings():
    assert "+lat_1=51 +lat_2=50" in geometry.projection_for((-4, 50, -3, 51), "eqdc")
    assert geometry.projection_for((-4, 50, -3, 51), specific="EPSG:27700") == "EPSG:27700"
    with pytest.raises(errors.OutOfRange):
        geometry.projection_for((-4, 50, -3, 51), specific="EPSG:4326")
