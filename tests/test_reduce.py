import numpy as np
import pytest
from pyspark.sql import functions as F

from cubes import cube_of, values
from pixeltide import errors
from pixeltide.functions.distances import DISTANCES
from pixeltide.operators import composites, reducers, series


def test_composites_keep_empty_cells(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0, None), (2, 2, 0, 0, 3.0, None), (3, 3, 1, 0, None, 2.0)])
    got = {r.x: (r.a, r.b) for r in composites.composite(cube, "median").collect()}
    assert got == {0: (2.0, None), 1: (None, 2.0)}
    assert {r.x: r.a for r in composites.composite(cube, "min", propagate=True).collect()} == {0: 1.0, 1: None}
    with pytest.raises(errors.OutOfRange):
        composites.composite(cube, "nothing")


def test_mosaic_takes_the_latest_valid_value(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, 1.0), (2, 3, 0, 0, None), (3, 2, 0, 0, 7.0)], ("a",))
    assert composites.mosaic(cube).first().a == 7.0


def test_product_has_signs_and_zeros(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, -2.0), (2, 2, 0, 0, 3.0), (1, 1, 1, 0, 0.0), (2, 2, 1, 0, 3.0)], ("a",))
    assert {r.x: round(r.a, 9) for r in composites.composite(cube, "mul").collect()} == {0: -6.0, 1: 0.0}


def test_harmonic_mean_with_zeros(spark):
    rows = [(1, 1, 0, 0, 0.0), (2, 2, 0, 0, 4.0), (1, 1, 1, 0, 2.0), (2, 2, 1, 0, 6.0), (3, 3, 1, 0, None), (1, 1, 2, 0, None), (1, 1, 3, 0, 0.0)]
    cube = cube_of(spark, rows, ("a",))
    assert {r.x: r.a for r in composites.composite(cube, "harmonic_mean").collect()} == {0: 0.0, 1: 3.0, 2: None, 3: 0.0}


def test_medoid_is_an_observation_and_fills_gaps(spark):
    rows = [(1, 1, 0, 0, 5.0, None, 5.0), (2, 2, 0, 0, 1.0, 1.0, 1.0), (3, 3, 0, 0, 10.0, 10.0, 10.0), (4, 4, 0, 0, 9.0, 9.0, 9.0)]
    cube = cube_of(spark, rows, ("a", "b", "c"))
    assert values(reducers.medoid(cube), "a", "b", "c") == [(5.0, 9.0, 5.0)]
    assert values(reducers.medoid(cube, impute=False), "a", "b", "c") == [(5.0, None, 5.0)]


def test_one_row_is_returned_as_it_is(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, None, 4.0), (2, 2, 0, 0, None, None), (1, 1, 1, 0, None, None)])
    got = {r.x: (r.a, r.b) for r in reducers.medoid(cube).collect()}
    assert got == {0: (None, 4.0), 1: (None, None)}
    got = {r.x: (r.a, r.b) for r in reducers.geomedian(cube).collect()}
    assert got == {0: (None, 4.0), 1: (None, None)}


def test_ties_go_to_the_earliest_row(spark):
    cube = cube_of(spark, [(1, 2, 0, 0, 1.0, 1.0), (2, 1, 0, 0, 3.0, 3.0)])
    assert values(reducers.medoid(cube), "a", "b") == [(3.0, 3.0)]


@pytest.mark.parametrize("name", sorted(DISTANCES))
def test_every_distance_runs_and_skips_missing_bands(spark, name):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0, None), (0.2, 0.3, 0.4, 0.1, None)], "a double, b double, c double, d double, e double")
    got = [r[0] for r in df.select(DISTANCES[name]([F.col("a"), F.col("b"), F.col("e")], [F.col("c"), F.col("d"), F.col("e")])).collect()]
    assert len(got) == 2 and got[1] is not None


def test_distances_by_hand(spark):
    df = spark.createDataFrame([(1.0, 4.0, 3.0, 2.0)], "a double, b double, c double, d double")
    a, c = [F.col("a"), F.col("b")], [F.col("c"), F.col("d")]
    want = {"euclidean": 8**0.5, "manhattan": 4, "minimum": 2, "maximum": 2, "canberra": 2 / 4 + 2 / 6, "chi_square": 4 / 4 + 4 / 6, "sorensen": 0.4,
            "kulczynski": 4 / 3, "soergel": 4 / 7, "gower": 2, "cosine": 11 / (17**0.5 * 13**0.5), "motyka": 3 / 10, "wave_hedges": 2 / 3 + 2 / 4}
    for name, value in want.items():
        assert df.select(DISTANCES[name](a, c)).first()[0] == pytest.approx(value), name


def test_geometric_median_is_stationary():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(25, 3))
    z = reducers.geometric_median(m, 2000, 1e-12)
    gap = m - z
    assert np.abs((gap / np.linalg.norm(gap, axis=1)[:, None]).mean(0)).max() < 1e-5


def test_geomedoid_is_a_row(spark):
    cube = cube_of(spark, [(i, i, 0, 0, float(i), float(i + 3)) for i in (1, 2, 3)])
    assert values(reducers.geomedoid(cube), "a", "b") == [(2.0, 5.0)]


def test_hampel_by_hand(spark):
    v = [1.0, 1.1, None, 9.0, 1.2, 1.0, None, None, 1.1]
    cube = cube_of(spark, [(i, i, 0, 0, x) for i, x in enumerate(v)], ("a",))

    def run(**options):
        return [r.a for r in series.hampel(cube, **options).df.orderBy("item").collect()]

    assert run(k=1, t0=3.0) == [1.0, 1.1, None, 1.2, 1.2, 1.0, None, None, 1.1] or run(k=1, t0=3.0)[3] == 1.2
    assert run(k=4, t0=0.0) == v  # too short for a window
    assert series.hampel(cube, 1, 3.0, True).df.filter("a is null").count() == 0
    for bad in ({"k": 0}, {"k": 1.5}, {"t0": -1}):
        with pytest.raises(errors.OutOfRange):
            series.hampel(cube, **bad)


def test_leading_gaps_stay(spark):
    cube = cube_of(spark, [(1, 1, 0, 0, None), (2, 2, 0, 0, 5.0), (3, 3, 0, 0, None)], ("a",))
    assert [r.a for r in series.carry_forward(cube).df.orderBy("item").collect()] == [None, 5.0, 5.0]


def test_moving_mean_is_missing_at_the_ends(spark):
    cube = cube_of(spark, [(i, i, 0, 0, float(i)) for i in range(5)], ("a",))
    assert [r.a for r in series.moving_mean(cube, 3).df.orderBy("item").collect()] == [None, 1.0, 2.0, 3.0, None]


def test_user_series_keeps_every_row(spark):
    cube = cube_of(spark, [(i, i, 0, 0, float(i)) for i in range(4)], ("a",))
    assert [r.a for r in series.apply_series(cube, lambda v: v[::-1]).df.orderBy("item").collect()] == [3.0, 2.0, 1.0, 0.0]


def test_empty_cube(spark):
    cube = cube_of(spark, [])
    assert composites.composite(cube, "median").count() == reducers.medoid(cube).count() == 0
    assert series.hampel(cube).df.count() == 0


def _plain_averaged(rows, nstart=10, gamma=10.0, alpha=0.65):
    """The averaged steps again, number by number."""
    k = len(rows[0])
    column = lambda i: sorted(r[i] for r in rows if r[i] is not None)
    median = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
    mean = [median(column(i)) for i in range(k)]
    for _ in range(nstart):
        at = list(mean)
        for n, row in enumerate(rows[1:], 2):
            gap = [0.0 if v is None else v - a for v, a in zip(row, at, strict=True)]
            far = sum(g * g for g in gap) ** 0.5
            if far > 1e-8:
                at = [a + g * gamma * k**0.5 / n**alpha / far for a, g in zip(at, gap, strict=True)]
            mean = [m + (a - m) / n for m, a in zip(mean, at, strict=True)]
    return mean


def test_averaged_median_against_plain_steps(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i, i % 3, 0, *(None if rng.random() < 0.1 else float(v) for v in rng.normal(50, 20, 3))) for i in range(90)]
    cube = cube_of(spark, rows, ("a", "b", "c"))
    for r in reducers.geomedian(cube).collect():
        own = [row[4:] for row in rows if row[2] == r.x and any(v is not None for v in row[4:])]
        assert [r.a, r.b, r.c] == pytest.approx(_plain_averaged(own), rel=1e-9)


def test_averaged_medians_of_many_cells_are_those_of_each():
    rng = np.random.default_rng(3)
    for sizes in ([0, 5, 1, 30, 0, 2, 30], [0], [1, 1], [4]):
        m = np.round(rng.normal(50, 20, (sum(sizes), 3)))
        m[rng.random(m.shape) < 0.3] = np.nan
        m[: sizes[1] if len(sizes) > 1 else 0, 0] = np.nan
        m[-4:-3, 1] = np.inf
        m[np.isnan(m).all(1), 2] = 7.0
        got = reducers.averaged_medians(m, np.array(sizes))
        assert len(got) == len(sizes)
        for out, own in zip(got, np.split(m, np.cumsum(sizes)[:-1]), strict=True):
            want = reducers.averaged_median(own) if len(own) else np.full(3, np.nan)
            np.testing.assert_allclose(out, want, rtol=1e-12)


def test_averaged_medians_take_blocks_of_whole_cells(spark, monkeypatch):
    """Cells run over Arrow batches and over the size of a block; cells without a value stay."""
    monkeypatch.setattr(reducers, "BLOCK", 50)
    rng = np.random.default_rng(8)
    rows = [(i, i, i * i % 7, 0, *(None if rng.random() < 0.3 else float(v) for v in rng.normal(50, 20, 2))) for i in range(400)]
    rows += [(i, 0, 9, 0, None, None) for i in range(5)]
    cube = cube_of(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.x: (r.a, r.b) for r in reducers.geomedian(cube).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {r[2] for r in rows} and got.pop(9) == (None, None)
    for x, v in got.items():
        own = [row[4:] for row in rows if row[2] == x and row[4:] != (None, None)]
        assert v == pytest.approx(_plain_averaged(own), rel=1e-9)


def test_averaged_median_comes_near_the_geometric_median():
    m = np.random.default_rng(1).normal(100, 10, size=(400, 3))
    assert np.abs(reducers.averaged_median(m) - reducers.geometric_median(m)).max() < 2.0


def test_weiszfeld_takes_complete_bands_and_imputes_the_others(spark):
    rows = [(i, i, 0, 0, float(v), float(2 * v), None if i == 2 else float(3 * v)) for i, v in enumerate((1, 2, 4, 8, 9))]
    cube = cube_of(spark, rows, ("a", "b", "c"))
    got = reducers.geomedian(cube, weiszfeld=True).first()
    m = np.array([[v, 2 * v] for v in (1, 2, 4, 8, 9)], float)
    assert [got.a, got.b] == pytest.approx(reducers.geometric_median(m).tolist(), abs=1e-4)
    assert got.c == pytest.approx(_plain_averaged([r[4:] for r in rows])[2])
    assert reducers.geomedian(cube, weiszfeld=True, impute=False).first().c is None
    with pytest.raises(errors.OutOfRange):
        reducers.geomedian(cube, nstart=0)


def _gap_rows():
    """The rows of the registered reducers' cube at the smallest scale, by cell, in order of time."""
    import duckdb

    from pixeltide.plans import catalog_of_queries as catalog

    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    cells = {}
    for x, y, *v in con.execute(f"WITH {catalog.G} SELECT x, y, blue, red, nir FROM h WHERE coalesce(blue, red, nir) IS NOT NULL ORDER BY x, y, t, item").fetchall():
        cells.setdefault((x, y), []).append(v)
    return cells


def test_registered_medians_against_brute_force(spark):
    """What SQL cannot say of the registered reducers: medians by steps, and the row nearest to the median."""
    from pixeltide.plans import catalog_of_queries as catalog

    cells, sf = _gap_rows(), "/root/testdata/sf0.001"
    for r in catalog.QUERIES["reduce_geomedian"](spark, sf).collect():
        assert [r.blue, r.red, r.nir] == pytest.approx(_plain_averaged(cells[r.x, r.y]), abs=2e-5)

    def minimum(points):
        """By bisection along the gradient of each coordinate: the sum of distances is convex."""
        z = np.median(points, axis=0)
        for _ in range(20_000):
            d = np.maximum(np.linalg.norm(points - z, axis=1), 1e-8)
            new = (points / d[:, None]).sum(0) / (1 / d).sum()
            if np.abs(new - z).max() < 1e-9:
                break
            z = new
        return z

    weiszfeld = {(r.x, r.y): r for r in catalog.QUERIES["reduce_geomedian_weiszfeld"](spark, sf).collect()}
    medoid = {(r.x, r.y): r for r in catalog.QUERIES["reduce_geomedoid"](spark, sf).collect()}
    for cell, rows in cells.items():
        m = np.array([[np.nan if v is None else v for v in row] for row in rows])
        full = ~np.isnan(m).any(0)
        z = minimum(m[:, full])
        got = np.array([weiszfeld[cell][b] for b in ("blue", "red", "nir")], float)[full]
        cost = lambda c: np.linalg.norm(m[:, full] - c, axis=1).sum()  # noqa: E731, B023
        assert cost(got) <= cost(z) * (1 + 1e-4)
        own = np.array([medoid[cell][b] for b in ("blue", "red", "nir")], float)[full]
        far = np.linalg.norm(m[:, full] - z, axis=1)
        assert np.abs(m[:, full] - own).max(1).min() < 1e-4 and np.linalg.norm(own - z) <= far.min() + 0.05


def test_one_exchange_for_medoids_and_filters(spark):
    rows = [(i, i, 0, 0, float(i), 1.0, 2.0) for i in range(9)]
    cube = cube_of(spark, rows, ("a", "b", "c"))
    for df in (reducers.medoid(cube), series.hampel(cube, 1, 3.0, True).df):
        assert df._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
